"""Query jobs: validation and end-to-end answers for a log of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseek.functions.text import strip_text
from softseek.operators.cache import DEFAULT_THRESHOLD, cache_replay, with_clusters
from softseek.operators.joins import lookup_join
from softseek.operators.search import format_results, topk_search
from softseek.session import materialize

DEFAULT_TOP_K = 5


def validate_queries(queries: DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """Stripped query, default ``top_k``, and ``reject_reason``, null where the query is to be answered."""
    given = F.col("top_k") if "top_k" in queries.columns else F.lit(None)
    text = strip_text(F.coalesce(F.col("query"), F.lit("")))
    return queries.withColumns({"query": text, "top_k": F.coalesce(given, F.lit(top_k)).cast("int")}).withColumn(
        "reject_reason", F.when(F.col("query") == "", "Query cannot be empty")
    )


def answer_queries(
    queries: DataFrame,
    index: DataFrame,
    model,
    threshold: float = DEFAULT_THRESHOLD,
    entries: DataFrame | None = None,
    payload: DataFrame | None = None,
) -> DataFrame:
    """Answer a log in order: hits repeat the text of the entry they match, misses search the index.

    ``queries(seq, query, embedding[, top_k][, theta][, epoch])``; ``model.memberships`` adds memberships;
    ``entries`` is a cache from before, with ``query`` and ``result``; ``payload`` has the index's payload
    by ``point_id``, if the index holds vectors only. Rejected queries are left out. Only misses are
    searched; a hit carries ``top_k`` of the query whose text it returns.
    """
    valid = validate_queries(queries).where("reject_reason is null").drop("reject_reason")
    log = with_clusters(model.memberships(valid))
    decided = cache_replay(log, threshold, entries)

    return answer_decided(decided, index, entries, payload)[0]


def answer_decided(
    decided: DataFrame, index: DataFrame, entries: DataFrame | None = None, payload: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The answers of a decided log, and ``seq, query, top_k, result`` of its misses, which are the new entries.

    ``decided``: what ``cache_replay`` makes of a validated log; ``entries``, ``payload``: as for ``answer_queries``.
    """
    misses = decided.where(~F.col("cache_hit")).select(F.col("seq").alias("query_id"), "embedding", "top_k")
    texts = format_results(misses, topk_search(misses, index, payload=True if payload is None else payload))
    missed = decided.where(~F.col("cache_hit")).select("seq", "query", "top_k")
    made = materialize(missed.join(texts.withColumnRenamed("query_id", "seq"), "seq"), "answers")
    stored = made if entries is None else made.unionByName(entries.select("seq", "query", "top_k", "result"))
    # The text that answers each query: its own if it missed, that of the entry if it hit. One entry may
    # serve a large share of the log, which lookup_join keeps out of a single task.
    stored = stored.select(
        F.col("seq").alias("source_seq"), F.col("query").alias("source_query"), F.col("top_k").alias("source_top_k"), "result"
    )
    answered = lookup_join(
        decided.drop("embedding", "memberships").withColumn("source_seq", F.coalesce("matched_seq", "seq")),
        stored, "source_seq", spread_by=("seq",),
    )
    answers = answered.select(
        "seq",
        "query",
        "cache_hit",
        F.when(F.col("cache_hit"), F.col("source_query")).alias("matched_query"),
        F.col("similarity").alias("similarity_score"),
        "result",
        "dominant_cluster",
        F.col("source_top_k").alias("top_k"),
    )
    return answers, made


def service_summary(entries: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return entries.agg(F.count("*").alias("cache_entries")).select(
        F.lit("ok").alias("status"), "cache_entries", F.lit(threshold).alias("threshold")
    )
