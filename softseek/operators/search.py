"""Exact and cluster-pruned top-k search over an index of unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softseek.functions.text import strip_text
from softseek.operators.joins import HOT_ROWS, lookup_join
from softseek.operators.pairs import Rule, measure, nearest_pairs
from softseek.session import materialize

NO_RESULT = "No relevant documents found."
EXCERPT_CHARS = 300
MAX_SCAN_CLUSTERS = 1000


def _lookups(queries: DataFrame, k: int, *extra: Column) -> tuple[DataFrame, bool]:
    """Kernel input; a ``top_k`` column overrides ``k`` row by row."""
    row_k = "top_k" in queries.columns
    cols = [F.col("query_id").cast("long").alias("q_id"), F.col("embedding").alias("q_vec"), *extra]
    if row_k:
        cols.append(F.coalesce(F.col("top_k"), F.lit(k)).cast("long").alias("q_k"))
    return queries.where("embedding is not null").select(*cols), row_k


def _search(lookups: DataFrame, entries: DataFrame, rule: Rule, payload: DataFrame | None) -> DataFrame:
    sizes = measure(lookups, entries, rule)
    hits = nearest_pairs(lookups, entries, rule, sizes=sizes).select(
        F.col("q_id").alias("query_id"), "rank", F.col("e_id").alias("point_id"), "score"
    )
    if payload is None:
        return hits
    if sizes.results <= HOT_ROWS:
        # Four numbers per result, at most 40 MB: the payload is filtered where it lies.
        return payload.join(F.broadcast(hits), "point_id").select("point_id", *hits.columns[:2], "score", *[c for c in payload.columns if c != "point_id"])
    # A point can be a hit of very many queries; the search result is kept before it is examined.
    return lookup_join(materialize(hits, "hits"), payload, "point_id", spread_by=("query_id",))


def topk_search(queries: DataFrame, index: DataFrame, k: int = 5, payload: bool | DataFrame = True) -> DataFrame:
    """The ``k`` most similar points per query with score, rank and payload; ties by point id.

    ``queries(query_id, embedding[, top_k])``, ``index(point_id, embedding, payload...)``. The search
    reads only id and vector; payload columns are fetched for the hits alone. ``payload``: whether they
    are fetched, or the table ``(point_id, payload...)`` that has them if the index holds vectors only.
    """
    lookups, row_k = _lookups(queries, k)
    entries = index.select(F.col("point_id").cast("long").alias("e_id"), F.col("embedding").alias("e_vec"))
    if isinstance(payload, bool):
        payload = index.drop("embedding") if payload else None
    return _search(lookups, entries, Rule(k=k, row_k=row_k), payload)


def pruned_search(queries: DataFrame, index: DataFrame, k: int = 5, payload: bool = True) -> DataFrame:
    """Approximate search: only points whose dominant cluster is among the query's ``top_clusters``.

    When few clusters are asked for, the scan is filtered to them first, which skips the partitions of an
    index written by cluster.
    """
    index = index.where("dominant_cluster is not null")
    asked = queries.select(F.explode("top_clusters").alias("c")).distinct().limit(MAX_SCAN_CLUSTERS + 1).collect()
    if len(asked) <= MAX_SCAN_CLUSTERS:
        index = index.where(F.col("dominant_cluster").isin([r["c"] for r in asked]))
    lookups, row_k = _lookups(queries, k, F.col("top_clusters").alias("q_buckets"))
    entries = index.select(
        F.col("point_id").cast("long").alias("e_id"),
        F.col("embedding").alias("e_vec"),
        F.col("dominant_cluster").alias("e_bucket"),
    )
    return _search(lookups, entries, Rule(k=k, row_k=row_k, bucketed=True), index.drop("embedding") if payload else None)


def neighbors(index: DataFrame, ids: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest points of the given points, plus the point itself (``k + 1`` rows each)."""
    queries = index.join(ids.select("point_id"), "point_id", "left_semi").select(
        F.col("point_id").alias("query_id"), "embedding"
    )
    return topk_search(queries, index, k + 1)


def knn_graph(vectors: DataFrame, n: int = 15) -> DataFrame:
    """Edges to the ``n`` nearest other points by cosine distance, for unit vectors."""
    lookups = vectors.select(F.col("point_id").cast("long").alias("q_id"), F.col("embedding").alias("q_vec"))
    entries = vectors.select(F.col("point_id").cast("long").alias("e_id"), F.col("embedding").alias("e_vec"))
    found = nearest_pairs(lookups, entries, Rule(k=n, skip_self=True))
    return found.select(
        F.col("q_id").alias("point_id"),
        F.col("e_id").alias("neighbor_id"),
        "rank",
        (F.lit(1.0) - F.col("score")).alias("distance"),
    )


def result_block(rank: Column, category: Column, score: Column, subject: Column, text: Column) -> Column:
    """One hit as text: rank, category and score, subject, excerpt."""
    shown = F.translate(F.substring(text, 1, EXCERPT_CHARS), "\n", " ")
    excerpt = F.concat(
        strip_text(shown),
        F.when(F.length(text) > EXCERPT_CHARS, F.lit("...")).otherwise(F.lit("")),
    )
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] category="), F.coalesce(category, F.lit("unknown")),
        F.lit(" | score="), F.call_function("format_number", score, F.lit("0.0000")),
        F.lit("\n    subject: "), F.coalesce(subject, F.lit("")),
        F.lit("\n    excerpt: "), F.coalesce(excerpt, F.lit("")),
    )


def format_results(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One text per query: its hits in rank order, or a fixed sentence where there is none."""
    blocks = hits.select(
        "query_id", "rank", result_block(*(F.col(c) for c in ("rank", "category", "score", "subject", "text"))).alias("block")
    )
    texts = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    texts = texts.select("query_id", F.array_join(F.col("b.block"), "\n\n").alias("result"))
    return (
        queries.select("query_id")
        .join(texts, "query_id", "left")
        .select("query_id", F.coalesce("result", F.lit(NO_RESULT)).alias("result"))
    )
