"""The semantic cache over a stream of queries, kept across micro-batches: decisions, or whole answers.

Each micro-batch is decided with the same operators as a batch log, against the entries that earlier
batches stored (``streaming.store``). A batch reads only lower batch ids and overwrites its own folders, so
a repeated batch gives the same tables. One cache has one order, so a query must not be split by cluster
into keyed state: it reads several clusters and writes one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from softseek.operators.cache import DEFAULT_THRESHOLD, cache_replay, control_state, with_clusters
from softseek.plans.answer import answer_decided, validate_queries
from softseek.session import materialize
from softseek.streaming.store import COMPACT_EVERY, Store

#: Takes the queries of a batch with ``theta`` and ``epoch``, and the entries before it (or None); returns the
#: tables to write by name, and what the batch stored.
Decide = Callable[[DataFrame, Callable[[list[int]], DataFrame | None]], tuple[dict[str, DataFrame], DataFrame]]


def read_decisions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/decisions")


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/answers").drop("batch_id")


def _vector(queries: DataFrame) -> str:
    return queries.schema["embedding"].dataType.simpleString()


def _entry_schema(batch: DataFrame, answers: bool) -> str:
    plain = f"seq long, query string, embedding {_vector(batch)}"
    return f"{plain}, memberships array<double>, top_k int, result string" if answers else plain


def read_entries(spark: SparkSession, store: str, vector: str = "array<double>", answers: bool = False) -> DataFrame:
    """The entries that the cache holds now: those of the current epoch."""
    files = Store(spark, store)
    control = files.control() or Row(epoch=0, compacted=None)
    extra = ", memberships array<double>, top_k int, result string" if answers else ""
    return files.entries(f"seq long, query string, embedding {vector}{extra}", control)


def _run_batch(batch: DataFrame, batch_id: int, root: str, threshold: float, schema: str, compact_every: int, decide: Decide) -> None:
    """One micro-batch: control events, decisions, entries, then the control row."""
    store = Store(batch.sparkSession, root)
    before = store.control(before=batch_id)
    epoch, theta, last_seq = (before["epoch"], before["theta"], before["last_seq"]) if before else (0, threshold, None)
    state = materialize(control_state(batch, theta, epoch), "batch")
    ends = state.agg(
        F.min("seq").alias("first"), F.max("seq").alias("last_seq"),
        F.max_by("epoch", "seq").alias("epoch"), F.max_by("theta", "seq").alias("theta"),
    ).head()
    if last_seq is not None and ends["first"] is not None and ends["first"] <= last_seq:
        raise ValueError(f"row {ends['first']} arrived after row {last_seq}; a cache has one order")
    is_query = ~F.coalesce(F.col("is_flush"), F.lit(False)) & F.col("set_theta").isNull()
    queries = state.where(is_query).drop("is_flush", "set_theta")

    def entries(clusters: list[int]) -> DataFrame | None:
        # Entries of earlier epochs were flushed and cannot match any more.
        return store.entries(schema, before, batch_id, clusters) if before else None

    tables, stored = decide(queries, entries)
    after = (epoch, theta, last_seq) if ends["first"] is None else (ends["epoch"], ends["theta"], ends["last_seq"])
    for name, rows in tables.items():
        store.write(rows, name, batch_id)
    store.append(stored, after[0], batch_id)
    store.commit(before, Row(epoch=after[0], theta=after[1], last_seq=after[2]), batch_id, schema, compact_every)


def _searched(log: DataFrame) -> list[int]:
    """The clusters that a batch asks for, as many as the model has at most."""
    return [r["c"] for r in log.select(F.explode("top_clusters").alias("c")).distinct().collect()]


def decide_batch(
    batch: DataFrame, batch_id: int, store: str, threshold: float = DEFAULT_THRESHOLD, compact_every: int = COMPACT_EVERY
) -> None:
    """Decide one micro-batch and append its decisions, entries and control row."""

    def decide(queries: DataFrame, entries: Callable) -> tuple[dict[str, DataFrame], DataFrame]:
        decided = cache_replay(queries, threshold, entries(_searched(queries)))
        stored = decided.where(~F.col("cache_hit"))
        stored = stored.select("seq", "query", "embedding", F.col("dominant_cluster").cast("int").alias("cluster_id"), "epoch")
        return {"decisions": decided.drop("embedding")}, stored

    _run_batch(batch, batch_id, store, threshold, _entry_schema(batch, False), compact_every, decide)


def answer_batch(
    batch: DataFrame, batch_id: int, store: str, index: DataFrame, model, threshold: float = DEFAULT_THRESHOLD, compact_every: int = COMPACT_EVERY,
    payload: DataFrame | None = None,
) -> None:
    """Answer one micro-batch: hits repeat the text that an entry holds, misses search the index and are
    stored with their text. Rejected queries are left out."""

    def decide(queries: DataFrame, entries: Callable) -> tuple[dict[str, DataFrame], DataFrame]:
        valid = validate_queries(queries).where("reject_reason is null").drop("reject_reason")
        log = materialize(with_clusters(model.memberships(valid)), "log")
        held = entries(_searched(log))
        decided = cache_replay(log, threshold, held)
        answers, made = answer_decided(decided, index, held, payload)
        own = decided.where(~F.col("cache_hit")).select(
            "seq", "embedding", F.col("memberships").cast("array<double>").alias("memberships"), F.col("dominant_cluster").cast("int").alias("cluster_id"), "epoch"
        )
        return {"answers": answers}, made.join(own, "seq").select("seq", "query", "embedding", "memberships", "top_k", "result", "cluster_id", "epoch")

    _run_batch(batch, batch_id, store, threshold, _entry_schema(batch, True), compact_every, decide)


def _started(stream: DataFrame, checkpoint: str, available_now: bool, run: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cache_replay_stream(
    stream: DataFrame, store: str, checkpoint: str, threshold: float = DEFAULT_THRESHOLD, available_now: bool = True
) -> StreamingQuery:
    """Decide a stream of log rows, which must arrive in ``seq`` order, batch by batch.

    ``stream(seq, query, embedding, memberships, top_clusters, dominant_cluster, is_flush, set_theta)``.
    """
    return _started(stream, checkpoint, available_now, lambda batch, n: decide_batch(batch, n, store, threshold))


def answer_stream(
    stream: DataFrame, store: str, checkpoint: str, index: DataFrame, model, threshold: float = DEFAULT_THRESHOLD, available_now: bool = True,
    payload: DataFrame | None = None,
) -> StreamingQuery:
    """Answer a stream of queries, which must arrive in ``seq`` order, batch by batch: the rows of ``answer_queries``.

    ``stream(seq, query, embedding, is_flush, set_theta[, top_k])``; ``model.memberships`` adds memberships.
    Every batch reads ``index``, which should be a table rather than a job; ``payload`` as for ``answer_queries``.
    """
    return _started(stream, checkpoint, available_now, lambda batch, n: answer_batch(batch, n, store, index, model, threshold, payload=payload))
