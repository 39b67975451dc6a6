"""Semantic cache as tables: lookup, store, order-exact replay of a query log, statistics.

A *query row* has ``seq`` (position in the log, unique), ``query``, ``embedding``, ``memberships``,
``top_clusters`` and ``dominant_cluster``. A *cache entry* is a query that missed: it is stored under its
dominant cluster and found by later queries that list this cluster among their top clusters.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softseek.functions.vectors import dominant_cluster, round_half_even4, top_clusters
from softseek.operators.chains import PART_ROWS, settle_epochs, settle_round
from softseek.operators.joins import lookup_join
from softseek.operators.ordering import carry_window, range_parts
from softseek.operators.pairs import Rule, Sizes, with_best_match
from softseek.session import materialize

DEFAULT_THRESHOLD = 0.80
FIRST_BLOCK = 100_000
BLOCK_GROWTH = 4
#: Rows of short epochs that a task holds at a time, about.
GROUP_ROWS = 32_768
#: Stands for a missing epoch, whose rows match nothing.
NO_EPOCH = -(1 << 63)


def with_clusters(df: DataFrame, n: int = 2) -> DataFrame:
    """Adds the clusters to search, and the cluster to store under, from ``memberships``."""
    u = F.col("memberships")
    return df.withColumns({"top_clusters": top_clusters(u, n), "dominant_cluster": dominant_cluster(u)})


# ------------------------------------------------------------------------------- lookup, store, views


def cache_lookup(queries: DataFrame, entries: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Best entry of a fixed cache for every query; misses stay with nulls.

    ``queries(seq, embedding, top_clusters[, theta])``, ``entries(seq, query, embedding, cluster_id[, result])``.
    A hit has the entry's number, text (``matched_query``) and, where the entries have one, its ``result``. It needs a score of at least the threshold. Equal scores: the query's stronger cluster first,
    then the earlier entry.
    """
    theta = F.coalesce("theta", F.lit(threshold)) if "theta" in queries.columns else F.lit(threshold)
    lookups = queries.withColumns(
        {"q_id": F.col("seq").cast("long"), "q_vec": F.col("embedding"), "q_buckets": F.col("top_clusters"), "q_floor": theta}
    )
    stored = entries.select(
        F.col("seq").alias("e_id"), F.col("embedding").alias("e_vec"), F.col("cluster_id").alias("e_bucket")
    )
    matched = with_best_match(lookups, stored, Rule(bucketed=True, floor=True, by_position=True))
    found = matched.drop("q_id", "q_vec", "q_buckets", "q_floor").withColumnRenamed("e_id", "matched_seq")
    held = [c for c in ("query", "result") if c in entries.columns]
    texts = entries.select(F.col("seq").alias("matched_seq"), *[F.col(c).alias({"query": "matched_query"}.get(c, c)) for c in held])
    # One entry may serve a large share of the queries; the search is kept before that is examined.
    served = lookup_join(materialize(found, "found"), texts, "matched_seq", "left", spread_by=("seq",))
    names = ["matched_query" if c == "query" else c for c in held]
    return served.select(*[c for c in found.columns], *names).withColumn("cache_hit", F.col("matched_seq").isNotNull())


def cache_store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Append queries under their dominant cluster; equal queries are kept side by side."""
    rows = new.withColumn("cluster_id", F.col("dominant_cluster")).select(*entries.columns)
    return entries.unionByName(rows)


def all_entries(entries: DataFrame) -> DataFrame:
    return entries


def cluster_entries(entries: DataFrame, cluster_id: int) -> DataFrame:
    return entries.where(F.col("cluster_id") == cluster_id)


def flush(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emptied cache, and a one-row report with the number of entries cleared."""
    report = entries.agg(F.count("*").alias("entries_cleared")).select(
        F.lit("Cache flushed successfully").alias("message"), "entries_cleared"
    )
    return entries.limit(0), report


# --------------------------------------------------------------------------------- control events


#: Control events that are shared with every task: three numbers each, some 20 MB.
SHARED_EVENTS = 1_000_000


def control_state(
    log: DataFrame, threshold: float = DEFAULT_THRESHOLD, epoch: int = 0, shared_events: int = SHARED_EVENTS
) -> DataFrame:
    """Adds to every row of a log the threshold in force (``theta``) and its ``epoch``.

    ``log(seq, is_flush boolean, set_theta double)``. A flush starts the next epoch; a threshold stays
    until the next one is set and survives a flush. The events alone, three narrow columns, are read
    first: while their counted number is below ``shared_events`` each row looks up the last one at or
    before its ``seq``, and the log is neither sorted nor written. With more events the log is sorted once.
    """
    event = F.coalesce(F.col("is_flush"), F.lit(False)) | F.col("set_theta").isNotNull()
    whole = isinstance(log.schema["seq"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not whole:
        return _control_by_order(log, threshold, epoch)
    events = log.where(event).select(F.col("seq").cast("long").alias("seq"), F.coalesce("is_flush", F.lit(False)).alias("is_flush"), "set_theta")
    events = materialize(events, "events")
    if events.count() > shared_events:
        return _control_by_order(log, threshold, epoch)
    held = events.toPandas().sort_values("seq")
    at = held["seq"].to_numpy(np.int64)
    epochs = np.append(epoch, epoch + np.cumsum(held["is_flush"].to_numpy(bool)))
    thetas = held["set_theta"].astype(float).ffill().fillna(threshold).to_numpy()
    shared = log.sparkSession.sparkContext.broadcast((at, epochs, np.append(threshold, thetas)))

    @F.arrow_udf("struct<epoch: bigint, theta: double>")
    def in_force(seq: pa.Array) -> pa.Array:
        at, epochs, thetas = shared.value
        last = np.searchsorted(at, seq.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
        return pa.StructArray.from_arrays([pa.array(epochs[last], pa.int64()), pa.array(thetas[last], pa.float64())], names=["epoch", "theta"])

    # Declared nondeterministic so that one call gives both fields.
    state = in_force.asNondeterministic()(F.col("seq").cast("long"))
    return log.withColumn("_state", state).withColumns({"epoch": F.col("_state.epoch"), "theta": F.col("_state.theta")}).drop("_state")


def _control_by_order(log: DataFrame, threshold: float, epoch: int) -> DataFrame:
    """The running state inside range partitions of ``seq``, carried over by one small row per partition,
    so that no task sees the whole log."""
    parts = range_parts(log, "seq", label="log")
    inside = Window.partitionBy("_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    flushes = F.coalesce(F.col("is_flush").cast("long"), F.lit(0))
    totals = parts.groupBy("_part").agg(
        F.sum(flushes).alias("n"),
        F.max_by("set_theta", F.when(F.col("set_theta").isNotNull(), F.col("seq"))).alias("last"),
    )
    carried = totals.select(
        "_part",
        F.coalesce(F.sum("n").over(carry_window()), F.lit(0)).alias("_epochs"),
        F.last("last", ignorenulls=True).over(carry_window()).alias("_theta"),
    )
    return (
        parts.join(F.broadcast(carried), "_part")
        .withColumn("epoch", F.lit(epoch) + F.col("_epochs") + F.sum(flushes).over(inside))
        .withColumn("theta", F.coalesce(F.last("set_theta", ignorenulls=True).over(inside), "_theta", F.lit(threshold)))
        .drop("_part", "_at", "_epochs", "_theta")
    )


def threshold_as_of(log: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return control_state(log, threshold).drop("epoch")


# ------------------------------------------------------------------------------------------- replay


def _bucket(epoch, cluster):
    """Epoch and cluster as one id, for all 32-bit clusters: entries of another epoch are in no bucket of the query."""
    return F.shiftleft(epoch.cast("long"), 32) + cluster.cast("int").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


REPLAY_RULE = Rule(bucketed=True, earlier=True, floor=True, by_position=True)


def _stored(rows: DataFrame) -> DataFrame:
    """Log rows as cache entries."""
    return rows.select(F.col("q_id").alias("e_id"), F.col("q_vec").alias("e_vec"), F.col("home").alias("e_bucket"))


def _candidates(log: DataFrame) -> DataFrame:
    """The rows that can become entries.

    Later rows with the same vector, clusters, threshold and epoch as an earlier one decide as that one
    did: if it was stored they find it (score with itself, at least the threshold, in a searched
    cluster), if it hit an entry they see that entry too. So one row per group is enough, and copies of a
    query collapse before anything is shuffled. Rows that would not find themselves are all kept.
    """
    keys = ["q_floor", "q_vec", "q_buckets", "home"]
    itself = F.aggregate("q_vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    finds_itself = (itself >= F.col("q_floor")) & F.array_contains("q_buckets", F.col("home"))
    marked = log.withColumn("_own", F.when(finds_itself, F.lit(None)).otherwise(F.col("q_id")))
    return marked.groupBy(*keys, "_own").agg(F.min("q_id").alias("q_id")).drop("_own")


def _block_bounds(rows: DataFrame, count: int, first_block: int) -> list[tuple[int | None, int | None]]:
    """Ranges of the log, each ``BLOCK_GROWTH`` times the one before: few rounds for any log length."""
    shares, size, done = [], first_block, first_block
    while done < count:
        shares.append(done / count)
        size *= BLOCK_GROWTH
        done += size
    # The position of the cuts does not affect the result, so approximate quantiles do.
    cuts = sorted(set(int(c) for c in rows.approxQuantile("q_id", shares, 0.001))) if shares else []
    edges = [None, *cuts, None]
    return list(zip(edges[:-1], edges[1:]))


def _leaders(
    candidates: DataFrame, before: DataFrame | None, first_block: int, sizes: Sizes, part_rows: int = PART_ROWS
) -> DataFrame:
    """The candidates that the ordered log stores.

    A candidate is stored iff no stored one before it matches it: the lexicographically first maximal
    independent set. Inside a block of the log this is settled in rounds (``operators.chains``): parts of
    the log in parallel, each in its order, as far as no undecided candidate of an earlier part matches.
    Blelloch, Fineman and Shun (2012) show that few rounds are needed; a chain of dependent candidates
    costs at most one per part that it crosses. Candidates that an earlier block's entries match leave
    before the rounds start, which is exact because hits are never stored.
    """
    total, n_buckets = candidates.agg(F.count("*"), F.approx_count_distinct("home")).head()
    n_before = before.count() if before is not None else 0
    # bounds: every round works on a part of these
    within = replace(sizes, lookups=total, entries=total, buckets=max(1, n_buckets))
    decided = []
    for low, high in _block_bounds(candidates, total, first_block):
        rows = candidates if low is None else candidates.where(F.col("q_id") > low)
        rows = rows if high is None else rows.where(F.col("q_id") <= high)
        known = [_stored(d) for d in decided] + ([before] if before is not None else [])
        if known:
            bound = replace(within, entries=total + n_before)
            rows = _unmatched(rows, _union(known), bound)
        while not rows.isEmpty():
            settled = settle_round(rows, _stored(rows), REPLAY_RULE, within, part_rows)
            new = settled.where("state = 'stored'").drop("state")
            decided.append(new)
            rows = settled.where("state = 'open'").drop("state")
            rows = rows if rows.isEmpty() else _unmatched(rows, _stored(new), within)
    # Nothing is stored where entries from before match every candidate.
    return _union([_stored(d) for d in decided]) if decided else _stored(candidates).where(F.lit(False))


def _unmatched(rows: DataFrame, entries: DataFrame, sizes: Sizes) -> DataFrame:
    """The rows that no entry matches, as a table without lineage."""
    matched = with_best_match(rows, entries, REPLAY_RULE, sizes=sizes)
    return materialize(matched.where("e_id is null").drop("e_id", "score"), "undecided")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def cache_replay(
    queries: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    entries: DataFrame | None = None,
    first_block: int = FIRST_BLOCK,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Decide a whole query log as if its rows had come one after the other.

    ``queries(seq, query, embedding, top_clusters, dominant_cluster[, theta][, epoch])``; ``entries(seq,
    embedding, cluster_id[, epoch])`` is a cache filled before, with lower ``seq``. Adds ``cache_hit``,
    ``matched_seq``, ``similarity`` (4 places). Every miss is an entry from then on.

    Epochs share no entries. Those of at most ``part_rows`` rows, and without entries from before, are
    decided whole, each by one task, in one shuffle of the log; the others go through the rounds.
    """
    theta = F.coalesce("theta", F.lit(threshold)) if "theta" in queries.columns else F.lit(threshold)
    epoch = F.col("epoch") if "epoch" in queries.columns else F.lit(0)
    log = materialize(
        queries.withColumns(
            {
                "q_id": F.col("seq").cast("long"),
                "q_vec": F.col("embedding"),
                "q_floor": theta.cast("double"),
                "q_buckets": F.transform("top_clusters", lambda c: _bucket(epoch, c)),
                "home": _bucket(epoch, F.col("dominant_cluster")),
                "_epoch": F.coalesce(epoch.cast("long"), F.lit(NO_EPOCH)),
            }
        ).drop("embedding"),
        "queries",
    )
    before = None
    if entries is not None:
        entry_epoch = F.col("epoch") if "epoch" in entries.columns else F.lit(0)
        before = entries.select(
            F.col("seq").cast("long").alias("e_id"), F.col("embedding").alias("e_vec"),
            _bucket(entry_epoch, F.col("cluster_id")).alias("e_bucket"), entry_epoch.cast("long").alias("_epoch"),
        )
    short, rest = _by_epoch(log, before, part_rows)
    found = [short] if short is not None else []
    if rest is not None:
        found.append(_in_rounds(rest.drop("_epoch"), before.drop("_epoch") if before is not None else None, first_block, part_rows))
    decided = (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        .withColumn("embedding", F.col("q_vec"))
        .withColumn("cache_hit", F.col("e_id").isNotNull())
        .withColumn("matched_seq", F.col("e_id"))
        .withColumn("similarity", round_half_even4(F.col("score")))
        .select(*queries.columns, "cache_hit", "matched_seq", "similarity")
    )
    # Statistics, entries and answers all read the decisions: they are computed once.
    return materialize(decided, "decisions")


def _by_epoch(log: DataFrame, before: DataFrame | None, part_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The decided rows of short epochs, and the rows of all other epochs; None where there are none."""
    sizes = log.groupBy("_epoch").agg(F.count("*").alias("n"))
    whole = F.col("n") <= part_rows
    if before is not None:
        known = before.where("_epoch is not null").select("_epoch", F.lit(True).alias("_known")).distinct()
        sizes, whole = sizes.join(known, "_epoch", "left"), whole & F.col("_known").isNull()
    sizes = materialize(sizes.select("_epoch", "n", whole.alias("whole")), "epochs")
    n_short, epochs, n_rest = sizes.agg(F.sum(F.when(F.col("whole"), F.col("n"))), F.count_if("whole"), F.count_if(~F.col("whole"))).head()
    if not epochs:
        return None, log
    tasks = max(-(-n_short // GROUP_ROWS), min(epochs, 2 * log.sparkSession.sparkContext.defaultParallelism))
    if not n_rest:
        return settle_epochs(log, tasks), None
    others = sizes.where(~F.col("whole")).select("_epoch")
    return settle_epochs(log.join(others, "_epoch", "left_anti"), tasks), log.join(others, "_epoch", "left_semi")


def _in_rounds(log: DataFrame, before: DataFrame | None, first_block: int, part_rows: int) -> DataFrame:
    """``log`` plus ``e_id`` and ``score`` of the entry that serves a row, for epochs of any length."""
    first = log.select(F.size("q_vec").alias("d")).head(1)
    sizes = Sizes(log.count(), 0, 8 * first[0]["d"] if first else 0, 1, 0)
    candidates = materialize(_candidates(log), "candidates")
    stored = materialize(_leaders(candidates, before, first_block, sizes, part_rows), "entries")
    cache = stored if before is None else before.unionByName(stored)
    n_e, n_buckets = cache.agg(F.count("*"), F.approx_count_distinct("e_bucket")).head()
    sizes = replace(sizes, entries=n_e, buckets=max(1, n_buckets))
    return with_best_match(log, cache, REPLAY_RULE, sizes=sizes)


def with_matched_query(decisions: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Adds ``matched_query``, the text of the entry that served each hit."""
    texts = decisions.where(~F.col("cache_hit")).select("seq", "query")
    if entries is not None:
        texts = texts.unionByName(entries.select("seq", "query"))
    texts = texts.select(F.col("seq").alias("matched_seq"), F.col("query").alias("matched_query"))
    return lookup_join(decisions, texts, "matched_seq", "left", spread_by=("seq",))


def replay_log(log: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Replay a log that also holds flush and set-threshold events; these are not queries."""
    state = control_state(log, threshold)
    is_query = ~F.coalesce(F.col("is_flush"), F.lit(False)) & F.col("set_theta").isNull()
    return cache_replay(state.where(is_query).drop("is_flush", "set_theta"), threshold)


# --------------------------------------------------------------------------------------- statistics


def entries_of(decisions: DataFrame) -> DataFrame:
    """The entries that a replay stored."""
    return decisions.where(~F.col("cache_hit")).withColumn("cluster_id", F.col("dominant_cluster"))


def _current(decisions: DataFrame, epoch: int | None) -> DataFrame:
    """Counters and entries restart at a flush: only the given epoch counts."""
    return decisions if epoch is None or "epoch" not in decisions.columns else decisions.where(F.col("epoch") == epoch)


def cache_stats(decisions: DataFrame, threshold: float = DEFAULT_THRESHOLD, epoch: int | None = None) -> DataFrame:
    """Entries, hits, misses and the hit rate to 4 places; 0.0 before the first query."""
    hits, misses = F.count_if("cache_hit"), F.count_if(~F.col("cache_hit"))
    counts = _current(decisions, epoch).agg(
        misses.alias("total_entries"), hits.alias("hit_count"), misses.alias("miss_count")
    )
    rate = F.try_divide(F.col("hit_count"), F.col("hit_count") + F.col("miss_count"))
    return counts.withColumn("hit_rate", F.coalesce(round_half_even4(rate), F.lit(0.0))).withColumn(
        "threshold", F.lit(threshold)
    )


def epoch_stats(decisions: DataFrame) -> DataFrame:
    """The same counters per epoch. The entries of a finished epoch are what its flush cleared."""
    hits, misses = F.count_if("cache_hit"), F.count_if(~F.col("cache_hit"))
    counts = decisions.groupBy("epoch").agg(
        misses.alias("total_entries"), hits.alias("hit_count"), misses.alias("miss_count")
    )
    rate = F.try_divide(F.col("hit_count"), F.col("hit_count") + F.col("miss_count"))
    return counts.withColumn("hit_rate", F.coalesce(round_half_even4(rate), F.lit(0.0)))


def flush_report(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per flush event of the log: how many entries it cleared."""
    state = control_state(log.select("seq", "is_flush", "set_theta"))
    flushes = state.where("is_flush").select("seq", (F.col("epoch") - 1).alias("epoch"))
    cleared = decisions.where(~F.col("cache_hit")).groupBy("epoch").agg(F.count("*").alias("n"))
    return flushes.join(cleared, "epoch", "left").select(
        "seq", "epoch", F.coalesce("n", F.lit(0)).alias("entries_cleared")
    )


def cluster_distribution(entries: DataFrame) -> DataFrame:
    return entries.groupBy("cluster_id").agg(F.count("*").alias("entries"))


def entry_hits(decisions: DataFrame) -> DataFrame:
    """How often each stored entry was served, 0 if never."""
    served = decisions.where("cache_hit").groupBy("matched_seq").agg(F.count("*").alias("n"))
    return (
        entries_of(decisions)
        .select("seq", "cluster_id")
        .join(served.withColumnRenamed("matched_seq", "seq"), "seq", "left")
        .select("seq", "cluster_id", F.coalesce("n", F.lit(0)).alias("hit_count"))
    )


def scan_cost(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Dot products of a full scan and of a scan of the searched clusters, from counts alone."""
    asked = (
        queries.select(F.explode("top_clusters").alias("cluster_id"))
        .groupBy("cluster_id").agg(F.count("*").alias("lookups"))
    )
    per_cluster = asked.join(cluster_distribution(entries), "cluster_id")
    pruned = per_cluster.agg(F.sum(F.col("lookups") * F.col("entries")).alias("pruned")).withColumn("one", F.lit(1))
    n_q = queries.agg(F.count("*").alias("n_q")).withColumn("one", F.lit(1))
    n_e = entries.agg(F.count("*").alias("n_e")).withColumn("one", F.lit(1))
    both = n_q.join(n_e, "one").join(pruned, "one")
    full = F.col("n_q") * F.col("n_e")
    return both.select(
        full.alias("flat_products"),
        F.coalesce("pruned", F.lit(0)).alias("bucket_products"),
        F.try_divide(full, F.col("pruned")).alias("speedup"),
    )
