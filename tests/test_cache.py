"""Lookup rules, and the replay against a loop that handles one query after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from softseek.operators import cache, chains
from softseek.operators.joins import lookup_join
from softseek.streaming import cache_stream

LOG = (
    "seq long, query string, embedding array<double>, memberships array<double>, is_flush boolean, set_theta double"
)


def unit(rng, d=5):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def random_log(seed, n=60, start=0, controls=True):
    """Few directions, so that there are copies and near copies; memberships with ties."""
    rng = np.random.default_rng(seed)
    pool = [unit(rng) for _ in range(8)]
    pool += [(p + 0.3 * unit(rng)) for p in pool]
    pool = [p / np.linalg.norm(p) for p in pool]
    levels = np.array([0.1, 0.2, 0.3])
    homes = [rng.choice(levels, 4).tolist() for _ in pool]
    rows = []
    for i in range(n):
        if controls and rng.random() < 0.04:
            rows.append((start + i, None, None, None, True, None))
        elif controls and rng.random() < 0.06:
            rows.append((start + i, None, None, None, False, float(rng.choice([0.5, 0.8, 0.95, 1.1]))))
        else:
            j = int(rng.choice(len(pool), p=[0.3] + [0.7 / (len(pool) - 1)] * (len(pool) - 1)))
            rows.append((start + i, f"q{j}", pool[j].tolist(), homes[j], False, None))
    return rows


def one_by_one(rows, theta):
    """seq -> (hit, matched seq, score), from the rule: of all rows stored so far whose home is one of the
    two clusters that a query searches, the first by score, then by place of the cluster, then by seq."""
    stored, out = [], {}
    for seq, _, vec, u, is_flush, set_theta in rows:
        if is_flush or set_theta is not None:
            stored, theta = ([], theta) if is_flush else (stored, set_theta)
            continue
        clusters = sorted(range(len(u)), key=lambda c: (u[c], c), reverse=True)
        places = {c: p for p, c in enumerate(clusters[:2])}
        found = [(-sum_left_to_right(vec, w), places[home], s) for s, home, w in stored if home in places]
        score, _, match = min(found, default=(2.0, None, None))
        out[seq] = (True, match, round(-score, 4)) if -score >= theta else (False, None, None)
        if match is None or -score < theta:
            stored.append((seq, u.index(max(u)), vec))
    return out


def sum_left_to_right(a, b):
    return float(np.cumsum(np.array(a) * np.array(b))[-1])


def decided(df):
    return {r.seq: (r.cache_hit, r.matched_seq, r.similarity) for r in df.select("seq", "cache_hit", "matched_seq", "similarity").collect()}


def log_frame(spark, rows, n=2):
    return cache.with_clusters(spark.createDataFrame(rows, LOG), n)


def test_replay_of_many_random_logs(spark):
    """Every log is one epoch of a combined log: 150 logs in one job."""
    rows, expected = [], {}
    for seed in range(150):
        part = random_log(seed, start=seed * 1000, controls=False)
        expected |= one_by_one(part, 0.8)
        rows += part
    df = log_frame(spark, rows).withColumn("epoch", F.expr("seq div 1000")).drop("is_flush", "set_theta")
    assert decided(cache.cache_replay(df, 0.8)) == expected


@pytest.mark.parametrize("first_block,limit", [(cache.FIRST_BLOCK, None), (30, None), (100, 0)])
def test_replay_with_flush_and_threshold_events(spark, monkeypatch, first_block, limit):
    if limit is not None:  # neither side may be broadcast
        plain = cache.with_best_match
        monkeypatch.setattr(
            cache, "with_best_match", lambda *a, **k: plain(*a, **k, broadcast_bytes=limit, block_bytes=8 * 5 * 9)
        )
    rows = random_log(1234, n=400)
    state = cache.control_state(log_frame(spark, rows).repartition(5), 0.8)
    queries = state.where("not is_flush and set_theta is null").drop("is_flush", "set_theta")
    assert decided(cache.cache_replay(queries, 0.8, first_block=first_block)) == one_by_one(rows, 0.8)


@pytest.mark.parametrize("part_rows, first_block", [(3, cache.FIRST_BLOCK), (7, 50), (1, 40)])
def test_replay_in_small_parts(spark, part_rows, first_block):
    rows = random_log(4321, n=300)
    state = cache.control_state(log_frame(spark, rows).repartition(5), 0.8)
    queries = state.where("not is_flush and set_theta is null").drop("is_flush", "set_theta")
    got = cache.cache_replay(queries, 0.8, first_block=first_block, part_rows=part_rows)
    assert decided(got) == one_by_one(rows, 0.8)


def test_a_chain_costs_a_round_per_part(spark, monkeypatch):
    """10,000 queries of which each matches only its neighbours: every second one is stored."""
    rounds, plain = [], chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, label: rounds.append(label) or plain(df, label))
    n, step = 10_000, 2 * np.pi / 10_001
    theta = (np.cos(step) + np.cos(2 * step)) / 2
    rows = [(i, f"q{i}", [float(np.cos(i * step)), float(np.sin(i * step))], [0.9, 0.1], False, None) for i in range(n)]
    queries = log_frame(spark, rows).drop("is_flush", "set_theta").repartition(8)
    got = {r.seq: (r.cache_hit, r.matched_seq) for r in cache.cache_replay(queries, theta).collect()}
    # The last one lies beside the first as well, which is stored earlier and scores the same or less.
    assert all(got[i] == ((True, i - 1) if i % 2 else (False, None)) for i in range(n - 1))
    assert got[n - 1][0]
    parts = -(-n // chains.PART_ROWS) + 8  # range partitions end where they end
    assert 1 <= rounds.count("round") <= parts


def test_rows_without_vector_are_stored_and_match_nothing(spark):
    rows = [(0, "a", [1.0, 0.0], [0.9, 0.1], False, None), (1, "b", None, [0.9, 0.1], False, None), (2, "c", [1.0, float("nan")], [0.9, 0.1], False, None),
            (3, "d", [1.0, 0.0], [0.9, 0.1], False, None), (4, "e", None, [0.9, 0.1], False, None)]
    got = decided(cache.cache_replay(log_frame(spark, rows).drop("is_flush", "set_theta"), 0.8))
    assert {s: r[:2] for s, r in got.items()} == {0: (False, None), 1: (False, None), 2: (False, None), 3: (True, 0), 4: (False, None)}


def test_replay_continues_a_stored_cache(spark):
    rows = random_log(77, n=160, controls=False)
    first, second = rows[:90], rows[90:]
    expected = one_by_one(rows, 0.8)
    done = cache.cache_replay(log_frame(spark, first).drop("is_flush", "set_theta"), 0.8)
    entries = cache.entries_of(done).select("seq", "query", "embedding", "cluster_id")
    rest = cache.cache_replay(log_frame(spark, second).drop("is_flush", "set_theta"), 0.8, entries)
    assert decided(done) | decided(rest) == expected


def test_copies_collapse_before_the_rounds(spark):
    rng = np.random.default_rng(0)
    hot = unit(rng).tolist()
    rows = [(i, "hot", hot, [0.9, 0.1], False, None) for i in range(500)]
    rows += [(500 + i, "q", unit(rng).tolist(), [0.9, 0.1], False, None) for i in range(5)]
    log = log_frame(spark, rows).select(
        F.col("seq").alias("q_id"), F.col("embedding").alias("q_vec"), F.lit(0.8).alias("q_floor"),
        F.col("top_clusters").cast("array<long>").alias("q_buckets"), F.col("dominant_cluster").cast("long").alias("home"),
    )
    assert cache._candidates(log).count() == 6
    # rows that would not find themselves are all kept
    assert cache._candidates(log.withColumn("home", F.lit(9).cast("long"))).count() == 505


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(5, n=240)
    expected = one_by_one(rows, 0.8)
    log = log_frame(spark, rows)
    for i in range(3):
        part = log.where((F.col("seq") >= i * 80) & (F.col("seq") < (i + 1) * 80))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    store = str(tmp_path / "store")
    cache_stream.cache_replay_stream(stream, store, str(tmp_path / "ckpt"), 0.8).awaitTermination()
    assert decided(cache_stream.read_decisions(spark, store)) == expected
    # a batch that is run again replaces its own output, whatever came later
    cache_stream.decide_batch(log.where("seq between 80 and 159"), 1, store, 0.8)
    assert decided(cache_stream.read_decisions(spark, store)) == expected
    with pytest.raises(ValueError, match="one order"):
        cache_stream.decide_batch(log.where("seq < 10"), 9, store, 0.8)


# --------------------------------------------------------------------- single lookups and statistics


def entry(seq, vec, cluster, query="q"):
    return (seq, query, [float(x) for x in vec], cluster)


def lookup(spark, entries, vec, clusters, theta):
    e = spark.createDataFrame(entries, "seq long, query string, embedding array<double>, cluster_id int")
    q = spark.createDataFrame([(100, [float(x) for x in vec], clusters)], "seq long, embedding array<double>, top_clusters array<int>")
    return cache.cache_lookup(q, e, theta).head()


def test_lookup_rules(spark):
    x, y = [1, 0], [0.6, 0.8]
    assert not lookup(spark, [], x, [0], 0.0).cache_hit
    assert not lookup(spark, [entry(1, x, 0)], x, [1], 0.8).cache_hit  # stored in a cluster not searched
    assert lookup(spark, [entry(1, x, 1)], x, [0, 1], 0.99).score == 1.0
    assert lookup(spark, [entry(1, y, 0), entry(2, x, 0)], x, [0], 0.0).matched_seq == 2  # the best one
    assert lookup(spark, [entry(1, y, 0)], x, [0], 0.6).cache_hit  # exactly the threshold
    assert not lookup(spark, [entry(1, y, 0)], x, [0], 0.61).cache_hit
    same = [entry(1, x, 1), entry(2, x, 0), entry(3, x, 0)]
    assert lookup(spark, same, x, [0, 1], 0.5).matched_seq == 2  # stronger cluster, then earlier entry


def test_threshold_moves_over_existing_entries(spark):
    rows = [(0, "a", [1.0, 0.0], [0.9, 0.1], False, None), (1, "b", [0.6, 0.8], [0.9, 0.1], False, None)]
    df = log_frame(spark, rows).drop("is_flush", "set_theta")
    assert decided(cache.cache_replay(df, 0.65))[1][0] is False
    assert decided(cache.cache_replay(df, 0.55))[1] == (True, 0, 0.6)


def test_three_way_tie_is_never_found(spark):
    rows = [(i, "q", [1.0, 0.0], [0.3, 0.3, 0.3], False, None) for i in range(3)]
    df = log_frame(spark, rows).drop("is_flush", "set_theta")
    assert not any(hit for hit, _, _ in decided(cache.cache_replay(df, 0.8)).values())


def test_stats_flush_and_hits(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    u = [0.9, 0.1]
    rows = [
        (0, "a", x, u, False, None), (1, "a", x, u, False, None), (2, "b", y, u, False, None), (3, "a", x, u, False, None),
        (4, None, None, None, True, None), (5, None, None, None, True, None), (6, "a", x, u, False, None),
    ]
    log = log_frame(spark, rows)
    done = cache.replay_log(log)
    stats = {r.epoch: (r.total_entries, r.hit_count, r.miss_count, r.hit_rate) for r in cache.epoch_stats(done).collect()}
    assert stats == {0: (2, 2, 2, 0.5), 2: (1, 0, 1, 0.0)}
    now = cache.cache_stats(done, epoch=2).head()
    assert (now.total_entries, now.hit_count, now.hit_rate, now.threshold) == (1, 0, 0.0, 0.8)
    assert cache.cache_stats(done, epoch=1).head().hit_rate == 0.0
    cleared = {r.seq: r.entries_cleared for r in cache.flush_report(log, done).collect()}
    assert cleared == {4: 2, 5: 0}
    assert {(r.seq, r.hit_count) for r in cache.entry_hits(done).collect()} == {(0, 2), (2, 0), (6, 0)}
    texts = {r.seq: r.matched_query for r in cache.with_matched_query(done).collect()}
    assert texts[1] == "a" and texts[2] is None
    entries = cache.entries_of(done)
    assert cache.cluster_entries(entries, 99).count() == 0
    assert cache.cluster_distribution(entries).head().entries == 3
    emptied, report = cache.flush(entries)
    assert emptied.count() == 0 and report.head().entries_cleared == 3
    assert cache.flush(emptied)[1].head().entries_cleared == 0


def test_store_keeps_duplicates(spark):
    base = spark.createDataFrame([entry(1, [1, 0], 0)], "seq long, query string, embedding array<double>, cluster_id int")
    new = spark.createDataFrame([(2, "q", [1.0, 0.0], 0)], "seq long, query string, embedding array<double>, dominant_cluster int")
    stored = cache.cache_store(base, new)
    assert stored.columns == base.columns and stored.count() == 2
    assert cache.all_entries(stored).count() == 2


def test_scan_cost_counts_bucket_products(spark):
    entries = spark.createDataFrame([(0,), (0,), (1,), (2,)], "cluster_id int")
    queries = spark.createDataFrame([([0, 1],), ([2, 3],)], "top_clusters array<int>")
    row = cache.scan_cost(queries, entries).head()
    assert (row.flat_products, row.bucket_products, row.speedup) == (8, 4, 2.0)


def test_control_state_without_events(spark):
    df = spark.range(50).select(F.col("id").alias("seq"), F.lit(False).alias("is_flush"), F.lit(None).cast("double").alias("set_theta"))
    rows = cache.threshold_as_of(df, 0.7).collect()
    assert len(rows) == 50 and {r.theta for r in rows} == {0.7}


def test_hot_entry_is_joined_without_one_task(spark):
    many = spark.range(1000).select(F.expr("id % 1 + 1").alias("matched_seq"), "id")
    unique = spark.createDataFrame([(1, "t"), (2, "u")], "matched_seq long, text string")
    joined = lookup_join(many, unique, "matched_seq", hot_rows=10)
    assert joined.count() == 1000
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_control_state_by_events_and_by_order(spark):
    rows = random_log(55, n=300)
    log = log_frame(spark, rows).repartition(5)
    shared, ordered = cache.control_state(log, 0.8, 3), cache.control_state(log, 0.8, 3, shared_events=0)
    assert shared.columns == ordered.columns
    assert sorted(map(str, shared.collect())) == sorted(map(str, ordered.collect()))
    # The log itself is neither sorted nor shuffled.
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan
    assert cache.control_state(log.limit(0)).collect() == []
    none = cache.control_state(log.where("not is_flush and set_theta is null"), 0.7, 2).select("epoch", "theta").distinct().collect()
    assert none == [(2, 0.7)]


def test_a_lookup_returns_the_entry(spark):
    entries = spark.createDataFrame(
        [(1, "first", [1.0, 0.0], 0, "text 1"), (2, "second", [0.0, 1.0], 0, None)], "seq long, query string, embedding array<double>, cluster_id int, result string"
    )
    queries = spark.createDataFrame([(10, [1.0, 0.0], [0]), (11, [0.0, 1.0], [0]), (12, [0.7, 0.7], [0])], "seq long, embedding array<double>, top_clusters array<int>")
    got = {r.seq: (r.cache_hit, r.matched_seq, r.matched_query, r.result) for r in cache.cache_lookup(queries, entries, 0.8).collect()}
    assert got == {10: (True, 1, "first", "text 1"), 11: (True, 2, "second", None), 12: (False, None, None, None)}
    bare = cache.cache_lookup(queries, entries.drop("result", "query"), 0.8)
    assert bare.count() == 3 and "matched_query" not in bare.columns


def test_short_epochs_are_decided_in_one_shuffle(spark, monkeypatch):
    """Short epochs need no rounds; long ones, and those with entries from before, still take them."""
    rows, rounds = random_log(1234, n=400), []
    state = cache.control_state(log_frame(spark, rows).repartition(5), 0.8)
    queries = state.where("not is_flush and set_theta is null").drop("is_flush", "set_theta")
    plain, want = cache.settle_round, one_by_one(rows, 0.8)
    monkeypatch.setattr(cache, "settle_round", lambda *args, **kw: rounds.append(1) or plain(*args, **kw))
    longest = max(r["count"] for r in queries.groupBy("epoch").count().collect())
    assert decided(cache.cache_replay(queries, 0.8, part_rows=longest)) == want and not rounds
    assert decided(cache.cache_replay(queries, 0.8, part_rows=longest - 1)) == want and rounds
    rounds.clear()
    first, last = queries.where("epoch < 3"), queries.where("epoch >= 3")
    held = cache.entries_of(cache.cache_replay(first, 0.8).withColumn("epoch", F.lit(3)))
    seqs = {r.seq for r in last.where("epoch > 3").select("seq").collect()}
    got = decided(cache.cache_replay(last, 0.8, held))
    assert rounds and {s: got[s] for s in seqs} == {s: want[s] for s in seqs}


def test_missing_clusters_and_vectors_in_short_epochs(spark):
    """Rows that cannot match are misses."""
    log = [(0, [1.0, 0.0], [1, None], 1), (1, [1.0, 0.0], None, 1), (2, [1.0, 0.0], [None, 1], None), (3, None, [1, 2], 1), (4, [1.0, 0.0], [2, 1], 2), (5, [float("nan"), 0.0], [1, 2], 1), (6, [1.0, 0.0], [2, 1], 1), (7, [1.0, 0.0], [1, 2], 1)]
    df = spark.createDataFrame(log, "seq long, embedding array<double>, top_clusters array<int>, dominant_cluster int")
    want = {0: None, 1: None, 2: 0, 3: None, 4: 0, 5: None, 6: 0, 7: 0}
    got = decided(cache.cache_replay(df, 0.8))
    assert {seq: match for seq, (_, match, _) in got.items()} == want
