"""All physical strategies of the pair operator against a plain double loop."""

import numpy as np
import pytest

from softseek.operators import pairs
from softseek.operators.joins import lookup_join
from softseek.operators.pairs import Rule, nearest_pairs, with_best_match

STRATEGIES = {
    "entries": {},
    "lookups": {"broadcast_bytes": "lookups"},
    "grid": {"broadcast_bytes": 0, "block_bytes": 8 * 6 * 7},
}


def data(seed, n_q=40, n_e=90, d=6, copies=True):
    """Few distinct small-integer vectors: many equal scores and many copies."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(-2, 3, (12, d)).astype(float)
    pick = (lambda n: pool[rng.integers(0, 12, n)]) if copies else (lambda n: rng.normal(size=(n, d)))
    q = [
        (int(i) + 20, v.tolist(), [int(b) for b in rng.permutation(4)[:2]], float(rng.integers(0, 6)), int(rng.integers(0, 5)))
        for i, v in zip(rng.permutation(n_q), pick(n_q))
    ]
    hot = lambda: 0 if rng.random() < 0.5 else int(rng.integers(0, 5))
    e = [(int(i), v.tolist(), hot()) for i, v in zip(rng.permutation(n_e), pick(n_e))]
    return q, e


def expected(q, e, rule):
    out = set()
    for q_id, q_vec, buckets, floor, k in q:
        found = []
        for e_id, e_vec, bucket in e:
            score = 0.0
            for x, y in zip(q_vec, e_vec):
                score += x * y
            if rule.bucketed and bucket not in buckets or rule.earlier and e_id >= q_id:
                continue
            if rule.floor and score < floor or rule.skip_self and e_id == q_id:
                continue
            pos = buckets.index(bucket) if rule.bucketed else 0
            found.append((-score, pos if rule.by_position else 0, e_id, score))
        for rank, (_, _, e_id, score) in enumerate(sorted(found)[: k if rule.row_k else rule.k], 1):
            out.add((q_id, e_id, rank, score))
    return out


RULES = [
    Rule(k=3),
    Rule(k=2, skip_self=True),
    Rule(row_k=True, k=1),
    Rule(k=4, bucketed=True),
    Rule(k=1, bucketed=True, earlier=True, floor=True, by_position=True),
    Rule(k=3, bucketed=True, floor=True, by_position=True, row_k=True),
]


@pytest.mark.parametrize("rule", RULES, ids=str)
@pytest.mark.parametrize("how", STRATEGIES)
def test_nearest_pairs(spark, rule, how):
    q, e = data(3, copies=how != "lookups")
    lookups = spark.createDataFrame(q, "q_id long, q_vec array<double>, q_buckets array<int>, q_floor double, q_k long")
    entries = spark.createDataFrame(e, "e_id long, e_vec array<double>, e_bucket int").repartition(3)
    options = dict(STRATEGIES[how])
    if options.get("broadcast_bytes") == "lookups":
        options["broadcast_bytes"] = 40 * (8 * 6 + 64)
        assert 90 * (8 * 6 + 16) > options["broadcast_bytes"]
    got = {(r.q_id, r.e_id, r["rank"], r.score) for r in nearest_pairs(lookups, entries, rule, **options).collect()}
    want = expected(q, e, rule)
    rounded = lambda rows: {(a, b, c, round(s, 9)) for a, b, c, s in rows}
    assert rounded(got) == rounded(want)


@pytest.mark.parametrize("limit", [pairs.BROADCAST_BYTES, 0])
def test_with_best_match_keeps_all_rows(spark, limit):
    q, e = data(4)
    rule = Rule(bucketed=True, earlier=True, floor=True, by_position=True)
    lookups = spark.createDataFrame(q, "q_id long, q_vec array<double>, q_buckets array<int>, q_floor double, note long")
    entries = spark.createDataFrame(e, "e_id long, e_vec array<double>, e_bucket int")
    rows = with_best_match(lookups, entries, rule, broadcast_bytes=limit, block_bytes=8 * 6 * 5).collect()
    assert len(rows) == len(q)
    got = {(r.q_id, r.e_id, r.score) for r in rows if r.e_id is not None}
    assert got == {(a, b, s) for a, b, _, s in expected(q, e, rule)}


def test_float_vectors_report_the_double_sum(spark):
    """Single-precision block products only preselect."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=64).astype(np.float32)
    near = [(i, (base + rng.normal(size=64).astype(np.float32) * 1e-6).astype(np.float32).tolist()) for i in range(300)]
    entries = spark.createDataFrame(near, "e_id long, e_vec array<float>")
    lookups = spark.createDataFrame([(1, base.tolist())], "q_id long, q_vec array<float>")
    got = [(r.e_id, r.score) for r in nearest_pairs(lookups, entries, Rule(k=5)).orderBy("rank").collect()]
    scores = {i: float(np.add.accumulate(base.astype(float) * np.array(v, dtype=np.float32).astype(float))[-1]) for i, v in near}
    assert got == sorted(scores.items(), key=lambda t: (-t[1], t[0]))[:5]


def test_vectors_of_different_lengths_are_an_error(spark):
    entries = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "e_id long, e_vec array<double>")
    lookups = spark.createDataFrame([(1, [1.0])], "q_id long, q_vec array<double>")
    with pytest.raises(Exception, match="one length"):
        nearest_pairs(lookups, entries, Rule()).collect()


def test_empty_sides(spark):
    entries = spark.createDataFrame([], "e_id long, e_vec array<double>")
    lookups = spark.createDataFrame([(1, [1.0])], "q_id long, q_vec array<double>")
    assert nearest_pairs(lookups, entries, Rule()).count() == 0
    assert with_best_match(lookups, entries, Rule()).count() == 1


def test_dominated_copies_are_exact():
    vectors = np.array([[1.0, 2.0]] * 5 + [[3.0, 4.0]] + [[1.0, 2.0]] * 2)
    assert pairs._dominated_copies(vectors, 2).tolist() == [False, False, True, True, True, False, True, True]


def test_lookup_join_splits_hot_keys(spark):
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 300)], "key long, v long")
    unique = spark.createDataFrame([(i, f"t{i}") for i in range(0, 300, 2)] + [(1, "t1")], "key long, t string")
    for how in ("inner", "left"):
        plain = sorted(map(str, many.join(unique, "key", how).collect()))
        assert sorted(map(str, lookup_join(many, unique, "key", how, hot_rows=50).collect())) == plain


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 3000}, {"broadcast_bytes": 0, "block_bytes": 4000}])
def test_null_and_non_finite_vectors_match_nothing(spark, limits):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    bad = [(200, [float("nan")] * 8), (201, [float("inf")] + [0.0] * 7), (202, None), (203, [None] + [1.0] * 7)]
    entries = spark.createDataFrame(good + bad, "e_id long, e_vec array<double>").repartition(3)
    lookups = spark.createDataFrame(good[:10] + bad, "q_id long, q_vec array<double>")
    alone = nearest_pairs(lookups.where("q_id < 100"), entries.where("e_id < 200"), Rule(k=5)).collect()
    both = nearest_pairs(lookups, entries, Rule(k=5), **limits).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, alone)) and len(both) == 50


def test_the_large_side_keeps_its_partitions(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_FLOPS", 100)
    many = spark.range(600).selectExpr("id as e_id", "array(sin(id), cos(id)) as e_vec").repartition(12)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "q_id long, q_vec array<double>").coalesce(1)
    sizes = pairs.measure(few, many, Rule(k=3))
    assert (sizes.lookup_parts, sizes.entry_parts) == (1, 12)
    assert sizes.tasks(sizes.entries) == 48 and sizes.tasks(sizes.lookups) == 2
    # Enough partitions for the work: no exchange above the entries.
    monkeypatch.setattr(pairs, "TASK_FLOPS", 1000)
    found = pairs._lookups_everywhere(few, pairs._spread(many, "e_id", 10, sizes.entry_parts), Rule(k=3), 3)
    assert found.rdd.getNumPartitions() == 12


def test_rows_without_key_go_around_the_join(spark):
    many = spark.range(2000).selectExpr("if(id % 2 = 0, null, 7) as k", "id as row")
    unique = spark.createDataFrame([(7, "seven"), (8, "eight")], "k long, t string")
    got = lookup_join(many, unique, "k", "left", hot_rows=100, spread_by=("row",))
    assert got.columns == ["k", "row", "t"]
    assert got.count() == 2000 and got.where("t is null").count() == 1000 and got.where("t = 'seven'").count() == 1000
    assert lookup_join(many, unique, "k", "inner", hot_rows=100).count() == 1000


def test_salts_follow_from_the_rows(spark):
    """The same rows get the same salts in any order; nothing that depends on the partition is asked."""
    many = spark.range(3000).selectExpr("1L as k", "id as row")
    unique = spark.createDataFrame([(1, "t")], "k long, t string")
    joined = lookup_join(many.repartition(7), unique, "k", hot_rows=500, spread_by=("row",))
    plan = joined._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64(row" in plan
    assert joined.count() == 3000
    small = lookup_join(many.limit(400), unique, "k", hot_rows=500)
    assert "_salt" not in small._jdf.queryExecution().toString()


@pytest.mark.parametrize("keys", [1500])
def test_any_number_of_hot_keys(spark, keys):
    many = spark.range(keys * 8).selectExpr(f"id % {keys} as k", "id as row")
    unique = spark.range(keys - 1).selectExpr("id as k", "id * 2 as v")
    got = lookup_join(many, unique, "k", "left", hot_rows=3)
    assert got.count() == keys * 8
    assert got.where("v = 2 * k").count() == (keys - 1) * 8 and got.where("v is null").count() == 8


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
@pytest.mark.parametrize("rule", [Rule(k=1), Rule(k=5), Rule(k=5, skip_self=True), Rule(k=3, earlier=True, floor=True)])
def test_strands_find_what_a_full_sort_finds(monkeypatch, rule, dtype):
    """Blocks long enough for strands, with copies and a rest; only the strands' maxima are ever partitioned."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8)).astype(dtype)
    vectors[::9] = vectors[1]
    ids, sorted_scores, plain = np.arange(700), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kw: sorted_scores.append(a.size) or plain(a, *args, **kw))
    monkeypatch.setattr(pairs, "STRAND", 16)
    monkeypatch.setattr(pairs, "TILE_ENTRIES", 350)
    floor = np.full(700, 2.0 if rule.floor else -np.inf)
    q = pairs.Lookups(ids, vectors, np.full(700, rule.k), floor, {0: (ids, np.zeros(700, np.int32))}, ids)
    found = pairs._match(q, pairs.Entries({0: (ids, vectors)}), rule, pairs.Found.none())
    assert sum(sorted_scores) <= 700 * 700 / 16
    got = {}
    for row, score, eid in zip(found.row, found.score, found.eid):
        got.setdefault(int(row), []).append((-score, int(eid)))
    for i in range(700):
        scores = pairs.exact_scores(np.repeat(vectors[i : i + 1], 700, axis=0), vectors)
        want = sorted((-s, e) for e, s in enumerate(scores) if s >= floor[i] and not (rule.skip_self and e == i) and not (rule.earlier and e >= i))
        assert sorted(got.get(i, [])) == want[: rule.k]


def test_few_tasks_answer_all_lookups(spark, monkeypatch):
    """Where the lookups are shared, each task emits up to k rows for all of them: work alone does not make tasks."""
    monkeypatch.setattr(pairs, "TASK_FLOPS", 1.0)
    rows = [(i, [float(i % 97), 1.0]) for i in range(600)]
    entries = spark.createDataFrame(rows, "e_id long, e_vec array<double>").repartition(50)
    lookups = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "q_id long, q_vec array<double>")
    emitted = []
    plain = pairs._lookups_everywhere
    monkeypatch.setattr(pairs, "_lookups_everywhere", lambda *args: emitted.append(plain(*args)) or emitted[-1])
    found = nearest_pairs(lookups, entries, Rule(k=2), broadcast_bytes=1000)
    assert {(r.q_id, r["rank"], r.e_id) for r in found.collect()} == {(q, rank, e) for q in range(5) for rank, e in ((1, 96), (2, 193))}
    assert emitted[0].count() <= 5 * 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("how", STRATEGIES)
def test_only_entries_that_share_a_bit(spark, how):
    rng = np.random.default_rng(8)
    bits = lambda: [int(rng.integers(0, 4)) << 61, int(rng.integers(0, 8))]
    q, e = data(5, copies=how != "lookups")
    q, e = [(i, v, bits()) for i, v, *_ in q], [(i, v, bits()) for i, v, *_ in e]
    lookups = spark.createDataFrame(q, "q_id long, q_vec array<double>, q_sets array<long>")
    entries = spark.createDataFrame(e, "e_id long, e_vec array<double>, e_sets array<long>").repartition(3)
    options = {"broadcast_bytes": 40 * (8 * 8 + 64)} if how == "lookups" else STRATEGIES[how]
    want = set()
    for q_id, q_vec, own in q:
        scores = [(-sum(x * y for x, y in zip(q_vec, v)), i) for i, v, other in e if i != q_id and (own[0] & other[0] or own[1] & other[1])]
        want |= {(q_id, i, rank, round(-s, 9)) for rank, (s, i) in enumerate(sorted(scores)[:3], 1)}
    found = nearest_pairs(lookups, entries, Rule(k=3, skip_self=True, sets=True), **options).collect()
    assert {(r.q_id, r.e_id, r["rank"], round(r.score, 9)) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("share", [0.9, 0.02])
def test_shared_bits_in_long_blocks(monkeypatch, share):
    """Tiles after the first are held against the bar of what was found; lookups that share bits with fewer than k have none."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(900, 8)).astype(np.float32)
    vectors[::7] = vectors[1]
    member = rng.random((900, 70)) < 1 - (1 - share) ** 0.5
    sets = np.zeros((900, 2), np.int64)
    for bit in range(70):
        sets[member[:, bit], bit // 64] |= np.int64(1 << (bit % 64)) if bit % 64 < 63 else np.int64(-(1 << 63))
    sets[::50] = 0
    monkeypatch.setattr(pairs, "FIRST_ENTRIES", 100)
    monkeypatch.setattr(pairs, "TILE_ENTRIES", 300)
    assert pairs._growing_starts(900) == [0, 100, 300, 600]
    rule, ids = Rule(k=4, skip_self=True, sets=True), np.arange(900)
    q = pairs.Lookups(ids, vectors, np.full(900, 4), np.full(900, -np.inf), {0: (ids, np.zeros(900, np.int32))}, ids, sets)
    found = pairs._match(q, pairs.Entries({0: (ids, vectors)}, {0: sets}), rule, pairs.Found.none())
    got = {}
    for row, score, eid in zip(found.row, found.score, found.eid):
        got.setdefault(int(row), []).append((-score, int(eid)))
    for i in range(900):
        scores = pairs.exact_scores(np.repeat(vectors[i : i + 1], 900, axis=0), vectors)
        want = sorted((-s, e) for e, s in enumerate(scores) if e != i and (sets[i] & sets[e]).any())
        assert sorted(got.get(i, [])) == want[:4]


def test_copies_with_other_bits_are_kept():
    """An entry is left out for copies only if they share bits with the same lookups."""
    import pyarrow as pa

    table = pa.table({"e_id": range(12), "e_vec": [[1.0, 2.0]] * 12, "e_sets": [[1]] * 5 + [[2]] * 7})
    entries = pairs.Entries.of(table, Rule(k=2, sets=True), 2)
    assert entries.groups[0][0].tolist() == [0, 1, 5, 6] and entries.sets[0].ravel().tolist() == [1, 1, 2, 2]
