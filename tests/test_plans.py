import numpy as np
import pytest
from pyspark.sql import functions as F

from softseek.operators import cache
from softseek.plans import answer, evaluate
from softseek.sources.models import ClusterModel

MODEL = ClusterModel(None, np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), 2.0)
VECTORS = {"sun": [0.8, 0.6, 0.0], "sea": [0.6, 0.8, 0.0], "fog": [0.0, 0.6, 0.8]}


def index(spark):
    rows = [(i, VECTORS[n], f"cat.{n}", f"s {n}" if n != "sea" else None, f"text of {n}") for i, n in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "point_id long, embedding array<double>, category string, subject string, text string")


def queries(spark, rows):
    rows = [(i, text, VECTORS[text.strip()] if text.strip() else VECTORS["sun"], k) for i, (text, k) in enumerate(rows)]
    return spark.createDataFrame(rows, "seq long, query string, embedding array<double>, top_k int")


def test_validation(spark):
    rows = answer.validate_queries(queries(spark, [(" sun\n", None), ("  \t", 3), ("", None), ("fog", 2)])).collect()
    assert [(r.query, r.top_k, r.reject_reason is None) for r in rows] == [
        ("sun", 5, True), ("", 3, False), ("", 5, False), ("fog", 2, True)
    ]


def test_answers(spark):
    log = queries(spark, [("sun", 1), (" ", 1), ("sun ", 3), ("fog", 2), ("sea", 1)])
    got = {r.seq: r for r in answer.answer_queries(log, index(spark), MODEL, 0.99).collect()}
    assert got.keys() == {0, 2, 3, 4}
    assert (got[0].cache_hit, got[0].matched_query, got[0].similarity_score) == (False, None, None)
    assert got[0].result == "[1] category=cat.sun | score=1.0000\n    subject: s sun\n    excerpt: text of sun"
    # a repeated query hits with score 1 and returns the text computed for the first one's top_k
    assert (got[2].cache_hit, got[2].matched_query, got[2].similarity_score, got[2].top_k) == (True, "sun", 1.0, 1)
    assert got[2].result == got[0].result
    assert got[3].result.count("[") == 2 and "subject: \n" in got[4].result
    loose = {r.seq: r for r in answer.answer_queries(log, index(spark), MODEL, 0.9).collect()}
    assert loose[4].cache_hit and loose[4].matched_query == "sun" and loose[4].similarity_score == 0.96


def test_answers_from_an_earlier_cache(spark):
    entries = spark.createDataFrame(
        [(-1, "old sun", VECTORS["sun"], 0, 7, "old text")],
        "seq long, query string, embedding array<double>, cluster_id int, top_k int, result string",
    )
    row = answer.answer_queries(queries(spark, [("sun", 1)]), index(spark), MODEL, 0.9, entries).head()
    assert (row.cache_hit, row.matched_query, row.result, row.top_k) == (True, "old sun", "old text", 7)
    assert answer.service_summary(entries).head().asDict() == {"status": "ok", "cache_entries": 1, "threshold": 0.8}


def test_a_cache_that_matches_every_query_stores_none(spark):
    """Queries nearer to each other than to the entry: all of them hit the entry, and none is lost."""
    entries = spark.createDataFrame(
        [(-1, "old sun", VECTORS["sun"], 0, 7, "old text")],
        "seq long, query string, embedding array<double>, cluster_id int, top_k int, result string",
    )
    log = queries(spark, [("sea", 1), ("sea", 2), ("sea", 3)])
    got = {r.seq: r for r in answer.answer_queries(log, index(spark), MODEL, 0.9, entries).collect()}
    assert got.keys() == {0, 1, 2}
    assert {(r.cache_hit, r.matched_query, r.similarity_score, r.result) for r in got.values()} == {(True, "old sun", 0.96, "old text")}


def test_search_quality(spark):
    rows = [(0, VECTORS["sun"], "cat.sun"), (1, VECTORS["fog"], "sea"), (2, VECTORS["sea"], "nothing"), (3, VECTORS["sun"], "the cat.sea is wide")]
    labelled = spark.createDataFrame(rows, "query_id long, embedding array<double>, expected_category string")
    ranks = evaluate.first_relevant_rank(labelled, index(spark), 2)
    assert {r.query_id: r.found_at for r in ranks.collect()} == {0: 1, 1: 2, 2: None, 3: 2}
    hits = evaluate.hit_at_k(ranks).head()
    assert (hits.n_queries, hits.hit_at_1, hits.hit_at_3, hits.hit_at_5) == (4, 0.25, 0.75, 0.75)
    assert evaluate.mean_reciprocal_rank(ranks).head().mrr == 0.5
    bare = index(spark).withColumn("category", F.lit(None).cast("string"))
    assert {r.found_at for r in evaluate.first_relevant_rank(labelled, bare, 2).collect()} == {1}


def features(spark):
    rows = [("p1", "paraphrase", 0.9, True), ("p2", "paraphrase", 0.85, False), ("p3", "paraphrase", 0.72, True), ("p4", "paraphrase", 0.2, True),
            ("u1", "unrelated", 0.78, True), ("u2", "unrelated", 0.1, True)]
    return spark.createDataFrame(rows, "pair_id string, kind string, raw_sim double, routed boolean")


def test_pairs_against_a_fresh_cache(spark):
    q = cache.with_clusters(MODEL.memberships(spark.createDataFrame(
        [(i, v) for i, v in enumerate(VECTORS.values())], "query_id long, embedding array<double>")))
    pairs = spark.createDataFrame([(0, "paraphrase", 0, 1), (1, "unrelated", 0, 2)], "pair_id long, kind string, q1 long, q2 long")
    got = {r.pair_id: r for r in evaluate.pair_features(pairs, q).collect()}
    assert got[0].raw_sim == pytest.approx(0.96) and got[0].routed
    assert got[1].raw_sim == pytest.approx(0.36) and not got[1].routed


def test_rates_and_sweep(spark):
    outcomes = evaluate.pair_outcomes(features(spark), 0.8)
    rates = {r.kind: (r.pairs, r.hit_rate, r.routing_misses) for r in evaluate.pair_rates(outcomes).collect()}
    assert rates == {"paraphrase": (4, 0.25, 1), "unrelated": (2, 0.0, 0)}
    sweep = {r.threshold: r for r in evaluate.threshold_sweep(features(spark)).collect()}
    assert len(sweep) == 6
    assert (sweep[0.70].true_positive_rate, sweep[0.70].false_positive_rate, sweep[0.70].precision) == (0.5, 0.5, 0.5)
    assert sweep[0.70].f1 == 0.5
    assert (sweep[0.80].precision, sweep[0.80].f1) == (1.0, pytest.approx(0.4))
    assert (sweep[0.95].precision, sweep[0.95].f1) == (1.0, 0.0)
    assert evaluate.best_threshold(evaluate.threshold_sweep(features(spark))).head().threshold == 0.70


@pytest.mark.parametrize("n", [2, 4, 5, 37, 400])
def test_latency(spark, n):
    values = [float((i * 7919) % 101) for i in range(n)]
    log = spark.createDataFrame(list(enumerate(values)), "seq long, latency double").repartition(6)
    row = evaluate.latency_summary(log).head()
    rest = values[3:]
    assert row.measured == len(rest)
    if rest:
        assert row.avg_latency == pytest.approx(np.mean(rest)) and row.p95_latency == pytest.approx(np.percentile(rest, 95))
    else:
        assert row.avg_latency is None and row.p95_latency is None


def test_report_is_one_row(spark):
    labelled = spark.createDataFrame([(0, VECTORS["sun"], "cat.sun")], "query_id long, embedding array<double>, expected_category string")
    log = spark.createDataFrame([(i, float(i)) for i in range(9)], "seq long, latency double")
    rows = evaluate.evaluation_report(evaluate.first_relevant_rank(labelled, index(spark)), features(spark), log).collect()
    assert len(rows) == 1 and rows[0].hit_at_1 == 1.0 and rows[0].best_threshold == 0.70


def test_latency_by_stage(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, stage, None if rng.random() < 0.05 else float(x)) for i in range(4000) for stage, x in
            (("embed", rng.lognormal()), ("lookup", rng.integers(3)), ("search", 7.0), (None, i))]
    log = spark.createDataFrame(rows, "seq long, step string, latency double").repartition(7)
    for accuracy in (evaluate.SKETCH_ACCURACY, 50, 2):  # a coarse sketch, and one whose bracket may miss
        monkeypatch.setattr(evaluate, "SKETCH_ACCURACY", accuracy)
        made = evaluate.latency_summary(log, stage="step")
        got = {r.stage: r for r in made.collect()}
        assert got.keys() == {"embed", "lookup", "search", None}
        for stage, r in got.items():
            rest = [x for i, s, x in rows if s == stage and i >= 3 and x is not None]
            assert r.measured == len(rest) and r.avg_latency == pytest.approx(np.mean(rest)) and r.p95_latency == pytest.approx(np.percentile(rest, 95))


def test_latency_is_not_sorted_as_a_whole(spark):
    log = spark.range(100_000).selectExpr("id as seq", "cast(hash(id) as double) as latency")
    plan = evaluate.latency_summary(log)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
