import numpy as np
import pytest
from pyspark.sql import functions as F

from softseek.llm import ann
from softseek.llm.queries import op2_projected_neighbours


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        s = (x * np.array(v, float)).sum(axis=1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(ann.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_query_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in vectors]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in op2_projected_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert all(s == dict(brute(rows, [(q, dict(rows)[q])], len(rows))[q])[i] for q, v in list(got.items())[:3] for i, s in v)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("cell_rows", [30, 10_000])
def test_copies_ties_and_refused_vectors(spark, cell_rows):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(200, 300)]  # a hot vector
    rows += [(i, (np.array(rows[1][1]) * 3).tolist()) for i in range(300, 310)]  # of other lengths
    bad = [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] + [1.0] * 5), (404, [float("inf")] + [1.0] * 5),
           (405, [1.0, 2.0]), (None, [1.0] * 6), (406, [])]
    frame = spark.createDataFrame(rows + bad + rows[:25] * 2, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    queries = frame.where("vec_id % 10 = 0 or vec_id > 390").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ann.nearest(frame, queries, k=5, cell_rows=cell_rows, confidence=0.9999, dimensions=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want


def test_few_and_none(spark):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(two, two.withColumnRenamed("vec_id", "query_id"), k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(1, 1, 2), (2, 1, 1)]
    empty = two.limit(0)
    assert ann.nearest(empty, empty.withColumnRenamed("vec_id", "query_id")).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-170])
def test_very_long_and_short_vectors_take_part(spark, size):
    """One vector, or all, whose squares leave the range of doubles."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    x[7] = [size, *([0.0] * 7)] if size > 1 else x[7]
    x = x if size > 1 else x * size
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    queries = table.where("vec_id % 10 in (0, 7)").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in ann.nearest(table, queries, k=3, cell_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 40
    found = 0
    for q, rows in got.items():
        scores = (x[q] * x).sum(axis=1)
        assert [r for r, _, _ in sorted(rows)] == [1, 2, 3] and all(s == pytest.approx(scores[i], rel=1e-12) for _, i, s in rows)
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:3]
        found += len({i for _, i in best} & {i for _, i, _ in rows})
    assert found >= 0.95 * 120
