import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry import inputs as src
from softseek.functions import vectors as vx
from softseek.operators import clusters
from softseek.plans.train import train_clusters
from softseek.sources.models import ClusterModel, load_cluster_model, read_assignments, save_cluster_model, write_assignments


def blobs(spark, seed=1, k=3, n=240, d=4, parts=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d)) * 6
    rows = [(i, (centers[i % k] + rng.normal(size=d) * 0.3).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "point_id long, embedding array<double>").repartition(parts), np.array([r[1] for r in rows])


def weights(spark, vector, centers):
    df = spark.createDataFrame([(vector,)], "embedding array<double>")
    return clusters.fcm_memberships(df, np.array(centers)).head().memberships


def test_membership_formula_and_centre_rows(spark):
    u = weights(spark, [0.0, 0.0], [[1.0, 0.0], [0.0, 2.0]])
    assert u == pytest.approx([0.8, 0.2])
    assert weights(spark, [1.0, 0.0], [[1.0, 0.0], [0.0, 2.0]]) == [1.0, 0.0]
    # on two equal centres: both 1, not normalised
    assert weights(spark, [1.0, 0.0], [[1.0, 0.0], [1.0, 0.0], [5.0, 5.0]]) == [1.0, 1.0, 0.0]


def test_ties_between_clusters(spark):
    df = spark.createDataFrame([([0.3, 0.3, 0.3],), ([0.2, 0.4, 0.4],), ([0.5, 0.5],)], "u array<double>")
    got = df.select(vx.top_clusters(F.col("u"), 2).alias("t"), vx.dominant_cluster(F.col("u")).alias("d")).collect()
    # a three-way tie puts the dominant cluster outside the searched two
    assert [(r.t, r.d) for r in got] == [([2, 1], 0), ([2, 1], 1), ([1, 0], 0)]
    one = df.select(vx.top_clusters(F.col("u"), 5).alias("t")).collect()[2]
    assert one.t == [1, 0]


def reference_fit(x, u, m, error, max_iter):
    for step in range(1, max_iter + 1):
        um = u**m
        centers = um.T @ x / um.sum(axis=0)[:, None]
        new = clusters.membership_matrix(x, centers, m)
        done = np.linalg.norm(new - u) < error
        u = new
        if done:
            break
    return centers, step


def test_fit_equals_one_machine(spark):
    df, x = blobs(spark)
    start = df.select("point_id", clusters.start_memberships(F.col("point_id"), 3, 42).alias("s")).orderBy("point_id").collect()
    u0 = np.array([r.s for r in start])
    assert u0.sum(axis=1) == pytest.approx(np.ones(len(x)))
    centers, steps = reference_fit(x, u0, 2.0, 0.005, 1000)
    model = clusters.fcm_fit(df, 3)
    assert model.iterations == steps and model.centers == pytest.approx(centers, abs=1e-9)
    assert all(b <= a + 1e-9 for a, b in zip(model.objective, model.objective[1:]))
    again = clusters.fcm_fit(df.repartition(2), 3)
    assert again.centers == pytest.approx(model.centers, abs=1e-9)
    fpc = clusters.fuzzy_partition_coefficient(clusters.fcm_memberships(df, model.centers)).head().fpc
    assert 1 / 3 <= fpc <= 1


def test_silhouette(spark):
    rows = [(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [11.0], 1), (4, [50.0], 2)]
    df = spark.createDataFrame(rows, "point_id long, embedding array<double>, dominant_cluster int")
    s = [(10.5 - 1) / 10.5, (9.5 - 1) / 9.5, (9.5 - 1) / 9.5, (10.5 - 1) / 10.5, 0.0]
    assert clusters.silhouette(df) == pytest.approx(sum(s) / 5)
    with pytest.raises(ValueError, match="labels"):
        clusters.silhouette(df.withColumn("dominant_cluster", F.lit(0)))


def test_sample_is_the_lowest_hashes(spark):
    rows = spark.range(5000).select(F.xxhash64("id", F.lit(1)).alias("order"), "id").repartition(4)
    for n in (10, 900, 4000):
        want = [r.id for r in rows.orderBy("order", "id").limit(n).collect()]
        assert [r.id for r in clusters._lowest(rows, n).collect()] == want


def test_sweep_finds_the_blobs(spark):
    df, _ = blobs(spark)
    scores = clusters.sweep_k(df, range(2, 6))
    assert clusters.best_k(scores) == 3
    # k above the number of rows cannot be scored; all failing means the smallest k
    two = df.where("point_id < 2")
    assert clusters.best_k(clusters.sweep_k(two, range(4, 6))) == 4


def test_reduction_is_repeatable(spark, sf):
    points = src.embeddings(spark, sf)
    model = clusters.fit_reducer(points, 8)
    variance = model.explainedVariance.toArray()
    assert len(variance) == 8 and (np.diff(variance) <= 1e-12).all()
    one = points.where("point_id = 7")
    whole = clusters.reduce_dims(points, model).where("point_id = 7").head().reduced
    assert clusters.reduce_dims(one, model).head().reduced == pytest.approx(whole)


def test_profiles(spark):
    rows = [(0, "a", [0.9, 0.1]), (1, "b", [0.8, 0.2]), (2, "b", [0.5, 0.5]), (3, "a", [0.7, 0.3]), (4, "c", [0.1, 0.9])]
    df = spark.createDataFrame(rows, "point_id long, category string, memberships array<double>").withColumn(
        "doc_id", F.col("point_id").cast("string")
    )
    profile = {r.cluster_id: r for r in clusters.cluster_profile(df).collect()}
    assert profile.keys() == {0, 1}
    assert (profile[0].docs, profile[0].boundary_docs, profile[1].boundary_docs) == (4, 3, 0)
    assert profile[0].avg_confidence == pytest.approx((0.9 + 0.8 + 0.5 + 0.7) / 4)
    top = clusters.top_categories(df, 1).where("cluster_id = 0").head()
    assert (top.category, top.docs, top.percent) == ("a", 2, 50.0)  # tie with b: a has the lowest id
    summary = clusters.boundary_summary(df).head()
    assert (summary.boundary_docs, summary.docs, summary.percent) == (3, 5, 60.0)
    entropy = df.select(vx.membership_entropy(F.col("memberships")).alias("h")).collect()[2].h
    assert entropy == pytest.approx(math.log(2), abs=1e-6)


def test_model_round_trip(spark, sf, tmp_path):
    points = src.embeddings(spark, sf)
    model = train_clusters(points, n_components=5, ks=range(2, 4), m=1.5)
    path = str(tmp_path / "model")
    save_cluster_model(spark, model, path)
    loaded = load_cluster_model(spark, path)
    assert loaded.centers == pytest.approx(model.centers) and loaded.m == 1.5
    assert loaded.scores.count() == 2
    some = points.where("point_id < 20").orderBy("point_id")
    before = [r.memberships for r in model.memberships(some).collect()]
    after = [r.memberships for r in loaded.memberships(some).collect()]
    assert np.array(after) == pytest.approx(np.array(before))
    assert np.array(after).sum(axis=1) == pytest.approx(np.ones(20))
    save_cluster_model(spark, ClusterModel(None, model.centers, 2.0), str(tmp_path / "bare"))
    assert load_cluster_model(spark, str(tmp_path / "bare")).reducer is None
    with pytest.raises(FileNotFoundError, match="no cluster model"):
        load_cluster_model(spark, str(tmp_path / "nothing"))


def test_assignments_round_trip(spark, sf, tmp_path):
    df = src.weighted(spark, sf).withColumn("doc_id", F.col("point_id").cast("string"))
    for fmt in ("parquet", "json"):
        write_assignments(df, str(tmp_path / fmt), fmt)
        back = read_assignments(spark, str(tmp_path / fmt), fmt)
        assert back.exceptAll(clusters.assignments(df)).count() == 0 and back.count() == df.count()


def test_vectors_that_cannot_be_compared_teach_nothing(spark):
    df, _ = blobs(spark)
    odd = [(1000, None), (1001, [float("nan"), 1.0, 1.0, 1.0]), (1002, [float("inf"), 0.0, 0.0, 0.0]), (1003, [None, 1.0, 1.0, 1.0])]
    with_odd = df.unionByName(spark.createDataFrame(odd, df.schema)).repartition(3)
    clean, mixed = clusters.fcm_fit(df, 3), clusters.fcm_fit(with_odd, 3)
    assert mixed.iterations == clean.iterations and np.allclose(mixed.centers, clean.centers) and np.isfinite(mixed.centers).all()
    shown = {r.point_id: r.memberships for r in clusters.fcm_memberships(with_odd, mixed.centers).collect()}
    assert all(shown[i] is None for i, _ in odd) and all(len(shown[i]) == 3 for i in range(240))
    sweep = clusters.sweep_k(with_odd, [2, 3, 4]).collect()
    assert sorted(map(str, sweep)) == sorted(map(str, clusters.sweep_k(df, [2, 3, 4]).collect()))
    with pytest.raises(ValueError, match="no vectors"):
        clusters.fcm_fit(with_odd.where("point_id >= 1000"), 2)


def test_fits_together_scan_as_often_as_the_slowest(spark, monkeypatch):
    df, _ = blobs(spark)
    alone = [clusters.fcm_fit(df, k, max_iter=60) for k in (2, 3, 5)]
    passes, plain = [], clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda points, fits, *a: passes.append(len(fits)) or plain(points, fits, *a))
    together = clusters.fcm_fits(df, (2, 3, 5), max_iter=60)
    assert [t.iterations for t in together] == [a.iterations for a in alone]
    assert all(np.allclose(t.centers, a.centers) and np.allclose(t.objective, a.objective) for t, a in zip(together, alone))
    assert len(passes) == 1 + max(a.iterations for a in alone) and passes == sorted(passes, reverse=True)
