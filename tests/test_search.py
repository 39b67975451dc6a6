import re

from pyspark.sql import functions as F

from registry import inputs as src
from softseek.operators import search
from softseek.operators.cache import with_clusters
from softseek.operators.clusters import fcm_memberships
from softseek.sources.index import scan_index, write_index


def blocks(spark, rows):
    df = spark.createDataFrame(rows, "query_id long, rank int, category string, score double, subject string, text string")
    queries = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id long")
    return {r.query_id: r.result for r in search.format_results(queries, df).collect()}


def test_format(spark):
    got = blocks(
        spark,
        [
            (1, 2, "b", 0.03125, None, "y" * 301),
            (1, 1, None, 0.00015, "s", " a\nb "),
            (2, 1, "c", 1.0, "", "z" * 300),
        ],
    )
    assert got[1] == (
        "[1] category=unknown | score=0.0001\n    subject: s\n    excerpt: a b\n\n"
        "[2] category=b | score=0.0312\n    subject: \n    excerpt: " + "y" * 300 + "..."
    )
    assert got[2].endswith("excerpt: " + "z" * 300)
    assert got[3] == "No relevant documents found."


def test_search_reads_only_vectors_before_the_hits(spark, sf):
    points = src.embeddings(spark, sf)
    hits = search.topk_search(src.as_queries(points), points, 5)
    assert hits.count() == 5 * points.count()
    first = hits.where("rank = 1")
    assert first.where("query_id = point_id").count() == points.count()


def test_pruned_search_recall(spark, sf):
    """With all clusters probed it is exact; with two it finds part of the exact result."""
    centers = src.centers(spark, sf)
    points = with_clusters(fcm_memberships(src.embeddings(spark, sf), centers, 1.1), 2)
    queries = src.as_queries(points)
    exact = search.topk_search(queries, points, 5).select("query_id", "point_id")
    everywhere = queries.withColumn("top_clusters", F.expr("sequence(0, 9)"))
    full = search.pruned_search(everywhere, points, 5).select("query_id", "point_id")
    assert full.exceptAll(exact).count() == 0 and full.count() == exact.count()
    recall = search.pruned_search(queries, points, 5).join(exact, ["query_id", "point_id"]).count() / exact.count()
    assert 0.3 < recall < 1.0


def test_neighbors_and_graph(spark, sf):
    points = src.embeddings(spark, sf)
    some = points.where("point_id in (3, 4)").select("point_id")
    near = search.neighbors(points, some, 3).collect()
    assert len(near) == 8 and all(r.point_id == r.query_id for r in near if r["rank"] == 1)
    graph = search.knn_graph(points, 15)
    assert graph.count() == 15 * points.count() and graph.where("point_id = neighbor_id").count() == 0


def test_pruned_search_skips_partitions(spark, sf, tmp_path):
    points = with_clusters(fcm_memberships(src.embeddings(spark, sf), src.centers(spark, sf), 1.1), 2)
    path = str(tmp_path / "index")
    write_index(points, path, by_cluster=True)
    one = src.as_queries(points.where("point_id = 5"))
    stored = scan_index(spark, path)
    found = search.pruned_search(one, stored, 5)
    asked = one.head().top_clusters
    assert found.count() == 5 and {r.dominant_cluster for r in found.collect()} <= set(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dominant_cluster#\d+ IN", plan)


def test_search_scans_id_and_vector_only(spark, sf):
    """The pass over the index reads no payload."""
    points = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", "label")
    hits = search.topk_search(points.withColumnRenamed("point_id", "query_id"), points, 5, payload=False)
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in hits._jdf.queryExecution().executedPlan().toString()
