import pytest
from pyspark.sql import functions as F

from softseek.operators import clean, embed
from softseek.operators.ordering import dense_index, range_parts
from softseek.session import materialize, scratch_dir
from softseek.sources import docs, index, posts


def test_read_posts(spark, tmp_path):
    """Spark's file sources leave out files without any byte, so there is none here."""
    files = {
        "b/1": b"Subject: x\r\n\r\nline\rnext",
        "a/2": "café".encode(),
        "a/1": b"bad \xff\xfe \xe2\x82 end",
        "a/nested/deep": b"skipped",
        "loose": b"skipped",
        "b b/3": b"space",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    got = {(r.category, r.doc_id): r.raw for r in posts.read_posts(spark, str(tmp_path)).collect()}
    want = {
        tuple(n.split("/")): c.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        for n, c in files.items() if n.count("/") == 1
    }
    assert got == want


def test_unreadable_files_are_rows_without_text(spark, tmp_path):
    words = " ".join(["word"] * 30)
    spark.createDataFrame([(f"Subject: s\n\n{words} {i}", "c") for i in range(4)], "value string, category string").repartition(4).write.partitionBy(
        "category"
    ).text(str(tmp_path / "posts"))
    files = sorted((tmp_path / "posts" / "category=c").glob("part-*.txt"))
    assert len(files) == 4
    # The checksum beside the file does not fit any more: reading it is an error.
    files[0].write_bytes(files[0].read_bytes().replace(b"word", b"WORD"))
    read = posts.read_posts(spark, str(tmp_path / "posts"))
    rows = {r.doc_id: r.raw for r in read.collect()}
    assert rows.keys() == {f.name for f in files}
    assert [name for name, raw in rows.items() if raw is None] == [files[0].name]
    report = clean.cleaning_report(clean.classify_docs(read)).where("is_total").head()
    assert (report.total, report.kept, report.dropped_read_error) == (4, 3, 1)


def test_docs_round_trip(spark, tmp_path):
    rows = [("1", "c", ["a", "a"], True, None, "café \"q\"\n", 3), ("1", "d", [], False, "s", "t", 1)]
    df = spark.createDataFrame(rows, docs.DOC_SCHEMA)
    path = str(tmp_path / "docs")
    docs.write_docs(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert any('"subject":null' in x and "café" in x for x in lines)
    assert sorted(map(str, docs.read_docs(spark, path).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "blank.json").write_text('\n{"doc_id": "x"}\n\n')
    assert docs.read_docs(spark, str(tmp_path / "blank.json")).count() == 1
    (tmp_path / "bad.json").write_text('{"doc_id": "x"\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        docs.read_docs(spark, str(tmp_path / "bad.json")).collect()


def test_point_ids_follow_the_order(spark):
    rows = [(f"c{i % 3}", f"{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "category string, doc_id string").repartition(7)
    ids = embed.assign_point_ids(df).orderBy("point_id").collect()
    assert [r.point_id for r in ids] == list(range(200))
    assert [(r.category, r.doc_id) for r in ids] == sorted(rows)


def test_equal_values_do_not_share_a_range(spark):
    """Ties are broken by a second column, so a frequent value spreads over partitions."""
    df = spark.range(4000).select(F.lit(1.0).alias("x"), "id").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep tiny partitions apart
    try:
        sizes = [r["count"] for r in range_parts(df, "x", "id").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2000
    assert dense_index(df, "x", "id", name="n").where("n <> id").count() == 0


def test_build_index_upsert_and_scan(spark, tmp_path):
    text = "one two three four five six seven eight nine ten " * 3
    raw = [("c", str(i), f"Subject: s{i}\nNewsgroups: g\n\n{text}{'word%d ' % i * (i + 1)}") for i in range(6)]
    kept = clean.preprocess(spark.createDataFrame(raw, "category string, doc_id string, raw string"))
    built = embed.build_index(kept, embed.fit_text_model(kept))
    path = str(tmp_path / "index")
    index.write_index(built, path)
    index.write_index(built, path)  # a rebuild replaces
    scan = index.scan_index(spark, path, ["point_id", "embedding"])
    assert scan.columns == ["point_id", "embedding"] and scan.count() == 6
    lengths = scan.select(F.expr("sqrt(aggregate(embedding, 0D, (a, x) -> a + x * x))").alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-5 for r in lengths)
    info = index.index_info(scan, 7).head()
    assert (info.points_count, info.expected, info.matches) == (6, 7, False)
    base = built.select("point_id", "category")
    delta = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (9, "added", 1)], "point_id long, category string, v int")
    merged = {r.point_id: r.category for r in index.upsert_index(base, delta, "v").collect()}
    assert merged == {0: "c", 1: "c", 2: "new", 3: "c", 4: "c", 5: "c", 9: "added"}


def test_clustered_index_prunes_partitions(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("point_id"), (F.col("id") % 4).cast("int").alias("dominant_cluster"))
    path = str(tmp_path / "index")
    index.write_index(df, path, by_cluster=True)
    scan = index.scan_index(spark, path).where("dominant_cluster = 2")
    assert scan.count() == 25
    assert "PartitionFilters: [isnotnull(dominant_cluster" in scan._jdf.queryExecution().executedPlan().toString()


def test_truncation_and_predictor(spark):
    seen = spark.createDataFrame([("\U0001f600" * 4100,), ("ab",), ("",)], "text string")

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] if t else [0.0, 0.0] for t in texts])

    got = [r.embedding for r in embed.embed_texts(seen, load, batch_size=2).collect()]
    assert got[0] == pytest.approx([4000 / (4000**2 + 1) ** 0.5, 1 / (4000**2 + 1) ** 0.5])
    assert got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got[2] == [0.0, 0.0]


def test_materialized_table_has_no_lineage(spark):
    table = materialize(spark.range(10).withColumn("x", F.rand()), "t")
    assert table.inputFiles()[0].split("//")[-1].lstrip("/").startswith(scratch_dir(spark).split("//")[-1].lstrip("/").lstrip("file:"))
    assert table.orderBy("id").collect() == table.orderBy("id").collect()


def test_merge_touches_only_its_clusters(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, [float(i)], f"c{i}", i % 5) for i in range(200)]
    schema = "point_id long, embedding array<double>, category string, dominant_cluster int"
    index.write_index(spark.createDataFrame(rows, schema), path, by_cluster=True)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "index").glob("dominant_cluster=*/*.parquet")}

    before = files()
    # 1 stays in its cluster, 2 moves to cluster 1, 500 is new; of the two rows for 1 the later one counts
    delta = spark.createDataFrame([(1, [0.5], "old", 1, 1), (1, [0.7], "new", 1, 2), (2, [0.1], "moved", 1, 1), (500, [9.0], "added", 1, 1)], f"{schema}, v int")
    assert index.merge_index(spark, path, delta, "v") == [1, 2]
    got = {r.point_id: (r.category, r.dominant_cluster) for r in spark.read.parquet(path).collect()}
    want = {i: (c, k) for i, _, c, k in rows} | {1: ("new", 1), 2: ("moved", 1), 500: ("added", 1)}
    assert got == want
    after = files()
    kept = [f for f in before if "dominant_cluster=1/" not in str(f) and "dominant_cluster=2/" not in str(f)]
    assert kept and all(after.get(f) == before[f] for f in kept)
    # a cluster whose points have all moved leaves no folder
    move = spark.read.parquet(path).where("dominant_cluster = 4").withColumn("dominant_cluster", F.lit(0))
    assert index.merge_index(spark, path, materialize(move, "move")) == [0, 4]
    assert not (tmp_path / "index" / "dominant_cluster=4").exists() and spark.read.parquet(path).count() == 201
    assert index.merge_index(spark, path, move.limit(0)) == []


def test_the_last_row_of_an_id_is_chosen_narrowly(spark):
    rows = [(7, "x" * 1000, i) for i in range(300)] + [(7, "tie", 299), (8, "same", 1), (8, "same", 1), (9, None, None)]
    delta = spark.createDataFrame(rows, "point_id long, text string, v int")
    got = {r.point_id: (r.text, r.v) for r in index.latest_rows(delta, "v").collect()}
    assert got.keys() == {7, 8, 9} and got[7][1] == 299 and got[8] == ("same", 1) and got[9] == (None, None)
    assert index.latest_rows(delta, "v").count() == 3
    plan = index.latest_rows(delta, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan


def test_posts_are_written_without_a_committer_and_opened_once(spark, tmp_path):
    """Names and contents are those of Spark's text writer, and reading keeps the texts of one pass."""
    from registry import inputs

    values = ["plain", "a/b=c %", "[x]^{y}", None, ""]
    rows = [(values[i % 5], None if i == 7 else f"text {i}\r\nline") for i in range(40)]
    df = spark.createDataFrame(rows, "category string, raw string").repartition(3)
    inputs.write_posts(df, str(tmp_path / "own"))
    df.withColumnRenamed("raw", "value").write.option("maxRecordsPerFile", 1).partitionBy("category").text(str(tmp_path / "spark"))

    def files(root):
        return sorted((f.parent.name, f.read_bytes()) for f in (tmp_path / root).glob("*/part-*.txt"))

    assert files("own") == files("spark") and len(files("own")) == 40
    assert not [f for f in (tmp_path / "own").rglob("*") if f.name.startswith((".", "_"))]
    read = posts.read_posts(spark, str(tmp_path / "own"))
    for f in (tmp_path / "own").glob("*/part-*.txt"):
        f.unlink()
    assert sorted(r.raw for r in read.collect()) == sorted("\n" if i == 7 else f"text {i}\nline\n" for i in range(40))
