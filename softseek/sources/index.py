"""The document index: a Parquet table of vectors and payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from softseek.operators.joins import lookup_join
from softseek.session import materialize


def write_index(df: DataFrame, path: str, by_cluster: bool = False) -> None:
    """Rebuild the index; ``by_cluster`` partitions it for searches inside a few clusters.

    Large clusters are spread over many files: rows are dealt out by cluster and id, not by cluster.
    """
    if not by_cluster:
        df.write.mode("overwrite").parquet(path)
        return
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(n, "dominant_cluster", F.pmod(F.xxhash64("point_id"), F.lit(n)))
    spread.write.mode("overwrite").partitionBy("dominant_cluster").parquet(path)


def scan_index(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if cols is None else df.select(*cols)


def latest_rows(delta: DataFrame, order: str | Column | None = None) -> DataFrame:
    """One row per point id: the last by ``order``; without an order an id that comes twice is an error.

    The choice is made among ids, orders and row hashes alone, in an aggregation with map-side combining;
    whole rows are fetched for the winners. Of rows with the same order the one of largest hash wins.
    """
    if order is None:
        twice = delta.groupBy("point_id").count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"point {twice[0]['point_id']} comes more than once: give an order")
        return delta
    # Maps have no hash; as text they have.
    plain = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in delta.schema.fields]
    ordered = delta.withColumn("_top", F.struct(F.col(order) if isinstance(order, str) else order, F.xxhash64(*plain)))
    best = ordered.groupBy("point_id").agg(F.max("_top").alias("_best"))
    held = ordered.groupBy("point_id", "_top").count().where("count > 1")
    chosen = lookup_join(ordered, best, "point_id").where(F.col("_top").eqNullSafe(F.col("_best")))
    chosen = chosen if held.isEmpty() else chosen.dropDuplicates(["point_id"])
    return chosen.select(*[f"`{c}`" for c in delta.columns])


def upsert_index(base: DataFrame, delta: DataFrame, order: str | Column | None = None) -> DataFrame:
    """Insert or replace by point id. Of several rows for one id, the last by ``order`` wins; without an
    order such rows are an error."""
    delta = latest_rows(delta, order)
    return base.join(delta.select("point_id"), "point_id", "left_anti").unionByName(delta.select(*base.columns))


def merge_index(spark: SparkSession, path: str, delta: DataFrame, order: str | Column | None = None) -> list[int]:
    """Upsert into a stored index that is partitioned by cluster, writing only the folders it touches.

    Touched are the clusters of new rows and those in which replaced rows lie; found from ids and clusters
    alone. Returns them. All other folders keep their files. The new contents are complete in the scratch
    folder before any folder is replaced, so a merge that is interrupted can be repeated.
    """
    base = spark.read.parquet(path)
    delta = materialize(latest_rows(delta, order).select(*base.columns), "delta")
    old = base.select("point_id", "dominant_cluster").join(delta.select("point_id"), "point_id", "left_semi")
    found = delta.select("dominant_cluster").unionByName(old.select("dominant_cluster")).distinct()
    # As many as the model has clusters at most.
    touched = [r["dominant_cluster"] for r in found.collect()]
    if not touched:
        return []
    inside = F.col("dominant_cluster").isin([c for c in touched if c is not None])
    inside = inside | F.col("dominant_cluster").isNull() if None in touched else inside
    merged = materialize(upsert_index(base.where(inside), delta), "merged")
    left = {r["dominant_cluster"] for r in merged.select("dominant_cluster").distinct().collect()}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = merged.repartition(n, "dominant_cluster", F.pmod(F.xxhash64("point_id"), F.lit(n)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dominant_cluster").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for cluster in touched:
        if cluster not in left:  # all its points have moved elsewhere
            name = "__HIVE_DEFAULT_PARTITION__" if cluster is None else cluster
            files.delete(folder(f"{path}/dominant_cluster={name}"), True)
    return sorted(touched, key=lambda c: (c is not None, c))


def index_info(index: DataFrame, expected: DataFrame | int) -> DataFrame:
    """Point count, expected count, and whether they agree."""
    points = index.agg(F.count("*").alias("points_count")).withColumn("_one", F.lit(1))
    if isinstance(expected, DataFrame):
        wanted = expected.agg(F.count("*").alias("expected")).withColumn("_one", F.lit(1))
        points = points.join(wanted, "_one")
    else:
        points = points.withColumn("expected", F.lit(expected).cast("long"))
    return points.drop("_one").withColumn("matches", F.col("points_count") == F.col("expected"))
