"""Raw posts: one file per post, one folder per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softseek.session import materialize

MERGED_PARTS = 32


def read_posts(spark: SparkSession, root: str) -> DataFrame:
    """``category, doc_id, raw`` of every file exactly one level below a category folder.

    Malformed UTF-8 is replaced and line ends become ``\\n``. Every file is opened once and its text kept in
    the shared folder: opening small files costs more than their bytes. A file that is listed but cannot be
    read has a null ``raw``: the listing is compared with the paths that were read. Spark's file sources skip
    names that begin with ``.`` or ``_`` and files without any byte; the latter would be dropped by the
    quality filter in any case.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    tolerant = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}
    listed = spark.read.options(**tolerant).format("binaryFile").load(f"{base}/*")
    # Spark puts a few dozen small files in a partition; a task takes up to MERGED_PARTS of these.
    parts = listed.rdd.getNumPartitions()
    tasks = max(2 * spark.sparkContext.defaultParallelism, parts // MERGED_PARTS)

    text = F.make_valid_utf8(F.col("content").cast("string"))
    contents = listed.where("length > 0").select("path", F.regexp_replace(text, "\r\n?", "\n").alias("raw"))
    read = materialize(contents.coalesce(tasks), "contents")
    # Written as well, or the optimizer puts the comparison below the merging of partitions.
    paths = materialize(listed.where("length > 0").select("path").coalesce(tasks), "listed")
    unreadable = paths.join(read.select("path"), "path", "left_anti")
    every = read.unionByName(unreadable.withColumn("raw", F.lit(None).cast("string")))
    names = F.split(F.substring(F.col("path"), len(base) + 2, 1 << 30), "/")
    return (
        every.withColumn("_names", names)
        .where(F.size("_names") == 2)
        .select(F.col("_names")[0].alias("category"), F.col("_names")[1].alias("doc_id"), "raw")
    )
