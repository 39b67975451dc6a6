"""Inputs that the operators need, derived from whole tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softseek.functions.vectors import l2_normalize
from softseek.operators.cache import with_clusters
from softseek.operators.clusters import centers_array, fcm_memberships
from softseek.session import materialize

FUZZINESS = 1.1
LOG_THETA = 0.30

# The same expression is valid in both engines.
RAW_POST = """
'Path: news!site' || chr(10) || 'Subject: Re: ' || lang || ' note ' || doc_id || chr(10)
|| 'Newsgroups: ' || source || CASE WHEN doc_id % 2 = 0 THEN ', ' || lang ELSE '' END || chr(10) || 'Lines: 7' || chr(10) || chr(10)
|| CASE WHEN doc_id % 3 = 0 THEN 'In article <77x@site.org>, someone@site.org writes:' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 4 = 1 THEN 'Jane Roe (jane.roe@site.org) wrote:' || chr(10) || '> old words' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 7 = 0 THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END
|| CASE WHEN doc_id % 6 = 1 THEN chr(10) || 'mail me+you@mail.example.com now' || chr(10) || '=-=-=-=-=' || chr(10) || chr(10) || chr(10) || 'more' ELSE '' END
|| CASE WHEN doc_id % 11 = 2 THEN chr(10) || '-----BEGIN PGP SIGNATURE-----' || chr(10) || 'iQCVAw' || chr(10) || '-----END PGP SIGNATURE-----' || chr(10) || 'after' ELSE '' END
|| CASE WHEN doc_id % 5 = 0 THEN chr(10) || '-- ' || chr(10) || 'sig' || chr(10) || 'line' ELSE '' END
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``point_id, embedding, category``."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"), "embedding", F.concat(F.lit("label_"), "label").alias("category"), "label"
    )


def as_queries(index: DataFrame) -> DataFrame:
    return index.withColumnRenamed("point_id", "query_id")


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts. The table is one small file; cleaning it should still use every core."""
    docs = table(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism)
    return docs.selectExpr("source as category", "cast(doc_id as string) as doc_id", f"{RAW_POST} as raw")


def write_posts(posts: DataFrame, root: str) -> None:
    """One file per row of ``category, raw`` below a folder per category, named and escaped as Spark's text writer
    does it.

    Each task writes its files itself: a Hadoop committer moves every one again, and its local file system starts a
    process per file. Other stores than a mounted folder get Spark's writer, whose tasks commit their own files.
    """
    spark = posts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() != "file":
        writer = posts.select("category", F.col("raw").alias("value")).write.option("maxRecordsPerFile", 1)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("category").text(root)
        return
    folder = uri.getPath()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for category, raw in zip(batch.column("category").to_pylist(), batch.column("raw").to_pylist()):
                home = f"{folder}/category={_folder_name(category)}"
                if home not in made:
                    os.makedirs(home, exist_ok=True)
                    made.add(home)
                # Hidden until it is whole; a task that is run again replaces what it wrote before.
                name = f"part-{part:05d}-{count}.txt"
                hidden = f"{home}/.{name}-{uuid4().hex}"
                with open(hidden, "wb") as file:
                    file.write((raw or "").encode() + b"\n")
                os.replace(hidden, f"{home}/{name}")
                count += 1
        yield pa.RecordBatch.from_pydict({"files": [count]})

    rows = posts.select("category", "raw").mapInArrow(task, "files long")
    rows.agg(F.sum("files")).collect()


def _folder_name(value: str | None) -> str:
    """A partition's value as Spark writes it in a path."""
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def centers(spark: SparkSession, sf: str) -> np.ndarray:
    """Centre j is the mean of all vectors with label j."""
    mean = Summarizer.mean(array_to_vector("embedding"))
    means = table(spark, sf, "embeddings").groupBy("label").agg(vector_to_array(mean).alias("center"))
    return centers_array(means.withColumnRenamed("label", "cluster_id"))


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with memberships."""
    return fcm_memberships(embeddings(spark, sf), centers(spark, sf), FUZZINESS)


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    return with_clusters(weighted(spark, sf))


def _vector_for(df: DataFrame, number: str, features: DataFrame) -> DataFrame:
    """Give every row the vector of one of the embeddings, going round the table."""
    keyed = df.withColumn("_vec", F.expr(f"({number}) % {features.count()}"))
    return keyed.join(features.withColumnRenamed("point_id", "_vec"), "_vec").drop("_vec")


def doc_payload(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as payload, without vectors."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("point_id"),
        F.col("source").alias("category"),
        F.expr("CASE WHEN doc_id % 9 = 4 THEN NULL ELSE lang || ' note ' || doc_id END").alias("subject"),
        "text",
    )


def doc_index(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as index points; there are more documents than vectors, so vectors repeat."""
    return _vector_for(doc_payload(spark, sf), "point_id", embeddings(spark, sf).select("point_id", "embedding"))


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The points of ``doc_index`` without payload, as a table: no text is shuffled to give it a vector, and none twice."""
    points = doc_payload(spark, sf).select("point_id")
    return materialize(_vector_for(points, "point_id", embeddings(spark, sf).select("point_id", "embedding")), "index")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a query log with flush and set-threshold events in between."""
    flush = "event_id % 1000 = 999"
    setter = f"NOT ({flush}) AND event_id % 350 = 10"
    events = table(spark, sf, "events").selectExpr(
        "event_id as seq", "'q' || event_id as query", "value as latency", f"{flush} as is_flush",
        f"CASE WHEN {setter} THEN element_at(array(0.30D, 0.55D, 0.80D), cast((event_id div 350) % 3 + 1 as int)) END as set_theta",
    )
    features = clustered(spark, sf).select("point_id", "embedding", "memberships", "top_clusters", "dominant_cluster")
    return _vector_for(events, "seq * 37", features)


def vector_log(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings in id order as a query log."""
    return clustered(spark, sf).select(
        F.col("point_id").alias("seq"), F.expr("'q' || point_id").alias("query"),
        "embedding", "memberships", "top_clusters", "dominant_cluster",
    )


def turn_log(spark: SparkSession, sf: str) -> DataFrame:
    """All conversation turns as queries; some are blank, some leave out ``top_k``."""
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn as seq",
        "CASE WHEN conv_id % 10 = 0 THEN '  ' || chr(10) ELSE ' ' || text || chr(10) END as query",
        "CASE WHEN turn % 4 = 3 THEN NULL ELSE cast(turn % 5 + 1 as int) END as top_k",
    )
    return _vector_for(turns, "seq * 7", embeddings(spark, sf).select("point_id", "embedding"))


def pair_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Neighbouring vectors as unrelated pairs; each vector and a blend with its neighbour as a paraphrase.

    Blends have ids from 1,000,000.
    """
    emb = embeddings(spark, sf).select("point_id", "embedding")
    nxt = emb.select((F.col("point_id") - 1).alias("point_id"), F.col("embedding").alias("_next"))
    both = emb.join(nxt, "point_id")
    share = F.lit(0.3) + F.lit(0.1) * (F.col("point_id") % 8)
    mixed = F.zip_with("embedding", "_next", lambda a, b: a.cast("double") + share * b.cast("double"))
    blends = both.withColumn("_mixed", mixed).select(
        (F.col("point_id") + 1_000_000).alias("point_id"), l2_normalize(F.col("_mixed")).alias("embedding")
    )
    all_vectors = emb.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(blends)
    queries = with_clusters(fcm_memberships(all_vectors, centers(spark, sf), FUZZINESS))
    pairs = both.select(
        F.explode(
            F.array(
                F.struct(F.col("point_id").alias("pair_id"), F.lit("unrelated").alias("kind"), F.col("point_id").alias("q1"), (F.col("point_id") + 1).alias("q2")),
                F.struct((F.col("point_id") + 1_000_000).alias("pair_id"), F.lit("paraphrase").alias("kind"), F.col("point_id").alias("q1"), (F.col("point_id") + 1_000_000).alias("q2")),
            )
        ).alias("p")
    ).select("p.*")
    return pairs, as_queries(queries)
