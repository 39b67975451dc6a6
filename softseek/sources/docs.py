"""Cleaned documents as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("all_newsgroups", T.ArrayType(T.StringType())),
        T.StructField("is_cross_post", T.BooleanType()),
        T.StructField("subject", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)


def write_docs(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written, other scripts are not escaped."""
    columns = [f.name for f in DOC_SCHEMA]
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped, malformed lines are an error."""
    return spark.read.schema(DOC_SCHEMA).option("mode", "FAILFAST").json(path)
