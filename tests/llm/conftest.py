import pytest
from pyspark.sql import functions as F

from softseek.session import ship_package

LONG = " ".join(f"wort{i % 997}" for i in range(60_000))

#: doc_id, text, source: nulls in every column, blank, tiny and very long texts, copies, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "a"),
    (2, "THE QUICK brown fox jumps over the lazy dog and runs far away from here today", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, " \t\n\r\x0b\x0c ", "b"),
    (6, "one two", "a"),
    (7, "one two", "a"),
    (8, LONG, "a"),
    (9, LONG + " end", None),
    (9, LONG + " end", None),
    (None, "no id but words here", "c"),
    (None, None, None),
    (10, "x" * 300_000, "c"),
    (11, "été ÉTÉ naïve 中文 😀 token = \"abcdef123456\"", "d"),
]


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    from pathlib import Path

    ship_package(spark, Path(__file__).resolve().parents[2] / "softseek")


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with extra columns whose names the operators use themselves."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return docs.select("*", F.lit(1).alias("score"), F.lit("x").alias("items"), F.lit(2).alias("n"), F.lit(3).alias("part")).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
