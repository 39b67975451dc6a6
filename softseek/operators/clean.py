"""Cleaning of raw posts: header split, noise removal, quality filter, report.

Everything is a chain of projections over ``raw_posts(category, doc_id, raw)``; nothing is shuffled
before the report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softseek.functions import text as tx

MIN_WORDS = 20
MAX_QUOTE = 0.70

# Each step with a cheap necessary condition: rows that cannot match skip the pattern.
_STEPS = (
    (tx.strip_pgp, lambda c: c.contains("-----BEGIN PGP")),
    (tx.cut_signature, lambda c: c.contains("\n--")),
    (tx.strip_reply_intro, None),
    # No character but these four is a "w" or an "r" without regard to case.
    (tx.strip_attribution, lambda c: F.lower(c).contains("wr") & c.rlike(tx.ATTRIBUTION_END)),
    (tx.strip_quotes, lambda c: c.contains(">") & c.rlike(tx.QUOTED_START)),
    (tx.strip_emails, lambda c: c.contains("@")),
    (tx.strip_dividers, None),
    (tx.collapse_blank, None),
)


def _gated(text: Column, step: Callable[[Column], Column], needed: Callable[[Column], Column]) -> Column:
    """``step`` where ``needed`` holds. The text is bound once, as a lambda variable, so that a chain of
    such steps stays linear in size when the optimizer substitutes columns."""
    return F.transform(F.array(text), lambda t: F.when(needed(t), step(t)).otherwise(t))[0]


def clean_text(body: Column) -> Column:
    """All noise removal steps in their fixed order."""
    for step, needed in _STEPS:
        body = step(body) if needed is None else _gated(body, step, needed)
    return body


def clean_body(df: DataFrame, body: str = "body", out: str = "clean") -> DataFrame:
    return df.withColumn(out, clean_text(F.col(body)))


def split_post(df: DataFrame) -> DataFrame:
    """Header block and body at the first empty line."""
    return df.withColumns({"header": tx.header_block(F.col("raw")), "body": tx.body_block(F.col("raw"))})


def parse_headers(df: DataFrame) -> DataFrame:
    """All headers as a map."""
    return df.withColumn("headers", tx.header_map(F.col("header")))


def classify_docs(df: DataFrame, min_words: int = MIN_WORDS, max_quote: float = MAX_QUOTE) -> DataFrame:
    """Cleaned columns for every post plus ``drop_reason``, null where the post is kept.

    The quote ratio is taken from the raw body; mostly quoted posts skip the cleaning patterns.
    """
    df = split_post(df).withColumn("quote_ratio", tx.quote_ratio(F.col("body")))
    quoted = F.col("quote_ratio") > max_quote
    df = df.withColumn("_fields", F.when(~quoted, tx.header_fields(F.col("header"), ("subject", "newsgroups"))))
    df = df.withColumn("_body", F.when(~quoted, F.col("body")))
    df = clean_body(df, "_body", "_body")
    df = df.withColumns(
        {
            "subject": tx.clean_subject(F.col("_fields.subject")),
            "all_newsgroups": tx.parse_groups(F.col("_fields.newsgroups")),
        }
    )
    df = df.withColumn("text", tx.compose_text(F.col("subject"), F.col("_body")))
    df = df.withColumn("word_count", tx.word_count(F.col("text")))
    reason = (
        F.when(F.col("raw").isNull(), "read_error")
        .when(quoted, "quoted")
        .when(F.col("word_count") < min_words, "short")
    )
    return df.select(
        "doc_id",
        "category",
        "all_newsgroups",
        (F.size("all_newsgroups") > 1).alias("is_cross_post"),
        "subject",
        "text",
        "word_count",
        "quote_ratio",
        reason.alias("drop_reason"),
    )


def preprocess(df: DataFrame, min_words: int = MIN_WORDS, max_quote: float = MAX_QUOTE) -> DataFrame:
    """The whole cleaning job: kept documents only."""
    # A filter on cleaned text is no use below the cleaning: pushed down it would clean every post
    # twice. The partition id, always >= 0, makes the column one that filters are not pushed through.
    reason = F.when(F.spark_partition_id() >= 0, F.col("drop_reason"))
    marked = classify_docs(df, min_words, max_quote).withColumn("drop_reason", reason)
    return marked.where("drop_reason is null").drop("quote_ratio", "drop_reason")


def cleaning_report(classified: DataFrame) -> DataFrame:
    """One row per category and one for all (null category): totals, kept, integer percent, reasons."""

    def dropped(reason: str) -> Column:
        return F.count_if(F.col("drop_reason").eqNullSafe(reason)).alias(f"dropped_{reason}")

    counts = [
        F.count_if("_real").alias("total"),
        F.count_if(F.col("drop_reason").isNull()).alias("kept"),
        dropped("short"),
        dropped("quoted"),
        dropped("read_error"),
    ]
    # One row that counts for nothing gives an empty corpus its total.
    rows = classified.select("category", "drop_reason", F.lit(True).alias("_real"))
    none = rows.sparkSession.createDataFrame([(None, "none", False)], rows.schema)
    report = rows.unionByName(none).rollup("category").agg(F.grouping("category").alias("is_total"), *counts)
    report = report.where("is_total = 1 or total > 0")
    percent = F.try_divide(F.lit(100) * F.col("kept"), F.col("total"))
    return report.select(
        F.col("is_total").cast("boolean").alias("is_total"),
        "category", "total", "kept", F.floor(percent).alias("kept_percent"),
        "dropped_short", "dropped_quoted", "dropped_read_error",
    )
