"""From documents to token files: five stages, each a Spark job over all that the one before kept.

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of near-duplicate documents the one of smallest doc_id stays.
3. decontamination: documents that contain benchmark passages go.
4. mixing: sources take part by their target weights; a document appears as often as it is taken.
5. token_files: the corpus as token ids, written in doc_id order and read back with checksums.

``run`` applies them to the table documents. Each stage's rows are written as Parquet and read again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softseek.llm import decontaminate, jaccard, mixing, quality, token_files
from softseek.llm.queries import ACCEPT, learnable, table
from softseek.operators.ordering import dense_index
from softseek.session import materialize, scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Five words and a similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80


def _shipped(stage: Stage) -> Stage:
    """The stage, with the code on the executors."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark, Path(__file__).resolve().parent / "softseek")
        return stage(spark, docs, sf_dir)

    return call


#: Columns that stages read; all others travel under names that no operator uses.
_READ = ("doc_id", "text", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns renamed by position."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in _READ else f"kept{i}") for i, c in enumerate(docs.columns)])


def _back(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, under their names."""
    return made.select(*[F.col(c if c in _READ else f"kept{i}").alias(c) for i, c in enumerate(docs.columns)])


@_shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the classifier learns from labelled documents of the stage's input.

    Null and empty texts get the prior of the labels and stay or go by it.
    """
    labels = learnable(table(spark, sf_dir, "labels"))
    weights = quality.fit_quality(learnable(docs.select("doc_id", "text")), labels)
    return _back(quality.score_quality(_apart(docs), weights).where(F.col("score") >= ACCEPT), docs)


@_shipped
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id.

    Documents without words or without doc_id have no duplicates and stay. Rows that share a doc_id
    are documents of their own if their texts differ; of those that repeat doc_id and text one stays.
    """
    rows = _apart(docs)
    shared = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if shared.isEmpty():
        return _back(rows.join(_later_copies(rows.select("doc_id", "text")), "doc_id", "left_anti"), docs)
    # Documents are then known by the place of doc_id and text among all of them.
    print_of = F.sha2(F.coalesce("text", F.lit("")), 256)
    known = rows.where("doc_id is not null").withColumn("print", print_of).withColumn("empty", F.col("text").isNull())
    places = dense_index(known.select("doc_id", "print", "empty").distinct(), "doc_id", "print", "empty", name="place")
    once = Window.partitionBy("doc_id", "print", "empty").orderBy("doc_id")
    placed = materialize(known.join(places, ["doc_id", "print", "empty"]).withColumn("copy", F.row_number().over(once)).where("copy = 1"), "placed")
    gone = _later_copies(placed.select(F.col("place").alias("doc_id"), "text")).withColumnRenamed("doc_id", "place")
    left = placed.join(gone, "place", "left_anti").select(rows.columns)
    return _back(left.unionByName(rows.where("doc_id is null")), docs)


def _later_copies(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that are near duplicates of one with a smaller doc_id."""
    groups = jaccard.near_duplicates(docs, SHINGLE_WORDS, PERCENT)
    return materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")


@_shipped
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a window of 13 benchmark words."""
    hits = decontaminate.benchmark_hits(_apart(docs), table(spark, sf_dir, "benchmark"), window=13)
    return _back(hits.where(~F.expr(decontaminate.contaminated())), docs)


@_shipped
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; where it takes only some of its words, a row with these.

    Documents without words take no part in a mix of words and stay as they are. Rows that share
    doc_id, source and size (or have no doc_id) get what the mix took of them one by one, in the
    order of their texts' hashes.
    """
    key = ["doc_id", "source", "size"]
    mixed = materialize(mixing.mix(docs.select("doc_id", "source", "text")).where("size > 0").select(*key, "taken", "head"), "mixed")
    plan = mixed.groupBy(*key).agg(F.min(F.struct("taken", "head")).alias("least"), F.max(F.struct("taken", "head")).alias("most"))
    even = plan.select(*[F.col(c).alias(f"mix_{c}") for c in key], (F.col("least") == F.col("most")).alias("even"), F.col("most.taken").alias("taken"), F.col("most.head").alias("head"))
    even = materialize(even, "plan")
    sized = _apart(docs).withColumn("size", mixing.size_of("text"))

    def same(rows: DataFrame):
        return rows["doc_id"].eqNullSafe(even["mix_doc_id"]) & rows["source"].eqNullSafe(even["mix_source"]) & (rows["size"] == even["mix_size"])

    joined = sized.join(even, same(sized), "left").drop(*[f"mix_{c}" for c in key])
    dealt = joined.where("even is null or even").drop("even")
    if not even.where("not even").isEmpty():
        # Both tables have the same keys equally often: sorted by key, their places correspond.
        ones = mixed.join(even.where("not even").drop("taken", "head"), same(mixed), "left_semi")
        ones = dense_index(ones, *[F.col(c).asc_nulls_first() for c in key], "taken", "head", name="place")
        rows = joined.where("not even").drop("even", "taken", "head").withColumn("print", F.xxhash64("text"))
        rows = dense_index(rows, *[F.col(c).asc_nulls_first() for c in key], "print", name="place").drop("print")
        dealt = dealt.unionByName(rows.join(ones.select("place", "taken", "head"), "place").drop("place"))
    taken, size = F.col("taken"), F.col("size")
    whole = F.array_repeat(F.lit(True), F.coalesce(F.floor(taken / size).cast("int"), F.lit(1)))
    part = F.when(taken % size > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    rows = dealt.withColumn("whole", F.explode(F.concat(whole, F.coalesce(part, F.array().cast("array<boolean>")))))
    odd = F.coalesce(taken % size, F.lit(0)).cast("int")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.array_join(F.when(F.col("head"), F.slice(words, 1, odd)).otherwise(F.slice(words, F.size(words) - odd + 1, odd)), " ")
    made = {"text": F.when(F.col("whole"), F.col("text")).otherwise(some)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length(some).cast(docs.schema["n_chars"].dataType))
    return _back(rows.withColumns(made), docs)


@_shipped
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files written."""
    folder = scratch_path(spark, "corpus-tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, folder))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: SQL has no tokenizer and no classifier; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
