"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from softseek.llm import ann, collocations, decontaminate, jaccard, lm, merkle, mixing, packing, quality, secret_scan, surrogates, token_counts, token_files
from softseek.session import materialize, scratch_path

SURROGATE_KEY = b"documents-2026"
ACCEPT = 0.7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo the divisor."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = documents(spark, sf).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count("text", public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_projected_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ann.nearest(vectors, queries, k=20)


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(remainder(4) != 2)


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    weights = quality.fit_quality(learnable(docs), learnable(table(spark, sf, "labels")))
    scored = quality.score_quality(docs, weights)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )


def op5_ppm(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("held_out", F.coalesce(remainder(5) == 1, F.lit(False)))
    return lm.score_texts(docs)


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, folder))


def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf), shingle_words=4, percent=85)


def op8_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    replaced = surrogates.replace_entities(documents(spark, sf), SURROGATE_KEY)
    return replaced.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(documents(spark, sf), table(spark, sf, "benchmark"), window=13)
    return hits.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr(decontaminate.contaminated()).alias("contaminated"),
    )


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf))

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = ("assign", "access", "hex")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), least=30, top=2000, absorbed=80)


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rest = ("source", "lang", "n_chars")
    forged = merkle.row_digest("doc_id", *rest, F.replace("text", F.lit("\n"), F.lit("")))
    rows = table(spark, sf, "documents").select(
        F.col("source").cast("string").alias("tree"), "doc_id",
        merkle.row_digest("doc_id", *rest, "text").alias("node"),
        F.when(remainder(2) == 0, forged).alias("forged"),
    )
    # Leaves are hashed once: the sort by range reads its rows twice.
    manifest = merkle.write_manifest(materialize(rows, "leaves"), scratch_path(spark, "manifest"), ["doc_id"])
    root, subroot = F.col("tops")[0], F.col("tops")[1]
    proven = manifest.proofs().withColumn("folded_root", merkle.fold(F.coalesce("forged", "node")))
    return proven.select(
        "doc_id", F.col("node").alias("leaf"), subroot.alias("subroot"), root.alias("root"),
        F.sha2(merkle.siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_projected_neighbours": op2_projected_neighbours,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_ppm": op5_ppm,
    "op6_token_files": op6_token_files,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_surrogates": op8_surrogates,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_packing": op13_packing,
}
