"""Token ids in Parquet list columns: sorted files, dictionary or delta pages, page indexes.

Texts are dealt into ranges of doc_id and encoded where they are written. A file keeps doc_id,
the place of a text's first token in its part, the number of tokens, and the tokens; doc_id and
the counts are delta encoded where the dictionary does not pay, tokens are dictionary encoded.
Row groups and pages are small, and the column index of Parquet lets a reader skip all pages but
those of the rows it asks for; metadata can be read without any token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softseek.llm import frames, word_ids
from softseek.llm import words as W

FILE_SCHEMA = "part int, doc_id long, place long, n_tokens long, tokens array<int>"
_FILE = pa.schema(
    [("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))]
)


def _encode_rows(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        encoder = word_ids.encoder(path)
        for chunk in W.chunks(batches, "text", 1 << 20):
            ids, n = word_ids.with_end(*encoder.encode_column(chunk.column("text")), end)
            offsets = np.concatenate(([0], np.cumsum(n)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            columns = [pa.array(np.full(len(n), part, np.int32)), chunk.column("doc_id"), pa.array(place + offsets[:-1]), pa.array(n), lists]
            place += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, schema=_FILE)

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end: int = 2,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 128 << 10,
    dictionary: bool = True,
) -> None:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order, each text with ``end`` behind it.

    Null and empty texts have the end id alone. Rows that share a doc_id stand in the order of
    their texts, rows without one first. ``tokenizer``: a tokenizers file that drops white space.
    ``dictionary=False`` delta-encodes the tokens too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows that share a doc_id are dealt by how their texts begin, and ordered by their whole texts.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(_encode_rows(tokenizer, end), FILE_SCHEMA)
    with frames.batches_of(docs.sparkSession, 4 << 20):
        (
            coded.write.option("parquet.writer.version", "v2")
            .option("parquet.enable.dictionary", str(dictionary).lower())
            .option("parquet.block.size", row_group_bytes)
            .option("parquet.page.size", page_bytes)
            .option("parquet.page.row.count.limit", 2000)
            .option("compression", "zstd")
            .parquet(folder)
        )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens``; start is the number of ids of all texts before.

    A filter on doc_id reads the pages of these rows only, a selection without tokens no token.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    # One row per file: its total, carried over the files before.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "part")
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "tokens")


_CHECKED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            raw = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype("<u4").tobytes()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            columns = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, _CHECKED)
