"""Columns computed from whole texts in Arrow batches, beside all other columns."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from softseek.llm import words as W

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, nbytes: int) -> Iterator[None]:
    """Inside, Arrow batches that go to Python hold at most ``nbytes`` (or one longer row), not only a number of rows."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(nbytes))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


Compute = Callable[[pa.Array], list]


def append(docs: DataFrame, text: str, fields: str, compute: Compute, max_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the columns of the DDL ``fields`` behind its own.

    ``compute`` gets the texts of at most ``max_bytes`` (or one longer text) and returns a list of
    values per field. Columns of ``docs`` with a name of ``fields`` are replaced.
    """
    new = StructType.fromDDL(fields)
    kept = [f for f in docs.schema.fields if f.name not in new.names or f.name == text]
    source = docs.select(*[f"`{f.name}`" for f in kept])
    types = to_arrow_schema(new).types
    out = StructType(kept + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, text, max_bytes):
            made = [pa.array(v, t) for v, t in zip(compute(chunk.column(text)), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*chunk.columns, *made], names=out.names)

    return source.mapInArrow(run, out)
