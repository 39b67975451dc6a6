"""Global order without a global window: range partitions plus small per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softseek.session import materialize


def range_parts(df: DataFrame, *order: str | Column, label: str = "ordered") -> DataFrame:
    """``df`` in global order, with ``_part`` (range partition) and ``_at`` (position inside it).

    Range boundaries come from a sample, so the table is written once and read back: counting
    partitions and numbering rows must see the same boundaries.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    serial = F.monotonically_increasing_id()
    ordered = ordered.withColumn("_serial", serial)
    ordered = ordered.withColumns(
        {"_part": F.shiftright("_serial", 33).cast("int"), "_at": F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_serial")
    return materialize(ordered, label)


def carry_window():
    """Over one row per partition: everything in earlier partitions."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def dense_index(df: DataFrame, *order: str | Column, name: str = "point_id") -> DataFrame:
    """Adds a dense 0-based position in the given order, which must be unique."""
    parts = range_parts(df, *order)
    # One row per partition: its size is the number of partitions, whatever the data holds.
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(carry_window()), F.lit(0)).alias("_offset"))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_at", "_offset")
    )
