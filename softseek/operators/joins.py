"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
_ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)


def _salt_source(many: DataFrame, key: str, spread_by: tuple[str, ...]) -> list[str]:
    """What the salt of a row is computed from: the columns named, or all plain ones but the key."""
    return list(spread_by) or [f.name for f in many.schema.fields if f.name != key and isinstance(f.dataType, _ATOMIC)]


def lookup_join(
    many: DataFrame, unique: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, spread_by: tuple[str, ...] = ()
) -> DataFrame:
    """``many`` joined to ``unique``, which has one row per key; ``how``: inner or left.

    A key with more than ``hot_rows`` rows in ``many`` is split into as many salts as it has multiples
    of them, and its partner row is repeated once per salt, for any number of such keys. A row's salt is
    a hash of its own columns ``spread_by`` (its id; all plain columns if none is named), so a task that
    is run again deals its rows out as before. Rows without a key have no partner and go around the
    join. A table of at most ``hot_rows`` rows has no such key and is joined as it is.
    """
    if many.select(key).limit(hot_rows + 1).count() <= hot_rows:
        return many.join(unique, key, how)
    hot = many.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot_rows)
    # At most one row per hot_rows rows.
    hot = F.broadcast(hot.select(key, F.ceil(F.col("count") / F.lit(hot_rows)).cast("long").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    source = _salt_source(many, key, spread_by)
    own = F.pmod(F.xxhash64(*source), salts) if source else F.lit(0).cast("long")
    salted = many.where(F.col(key).isNotNull()).join(hot, key, "left").withColumn("_salt", own).drop("_salts")
    spread = unique.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    joined = salted.join(spread, [key, "_salt"], how).drop("_salt")
    if how == "inner":
        return joined
    alone = many.where(F.col(key).isNull())
    return joined.unionByName(alone, allowMissingColumns=True)
