"""Connected components of a link table by alternating large and small stars.

Every step is a join or an aggregation with map-side combining; no component is gathered in one
place. (Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseek.session import materialize


def _star(links: DataFrame, to_larger: bool) -> DataFrame:
    """One star step on rows ``(hi, lo)`` with ``hi > lo``."""
    if to_larger:  # every node tells its larger neighbours the smallest node it knows
        sides = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            links.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        least = sides.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        told = sides.where("other > node")
    else:  # every node tells its smaller neighbours, and itself, the smallest of them
        told = links.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        least = told.groupBy("node").agg(F.min("other").alias("least"))
        told = told.unionByName(least.select("node", F.col("node").alias("other")))
    out = told.join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    return out.where("hi <> lo").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links(a, b)``.

    Nodes are integers; self links and repeated links are ignored, null ends are no links; an
    empty table gives no rows.
    """
    current = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    state = None
    while True:
        digest = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if digest == state:
            break
        state = digest
        current = materialize(_star(_star(current, True), False), "stars")
    roots = current.select("lo").distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    )
