"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets follow the weights but stop at ``most`` times a source's size; the excess is shared again.
Each source is dealt into shards of bounded size by a seeded hash. The blocks of the mix are given
to the shards by highest quotients v / (2k + 1), which is rounding v / d for the one divisor d that
uses up all blocks: d is found by a few aggregations, nothing is sorted. A shard's quota is taken
from its texts in seeded order, as whole rounds and a seeded arc of neighbouring blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softseek.operators.ordering import dense_index
from softseek.session import materialize

GRID = 48


def size_of(text: str) -> Column:
    """Words between white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, number, documents, source_size, target`` of ``sized(source, size)``.

    Sources in code point order, null last, take the weights in turn. Targets add up to ``share``
    of all sizes and none is above ``most`` times its source (so ``share`` < ``most``).
    """
    totals = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    placed = dense_index(totals.withColumn("_none", F.col("source").isNull()), "_none", "source", name="number").drop("_none")
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn("weight", F.element_at(wheel, (F.col("number") % len(weights) + 1).cast("int")))
    placed = materialize(placed.withColumn("limit", F.lit(most) * F.col("source_size")), "sources")
    total = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round caps at least one source more, else it ends
        capped = F.col("limit") <= F.lit(level) * F.col("weight")
        held, free = placed.agg(
            F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return placed.withColumn("target", target).drop("weight", "limit")


def apportion(parties: DataFrame, seats: int, votes: str = "votes", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """``parties`` with ``seats``: Sainte-Lague; equal quotients go to the smaller keys, which are unique.

    Null or no votes get no seat; without any vote nobody does.
    """
    spark = parties.sparkSession
    parties = materialize(parties.withColumn("_v", F.coalesce(F.col(votes).cast("double"), F.lit(0.0))), "parties")
    voters, total, largest = parties.where("_v > 0").agg(F.count("*"), F.sum("_v"), F.max("_v")).first()
    if not voters or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long")).drop("_v")

    def rounded(divisor: Column) -> Column:
        return F.floor(F.col("_v") / divisor + 0.5)

    def used(divisors: list[float]) -> list[int]:
        return [int(x) for x in parties.agg(*[F.sum(rounded(F.lit(d))) for d in divisors]).first()]

    low = total / (seats + voters)  # uses all seats or more
    high = total / (seats - voters / 2) if seats > voters else 2.1 * largest  # uses all or fewer
    for _ in range(9):
        step = (high / low) ** (1 / (GRID + 1))
        grid = [low, *(low * step**i for i in range(1, GRID + 1)), high]
        counts = used(grid)
        if seats in counts:
            return parties.withColumn("seats", rounded(F.lit(grid[counts.index(seats)])).cast("long")).drop("_v")
        low = max(d for d, n in zip(grid, counts, strict=True) if n > seats)
        high = min(d for d, n in zip(grid, counts, strict=True) if n < seats)
    # Only equal quotients are left between the two divisors.
    fewer = parties.withColumn("seats", rounded(F.lit(high)).cast("long"))
    left = seats - int(fewer.agg(F.sum("seats")).first()[0])
    more = fewer.where(rounded(F.lit(low)) > F.col("seats"))
    taken = [F.col(k).alias(f"_{k}") for k in keys]
    extra = more.orderBy((F.col("_v") / (2 * F.col("seats") + 1)).desc(), *keys).limit(left).select(*taken, F.lit(1).alias("_extra"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = fewer.join(extra, match, "left").withColumn("seats", F.col("seats") + F.coalesce("_extra", F.lit(0)))
    return joined.select(*[c for c in fewer.columns if c != "_v"])


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = 8,
    shard_words: int = 2_000_000,
    shard_documents: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, head`` for every row of ``docs(doc_id, source, text)``.

    ``taken``: words of the text in the mix, at most ``most`` times its size. When it is not a
    multiple of the size, the odd words are the first of the text if ``head``, else the last (both
    only where an arc goes around: first). Null and blank texts have size 0 and are never taken;
    a null source is a source of its own. The same rows give the same mix on every run.
    """
    sized = materialize(docs.select("doc_id", "source", size_of("text").alias("size")), "sized")
    sources = source_targets(sized, weights, share, most)
    shards = F.ceil(F.greatest(F.col("source_size") / shard_words, F.col("documents") / shard_documents, F.lit(1.0)))
    sources = materialize(sources.withColumn("shards", shards.cast("long")), "targets").withColumnRenamed("source", "_source")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["_source"])).drop("_source", "documents")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))

    stock = rows.groupBy("number", "shard").agg(
        F.sum("size").alias("words"), F.coalesce(F.try_divide(F.first("target") * F.sum("size"), F.first("source_size")), F.lit(0.0)).alias("votes")
    )
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    quota = apportion(stock, round(wanted / block), keys=("number", "shard")).select("number", "shard", "words", "seats")
    blocks = F.ceil(F.col("words") / F.lit(block)).cast("long")
    quota = quota.where("words > 0").withColumn("blocks", blocks)
    seats = F.least(F.col("seats"), F.col("blocks") * most)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "number", "shard"), F.col("blocks"))
    quota = quota.select(
        "number", "shard", "words",
        F.floor(seats / F.col("blocks")).alias("rounds"),
        (start * block).alias("from"),
        ((start + seats % F.col("blocks")) * block).alias("to"),
        (F.col("blocks") * block).alias("around"),
    )
    order = [F.xxhash64(F.lit(seed + 2), "doc_id"), F.col("doc_id"), F.col("size")]
    before = Window.partitionBy("number", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("a", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("b", F.col("a") + F.col("size"))
    placed = placed.join(quota, ["number", "shard"], "left")

    def common(low, high) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("b"), high) - F.greatest(F.col("a"), low))

    first = common(F.col("from"), F.least(F.col("to"), F.col("around")))
    again = common(F.lit(0), F.col("to") - F.col("around"))
    taken = F.coalesce(F.col("rounds") * F.col("size") + first + again, F.lit(0)).cast("long")
    head = F.coalesce((again > 0) | (F.col("from") <= F.col("a")), F.lit(True))
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", F.least(taken, most * F.col("size")).alias("taken"), head.alias("head")
    )
