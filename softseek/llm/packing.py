"""Packing of documents into sequences of a fixed length: cutting-stock column generation on a length histogram.

1. Every document is encoded once, in place; its whole sequences are cut off, the rest is one item. Items
   are kept with their ids, and counted by length class (``UNIT`` tokens wide), at most ``capacity / UNIT``
   of them.
2. The driver solves the cutting-stock linear program of this histogram: a column is a pattern, how many
   items of each class share a sequence; an integer knapsack by dynamic programming prices columns until
   none would help. Patterns are used as often as the integer part says; what is left of the histogram is
   packed by largest class first. All of this depends on the number of classes, not on the data.
3. Items are ranked within their class; rank and pattern give the sequence and the slot by arithmetic.
4. As documents may be cut freely, the emptiest sequences, as many as all gaps are long together, are
   given up: their ids are poured in order into the gaps of the others. What remains of them, less than
   one sequence, goes into sequences of the powers of two that make up its length. So no id is padding,
   and few documents are cut.

Null and empty texts have the end id alone. Rows are packed one by one, whatever their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softseek.llm import frames, word_ids
from softseek.llm import words as W
from softseek.operators.ordering import carry_window, range_parts
from softseek.session import materialize

UNIT = 16
_ITEMS = "part int, place long, doc_id long, start long, length int, doc_tokens long, size_class int, ids binary"


def _items(path: str, end: int, capacity: int):
    """Whole sequences (class 0) and the rest of every document, with their ids."""
    schema = pa.schema(
        [("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
         ("doc_tokens", pa.int64()), ("size_class", pa.int32()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        encoder = word_ids.encoder(path)
        for chunk in W.chunks(batches, "text", 1 << 20):
            ids, tokens = word_ids.with_end(*encoder.encode_column(chunk.column("text")), end)
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, tokens[doc] - start)
            first = (np.cumsum(tokens) - tokens)[doc] + start
            kind = np.where(length == capacity, 0, -(-length // UNIT))
            raw = ids.astype("<u4").tobytes()
            for at in range(0, len(doc), 512):  # at most 8 MB
                cut = slice(at, at + 512)
                blobs = [raw[4 * a : 4 * (a + n)] for a, n in zip(first[cut].tolist(), length[cut].tolist(), strict=True)]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(place + np.arange(n)), chunk.column("doc_id").take(pa.array(doc[cut])),
                     pa.array(start[cut]), pa.array(length[cut].astype(np.int32)), pa.array(tokens[doc[cut]]),
                     pa.array(kind[cut].astype(np.int32)), pa.array(blobs, pa.binary())], schema=schema
                )
                place += n

    return run


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.searchsorted(sizes, room, side="right")
        if fits:
            worth = value[room - sizes[:fits]] + prices[:fits]
            best = int(np.argmax(worth))
            if worth[best] > value[room] + 1e-12:
                value[room], last[room] = worth[best], best
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(value[capacity]), pattern


def _largest_first(sizes: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """Patterns that take the largest item that fits, again and again, each as often as it can be filled."""
    left = left.copy()
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        yield pattern, times
        left -= times * pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program of fewest sequences.

    Begins with patterns of one size each, into which the largest-first patterns are pivoted; a column
    enters as long as the bound of Farley leaves more than ``tolerance`` of all sequences to gain.
    Columns are priced by rising prices first (a larger item is worth as much as a smaller one), which
    takes far fewer steps, and by the program's own prices where that finds none.
    """
    basis = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / np.diag(basis))
    times = inverse @ demand.astype(float)

    def enter(pattern: np.ndarray) -> None:
        step = inverse @ pattern
        useful = np.flatnonzero(step > 1e-9)
        out = useful[np.argmin(times[useful] / step[useful])]
        theta = times[out] / step[out]
        times[:] = np.maximum(times - theta * step, 0)
        times[out] = theta
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])

    for pattern, _ in _largest_first(sizes, demand, capacity):
        if inverse.sum(axis=0) @ pattern > 1 + 1e-9:
            enter(pattern)
    bound = 0.0
    # The steps are few hundreds; the limit only guards against a cycle, and any basis is a valid plan.
    for _ in range(40 * len(sizes)):
        own = inverse.sum(axis=0)
        for prices in (np.maximum.accumulate(np.maximum(own, 0)), np.maximum(own, 0)):
            value, pattern = _best_pattern(sizes, prices, capacity)
            bound = max(bound, float(prices @ demand) / value) if value > 0 else bound
            if own @ pattern > 1 + 1e-9:
                break
        else:
            break
        if bound >= times.sum() * (1 - tolerance):
            break
        enter(pattern)
    return basis, times


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: items) and how often each is used; together they hold the histogram exactly."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    found, times = column_generation(sizes, left, capacity)
    out = []

    def use(pattern: np.ndarray, n: int) -> None:
        nonlocal left
        inside = pattern > 0
        n = min(n, int((left[inside] // pattern[inside]).min()))
        if n > 0:
            out.append((dict(zip(sizes[inside].tolist(), pattern[inside].tolist(), strict=True)), n))
            left = left - n * pattern

    for i in np.argsort(-times):
        use(found[:, i], int(np.floor(times[i] + 1e-6)))
    for pattern, n in list(_largest_first(sizes, left, capacity)):
        use(pattern, n)
    return out


def _slots(spark: SparkSession, counts: dict[int, int], capacity: int) -> tuple[DataFrame, int, int]:
    """Which ranks of a class go where, one row per class and pattern; the number of sequences that
    patterns make, and of all."""
    rows, base, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in patterns({c: n for c, n in counts.items() if c}, capacity // UNIT):
        slot = 0
        for size in sorted(pattern, reverse=True):
            rows.append((size, used[size], used[size] + pattern[size] * times, pattern[size], base, slot))
            used[size] += pattern[size] * times
            slot += pattern[size]
        base += times
    whole = counts.get(0, 0)
    if whole:
        rows.append((0, 0, whole, 1, base, 0))
    schema = "size_class int, low long, high long, each long, base long, slot long"
    return spark.createDataFrame(rows, schema), base, base + whole


def _placed(items: DataFrame, capacity: int) -> tuple[DataFrame, int, int]:
    """``part, place, length, sequence_id, offset`` of every item by rank and pattern."""
    counts = {r["size_class"]: r["count"] for r in items.groupBy("size_class").count().collect()}
    slots, mixed, every = _slots(items.sparkSession, counts, capacity)
    local = Window.partitionBy("part", "size_class").orderBy("place")
    earlier = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = items.groupBy("part", "size_class").count().select("part", "size_class", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = items.select("part", "place", "length", "size_class", (F.row_number().over(local) - 1).alias("rank"))
    ranked = ranked.join(bases, ["part", "size_class"]).withColumn("rank", F.col("rank") + F.col("before"))
    # Classes times patterns: a few thousand rows, whatever the data.
    dealt = ranked.join(F.broadcast(slots), "size_class").where("low <= rank and rank < high")
    dealt = dealt.select(
        "part", "place", "length",
        F.expr("base + (rank - low) div each").alias("sequence_id"),
        F.expr("slot + (rank - low) % each").alias("slot"),
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.where(F.col("sequence_id") >= mixed).withColumn("offset", F.lit(0).cast("long"))
    shared = dealt.where(F.col("sequence_id") < mixed).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return materialize(whole.unionByName(shared).drop("slot"), "placed"), mixed, every


def _powers(total: int) -> list[int]:
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def _without_gaps(placed: DataFrame, mixed: int, every: int, capacity: int) -> DataFrame:
    """``part, place, skip, length, sequence_id, offset``: pieces of items, the emptiest sequences poured into the gaps."""
    fills = placed.where(F.col("sequence_id") < mixed).groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    parts = range_parts(fills, "fill", "sequence_id", label="fills")
    sums = parts.groupBy("_part").agg(F.count("*").alias("n"), F.sum("fill").alias("f"))
    earlier = [F.coalesce(F.sum(c).over(carry_window()), F.lit(0)).alias(f"{c}_before") for c in ("n", "f")]
    here = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    runs = parts.join(F.broadcast(sums.select("_part", *earlier)), "_part").select(
        "sequence_id", "fill", (F.col("n_before") + F.col("_at")).alias("row"),
        (F.col("f_before") + F.coalesce(F.sum("fill").over(here), F.lit(0))).alias("filled"),
    )
    runs = materialize(runs, "runs")
    tokens = runs.agg(F.sum("fill")).first()[0] or 0
    gaps = mixed * capacity - tokens
    given = -(-gaps // capacity)
    # All before this one are given up: their ids, and where the stream of gaps begins.
    poured = runs.where(F.col("row") < given).agg(F.sum("fill")).first()[0] or 0
    skipped = given * capacity - poured
    rest = given * capacity - gaps
    ends, at = [], poured - rest
    for i, size in enumerate(_powers(rest)):
        ends.append((every + i, at, size, 0))
        at += size
    gap = "sequence_id long, at long, size long, fill long"
    open_ = runs.where((F.col("row") >= given) & (F.col("fill") < capacity)).select(
        "sequence_id", (F.col("row") * capacity - F.col("filled") - skipped).alias("at"), (capacity - F.col("fill")).alias("size"), "fill"
    )
    open_ = open_.unionByName(placed.sparkSession.createDataFrame(ends, gap))
    donors = runs.where(F.col("row") < given).select("sequence_id", "filled")
    moved = placed.join(donors, "sequence_id").select("part", "place", (F.col("filled") + F.col("offset")).alias("at"), F.col("length").alias("size"))
    stay = placed.join(donors, "sequence_id", "left_anti").withColumn("skip", F.lit(0).cast("long"))

    def by_cell(intervals: DataFrame, name: str, *fields: str) -> DataFrame:
        """Intervals of the stream cut at multiples of the capacity, so that a cell has few rows."""
        cells = F.sequence(F.expr(f"at div {capacity}"), F.expr(f"(at + size - 1) div {capacity}"))
        cut = intervals.withColumn("cell", F.explode(cells))
        return cut.select("cell", F.greatest("at", F.col("cell") * capacity).alias("begin"), F.struct("at", *fields).alias(name))

    # Both streams have the same length: what lies between two neighbouring beginnings is a piece.
    both = by_cell(open_, "gap", "sequence_id", "fill").unionByName(by_cell(moved, "item", "part", "place"), allowMissingColumns=True)
    order = Window.partitionBy("cell").orderBy("begin")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.coalesce(F.lead("begin").over(order), F.least((F.col("cell") + 1) * capacity, F.lit(poured)))
    cuts = both.select(
        "begin", (stop - F.col("begin")).alias("size"), F.last("gap", True).over(upto).alias("gap"), F.last("item", True).over(upto).alias("item")
    ).where("size > 0")
    pieces = cuts.select(
        "item.part", "item.place", (F.col("begin") - F.col("item.at")).alias("skip"), F.col("size").cast("int").alias("length"),
        "gap.sequence_id", (F.col("gap.fill") + F.col("begin") - F.col("gap.at")).alias("offset"),
    )
    return stay.unionByName(pieces)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids``: little-endian unsigned 32-bit ids, ``end`` behind every document; ``start`` ids of the
    document stand before the piece, ``offset`` ids of the sequence. Every sequence but those of a power
    of two is full. ``capacity``: a multiple of 16.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with frames.batches_of(spark, 4 << 20):
        items = materialize(rows.mapInArrow(_items(tokenizer, end, capacity), _ITEMS), "items")
    pieces = _without_gaps(*_placed(items.drop("ids"), capacity), capacity)
    kept = items.select("part", "place", "doc_id", "start", "doc_tokens", F.col("ids").alias("all"))
    return kept.join(pieces, ["part", "place"]).select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("length").cast("long").alias("length"), "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"),
        F.expr("substring(all, cast(4 * skip + 1 as int), cast(4 * length as int))").alias("ids"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, starts``: whole sequences and where their pieces begin; at most ``capacity`` pieces each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return (
        pieces.groupBy("sequence_id")
        .agg(ordered.alias("parts"))
        .select("sequence_id", (F.octet_length(joined) / 4).cast("long").alias("length"), joined.alias("ids"), F.col("parts.offset").alias("starts"))
    )
