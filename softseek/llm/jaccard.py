"""Exact Jaccard join of word shingle sets as a join in a metric space.

Jaccard distance d = 1 - |x & y| / |x | y| obeys the triangle inequality. Two documents that link
(d <= eps) are found in the region of a pivot:

1. *Support.* Sets are walked in the order of their hashes. A document can only link when enough
   of its first hashes occur in another document's first hashes; most documents end here. Only
   4-byte hashes travel, packed per block of documents and range of hashes.
2. *Pivots.* Of the documents left, the rarest shingles of each set (as many as a linked document
   may miss, plus one) are its entries to regions. The smallest document that holds a shingle is
   its pivot. Linked documents share one of these shingles, hence a pivot. Documents at distance 1
   from every pivot drop out; a plain Voronoi division would have to compare them all, as they
   are all equally far from any pivot.
3. *Regions.* A region that fits in a task is joined there: documents are compared with those of
   other components only, within the triangle windows of the documents compared before.
4. *Large regions* are divided again: further pivots, distances of all members to them, Voronoi
   cells cut into rings of width eps. Members of the component that holds most pivots' neighbours
   need no comparison among themselves; each other member is replicated to exactly those rings
   that its windows reach.

Nothing here caps a group, and no pair is emitted but links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softseek.llm import words as W
from softseek.llm.components import components
from softseek.session import materialize

BLOCK_BYTES = 4 << 20
HASH_BITS = np.uint64(32)


# ---- sets -------------------------------------------------------------------------------------


def _need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap with a set of this size: ceil(percent * n / 100)."""
    return -((-percent * n) // 100)


def _extra(n: int) -> int:
    """How many common hashes the support step asks for."""
    return 1 + (3 * n) // 20


def _fingerprint(shingles: np.ndarray) -> bytes:
    twice = W.mix(shingles + W.spread(1))
    return np.array([shingles.sum(dtype=np.uint64), twice.sum(dtype=np.uint64)]).tobytes()


def _arrow_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    data, offsets = W.string_bytes(batch.column("text"))
    words, begins = W.word_hashes(data, offsets)
    return W.shingle_sets(words, begins, k)


def _packed(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=True)], schema)


SUPPORT_SCHEMA = "part int, block long, ordinals binary, doc_id long, ordinal int, n long, print binary, hashes binary"
_SUPPORT = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("ordinals", pa.binary()), ("doc_id", pa.int64()),
     ("ordinal", pa.int32()), ("n", pa.int64()), ("print", pa.binary()), ("hashes", pa.binary())]
)


def _support_rows(k: int, percent: int, parts: int):
    """Per document a row with its size and fingerprint (part null); per block and range of hashes
    the distinct first hashes of the block's documents (doc_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for chunk in W.chunks(batches, "text", BLOCK_BYTES):
            sets = _arrow_sets(chunk, k)
            ids = chunk.column("doc_id").to_pylist()
            rows = [
                (None, block, None, doc_id, i, len(s), _fingerprint(s), None)
                for i, (doc_id, s) in enumerate(zip(ids, sets, strict=True))
            ]
            firsts = [s[: len(s) - _need(len(s), percent) + _extra(len(s))] for s in sets]
            every = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(firsts), dtype=np.int32), [len(f) for f in firsts])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            fresh = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else order
            alone = np.diff(np.append(fresh, len(every))) == 1
            # A hash that several documents of the block hold counts for all of them here already.
            several = np.ones(len(every), bool)
            several[fresh[alone]] = False
            here = np.bincount(owner[several], minlength=len(sets))
            distinct, holder = every[fresh], np.where(alone, owner[fresh], -1).astype(np.int32)
            part = _part(distinct, parts)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            low = distinct.astype(np.uint32)
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[p], cuts[p + 1]
                rows.append((p, block, holder[a:b].tobytes(), None, None, None, None, low[a:b].tobytes()))
            counted = np.flatnonzero(here)
            own = np.repeat(counted, here[counted]).astype(np.int32)
            if len(own):
                rows.append((-1, block, own.tobytes(), None, None, None, None, None))
            yield _packed(_SUPPORT.names, rows, _SUPPORT)
            block += 1

    return run


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Range of the hash, by its upper half; sorted as the hashes are."""
    return ((hashes >> HASH_BITS) * np.uint64(parts) >> HASH_BITS).astype(np.int64)


_SHARED = pa.schema([("block", pa.int64()), ("ordinals", pa.binary())])
SHARED_SCHEMA = "block long, ordinals binary"
_COUNTS = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("shared", pa.int64())])
COUNTS_SCHEMA = "block long, ordinal int, shared long"


def _count(table: pa.Table) -> pa.Table:
    """Entries per document of a block."""
    own = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("ordinals").to_pylist()])
    ordinals, n = np.unique(own, return_counts=True)
    block = table.column("block")[0].as_py()
    return pa.table([np.full(len(n), block, np.int64), ordinals, n.astype(np.int64)], schema=_COUNTS)


def _shared(table: pa.Table) -> pa.Table:
    """Per block the document of each of its hashes that another document holds too."""
    blocks = table.column("block").to_pylist()
    holders = [np.frombuffer(x, np.int32) for x in table.column("ordinals").to_pylist()]
    hashes = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    every = np.concatenate(hashes)
    # A hash held by several documents of one block is entered twice: it is shared in any case.
    twice = np.concatenate([h[o < 0] for h, o in zip(hashes, holders, strict=True)])
    both = np.sort(np.concatenate([every, twice]))
    common = np.unique(both[1:][both[1:] == both[:-1]])
    owners = [o[(o >= 0) & _in_sorted(h, common)] for h, o in zip(hashes, holders, strict=True)]
    rows = [(block, o.tobytes()) for block, o in zip(blocks, owners, strict=True) if len(o)]
    return pa.Table.from_batches([_packed(_SHARED.names, rows, _SHARED)])


def _in_sorted(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


# ---- rare shingles ----------------------------------------------------------------------------

_SETS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.binary())])
SETS_SCHEMA = "block long, doc_id long, shingles binary"
_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
PACKED_SCHEMA = "part int, block long, hashes binary, counts binary"
_REPLY = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("counts", pa.binary())])
REPLY_SCHEMA = "part int, block long, counts binary"
_ENTRIES = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64())])
ENTRIES_SCHEMA = "shingle long, doc_id long"


def _set_rows(k: int):
    """Sets of the documents whose fingerprint is the one asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for chunk in W.chunks(batches, "text", BLOCK_BYTES):
            asked = chunk.column("print").to_pylist()
            ids = chunk.column("doc_id").to_pylist()
            rows = [
                (block, doc_id, s.tobytes())
                for doc_id, s, fingerprint in zip(ids, _arrow_sets(chunk, k), asked, strict=True)
                if len(s) and _fingerprint(s) == fingerprint
            ]
            yield _packed(_SETS.names, rows, _SETS)
            block += 1

    return run


def _unpack(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _block_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(sets), return_counts=True)


def _pack_block(parts: int):
    """Distinct hashes of a block and how many of its documents hold each, by range."""

    def run(table: pa.Table) -> pa.Table:
        distinct, n = _block_hashes(_unpack(table.column("shingles")))
        cuts = np.searchsorted(_part(distinct, parts), np.arange(parts + 1))
        low, n, block = distinct.astype(np.uint32), n.astype(np.uint32), table.column("block")[0].as_py()
        rows = [
            (p, block, low[cuts[p] : cuts[p + 1]].tobytes(), n[cuts[p] : cuts[p + 1]].tobytes())
            for p in np.flatnonzero(np.diff(cuts)).tolist()
        ]
        return pa.Table.from_batches([_packed(_PACKED.names, rows, _PACKED)])

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Per block its counts summed over all blocks, in the order of its hashes."""
    hashes = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.uint32)
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    replies = [x.tobytes() for x in np.split(total[at], ends)]
    return pa.table([table.column("part"), table.column("block"), pa.array(replies, pa.binary())], schema=_REPLY)


def _entries(percent: int):
    """The rarest shingles of each set, without those that no other document has."""

    def run(sets: pa.Table, replies: pa.Table) -> pa.Table:
        if not sets.num_rows:
            return _ENTRIES.empty_table()
        own = _unpack(sets.column("shingles"))
        distinct, _ = _block_hashes(own)
        by_part = replies.sort_by("part")
        frequency = np.concatenate([np.frombuffer(x, np.uint32) for x in by_part.column("counts").to_pylist()])
        shingles, docs = [], []
        for doc_id, s in zip(sets.column("doc_id").to_pylist(), own, strict=True):
            held = frequency[np.searchsorted(distinct, s)]
            first = np.lexsort((s, held))[: len(s) - _need(len(s), percent) + 1]
            first = first[held[first] > 1]
            shingles.append(s[first].view(np.int64))
            docs.append(np.full(len(first), doc_id, np.int64))
        return pa.table([np.concatenate(shingles), np.concatenate(docs)], schema=_ENTRIES)

    return run


# ---- regions ----------------------------------------------------------------------------------

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS_SCHEMA = "a long, b long"


class Members:
    """Sets of a task with an inverted index, for overlaps of one set with all."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.n = np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner, every = owner[order], every[order]
        self.first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else order
        self.value, self.end = every[self.first], np.append(self.first[1:], len(every))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.value, s), len(self.value) - 1)
        at = at[self.value[at] == s]
        first, size = self.first[at], self.end[at] - self.first[at]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        return np.bincount(self.owner[where], minlength=len(self.n))


def _linked(common: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + sizes - common)


def _distance(common: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return 1.0 - common / (n + sizes - common)


def _joined(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a region.

    Every document outside the largest component is compared with all others, so no link between
    two components is missed; documents of one component are not compared any further.
    """
    members, eps = Members(ids, sets), 1.0 - percent / 100 + 1e-9
    label = np.arange(len(sets))
    done = np.zeros(len(sets), bool)
    size = np.ones(len(sets), np.int64)
    links, seen = [], []
    while True:
        largest = int(np.argmax(size))
        left = np.flatnonzero(~done & (label != largest)) if len(sets) > 1 else np.zeros(0, int)
        if not len(left):
            return links
        x = int(left[0])
        done[x] = True
        other = (label != label[x]) & (members.n * 100 >= percent * members.n[x]) & (members.n[x] * 100 >= percent * members.n)
        for distances in seen:
            other &= np.abs(distances - distances[x]) <= eps
        if not other.any():
            continue
        common = members.overlaps(sets[x])
        if len(seen) < 16:
            seen.append(_distance(common, members.n[x], members.n))
        for y in np.flatnonzero(other & _linked(common, members.n[x], members.n, percent)).tolist():
            old, new = label[y], label[x]
            if old != new:
                links.append((ids[x], ids[y]))
                size[new] += size[old]
                size[old] = 0
                label[label == old] = new


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_batches([_packed(["a", "b"], links, _LINKS)])


def _join_regions(percent: int):
    """Links of a bundle of whole regions."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pivot")
        ids, sets = table.column("doc_id").to_pylist(), _unpack(table.column("shingles"))
        pivots = table.column("pivot").to_numpy()
        cuts = [0, *(np.flatnonzero(pivots[1:] != pivots[:-1]) + 1).tolist(), len(ids)]
        return _link_table([x for a, b in zip(cuts, cuts[1:]) for x in _joined(ids[a:b], sets[a:b], percent)])  # noqa: B905, RUF007

    return run


_NEAR = pa.schema(
    [("pivot", pa.int64()), ("doc_id", pa.int64()), ("near", pa.list_(pa.int64())),
     ("centers", pa.list_(pa.int64())), ("distances", pa.list_(pa.float64()))]
)
NEAR_SCHEMA = "pivot long, doc_id long, near array<long>, centers array<long>, distances array<double>"


def _distances(percent: int):
    """Distances of a slice of a region's members to the region's further pivots."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        centers, rows = right.column("center").to_pylist(), []
        if left.num_rows and centers:
            ids, sets = left.column("doc_id").to_pylist(), _unpack(left.column("shingles"))
            members, pivot = Members(ids, sets), left.column("pivot")[0].as_py()
            own = _unpack(right.column("shingles"))
            common = np.stack([members.overlaps(s) for s in own])
            far = np.stack([_distance(c, len(s), members.n) for c, s in zip(common, own, strict=True)])
            near = np.stack([_linked(c, len(s), members.n, percent) for c, s in zip(common, own, strict=True)])
            for i, doc_id in enumerate(ids):
                rows.append((pivot, doc_id, [centers[j] for j in np.flatnonzero(near[:, i])], centers, far[:, i].tolist()))
        return pa.Table.from_batches([_packed(_NEAR.names, rows, _NEAR)])

    return run


def _cross(percent: int):
    """Links between members that wander and one ring of members."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = []
        if left.num_rows and right.num_rows:
            ids, sets = left.column("doc_id").to_pylist(), _unpack(left.column("shingles"))
            members = Members(ids, sets)
            for doc_id, s in zip(right.column("doc_id").to_pylist(), _unpack(right.column("shingles")), strict=True):
                hit = np.flatnonzero(_linked(members.overlaps(s), len(s), members.n, percent))
                links += [(doc_id, ids[y]) for y in hit.tolist() if ids[y] != doc_id]
        return _link_table(links)

    return run


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns, told apart from those of another table with the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _salt(column: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(column), n).cast("int")


def _large_regions(members: DataFrame, sets: DataFrame, percent: int, cap: int, pivots: int) -> DataFrame:
    """Links that join components of regions with more than ``cap`` members. ``members``: pivot, doc_id, size."""
    eps = 1.0 - percent / 100
    sliced = materialize(members.withColumn("slice", _salt("doc_id", F.ceil(F.col("size") / F.lit(cap)).cast("long"))), "members")
    rank = F.row_number().over(Window.partitionBy("pivot", "slice").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = sliced.withColumn("rank", rank).where(F.col("rank") <= pivots)
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("doc_id"), "doc_id"))
    centers = first.withColumn("rank", rank).where(F.col("rank") <= pivots)
    slices = sliced.select("pivot", "slice").distinct()
    packs = centers.join(sets, "doc_id").select("pivot", F.col("doc_id").alias("center"), "shingles").join(slices, "pivot")
    near = (
        sliced.join(sets, "doc_id").groupBy("pivot", "slice")
        .cogroup(_renewed(packs).groupBy("pivot", "slice")).applyInArrow(_distances(percent), NEAR_SCHEMA)
    )
    near = materialize(near, "distances")

    # Links to the pivots, and what they join.
    links = near.select(F.col("doc_id").alias("a"), F.explode("near").alias("b")).where("a <> b")
    joined = near.where(F.size("near") > 0).select("pivot", F.array_min("near").alias("a"), F.explode("near").alias("b"))
    pairs = joined.select("pivot", "a", "b").distinct()
    labels = pairs.groupBy("pivot").applyInArrow(_pivot_labels, "pivot long, center long, component long")
    home = near.where(F.size("near") > 0).select("pivot", "doc_id", F.array_min("near").alias("center"))
    home = home.join(labels, ["pivot", "center"])
    main = home.groupBy("pivot", "component").count()
    main = main.groupBy("pivot").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    settled = home.join(main, "pivot").where("component = main").select("pivot", "doc_id")

    # Voronoi cells cut into rings, and the members that wander through them.
    nearest = F.expr("array_min(zip_with(distances, centers, (d, c) -> struct(d, c)))")
    cells = near.select("pivot", "doc_id", "centers", "distances", nearest.alias("nearest")).select(
        "*", F.col("nearest.c").alias("cell"), F.col("nearest.d").alias("to_cell")
    )
    cells = cells.withColumn("ring", F.floor(F.col("to_cell") / F.lit(eps)).cast("int"))
    keys = ["pivot", "cell", "ring"]
    rings = cells.groupBy(*keys).agg(F.count("*").alias("held"), F.min("to_cell").alias("low"), F.max("to_cell").alias("high"))
    rings = rings.withColumn("salts", F.ceil(F.col("held") / F.lit(cap)).cast("long"))
    held = cells.select(*keys, "doc_id").join(rings.select(*keys, "salts"), keys)
    held = held.withColumn("salt", _salt("doc_id", F.col("salts")))
    wander = cells.join(settled, ["pivot", "doc_id"], "left_anti")
    wanderers = wander.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(cap)).cast("long").alias("groups"))
    targets = wander.join(wanderers, "pivot").select(
        "pivot", "doc_id", _salt("doc_id", F.col("groups")).alias("group"),
        F.explode(F.arrays_zip(F.col("centers").alias("cell"), F.col("distances").alias("far"))).alias("to"),
    ).select("pivot", "doc_id", "group", F.col("to.cell").alias("cell"), F.col("to.far").alias("far"))
    targets = targets.join(rings, ["pivot", "cell"]).where(
        (F.col("far") >= F.col("low") - eps - 1e-9) & (F.col("far") <= F.col("high") + eps + 1e-9)
    )
    targets = targets.select(*keys, "doc_id", "group", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"))
    targets = materialize(targets, "targets")
    tasks = targets.select(*keys, "salt", "group").distinct()
    names = [*keys, "salt", "group"]
    left = held.join(tasks, [*keys, "salt"]).join(sets, "doc_id").select(*names, "doc_id", "shingles")
    right = _renewed(targets.join(sets, "doc_id").select(*names, "doc_id", "shingles"))
    found = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(_cross(percent), LINKS_SCHEMA)
    return links.unionByName(found)


def _pivot_labels(table: pa.Table) -> pa.Table:
    """Components of a region's pivots, which are few, by shared neighbours."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x] = root.setdefault(root[x], root[x])
        return x

    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    pivot = table.column("pivot")[0].as_py()
    centers = sorted(root)
    return pa.table([pa.array([pivot] * len(centers), pa.int64()), pa.array(centers, pa.int64()),
                     pa.array([find(c) for c in centers], pa.int64())], ["pivot", "center", "component"])


# ---- the join ---------------------------------------------------------------------------------


def jaccard_join(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    region_documents: int = 1000,
    region_pivots: int = 24,
    broadcast_ids: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """``(sets, links)`` of ``docs(doc_id long, text)``; other columns are ignored.

    ``sets``: doc_id, n (distinct shingles), print (fingerprint of the set, equal for equal sets).
    ``links``: a, b, links between documents with different sets, enough of them to connect every
    component of the relation 100 * intersection >= percent * union; each is a link itself. A set
    is represented by its smallest doc_id.

    Null and blank texts have no shingle and link with nothing; texts of fewer words than
    ``shingle_words`` have one, the whole sequence. Rows that repeat link as copies do. A row
    without doc_id links with nothing. Shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = max(8, 2 * docs.select("text").rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    support = materialize(rows.mapInArrow(_support_rows(shingle_words, percent, parts), SUPPORT_SCHEMA), "support")

    packed = support.where("part >= 0").select("part", "block", "ordinals", "hashes")
    shared = packed.groupBy("part").applyInArrow(_shared, SHARED_SCHEMA)
    shared = shared.unionByName(support.where("part = -1").select("block", "ordinals"))
    shared = shared.groupBy("block").applyInArrow(_count, COUNTS_SCHEMA)
    each = support.where("part is null").select("block", "ordinal", "doc_id", "n", "print")
    least = F.expr(f"1 + 3 * ((n * {percent} + 99) div 100) div 20")
    left = each.where("n > 0 and doc_id is not null").join(shared, ["block", "ordinal"]).where(F.col("shared") >= least)
    left = materialize(left.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "supported")

    ids = F.broadcast(left) if left.count() <= broadcast_ids else left
    asked = rows.join(ids, "doc_id")
    sets = materialize(asked.mapInArrow(_set_rows(shingle_words), SETS_SCHEMA), "sets")
    packed = sets.groupBy("block").applyInArrow(_pack_block(parts), PACKED_SCHEMA)
    replies = packed.groupBy("part").applyInArrow(_frequencies, REPLY_SCHEMA)
    entries = sets.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_entries(percent), ENTRIES_SCHEMA)
    entries = materialize(entries, "entries")

    pivots = entries.groupBy("shingle").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
    pivots = pivots.where("pivot < last").select("shingle", "pivot")
    members = entries.join(pivots, "shingle").select("pivot", "doc_id").distinct()
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size"))
    members = materialize(members.join(sizes, "pivot"), "regions")
    own = sets.select("doc_id", "shingles")
    small = members.where(F.col("size") <= region_documents)
    bundles = max(parts, small.count() // (4 * region_documents))
    small = small.withColumn("bundle", _salt("pivot", F.lit(bundles))).join(own, "doc_id")
    small = small.select("bundle", "pivot", "doc_id", "shingles")
    links = small.groupBy("bundle").applyInArrow(_join_regions(percent), LINKS_SCHEMA)
    large = members.where(F.col("size") > region_documents)
    if large.head(1):
        links = links.unionByName(_large_regions(large, own, percent, region_documents, region_pivots))
    return each.select("doc_id", "n", "print"), materialize(links, "found")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id`` (the smallest doc_id reachable by links).

    Equal sets link; an empty set links with nothing and is its own component.
    """
    sets, links = jaccard_join(docs, shingle_words, percent, **options)
    linking = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    copies = sets.where(linking).groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("held"))
    groups = components(links)
    classes = copies.join(groups, copies["first"] == groups["node"], "left").where("held > 1 or node is not null")
    classes = materialize(classes.select("print", F.coalesce("component", "first").alias("component_id")), "classes")
    return (
        sets.join(classes, (sets["print"] == classes["print"]) & linking, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
