"""Nearest entries of every lookup vector, as one distributed operator.

Every similarity search in this package (top-k search, cluster-pruned search, neighbour graph, cache
lookup, cache replay) is the same job: for each *lookup* find the best *entries*, optionally only
inside some buckets, only above a score, or only among earlier ids. No pair of rows is ever emitted
for that. Spark ships blocks of vectors to the tasks, a task multiplies two blocks and emits at most
``k`` rows per lookup, and one window merges what the tasks found.

How blocks meet depends on sizes that are measured first:

``entries``  the entries fit the broadcast bound: lookups stream past them, nothing is shuffled and
             nothing needs merging;
``lookups``  the lookups fit: entries stream past them, each task keeps its running best;
``grid``     neither fits: both sides are cut into blocks of bounded bytes, bucket by bucket, so a
             bucket that holds a third of all rows is many cells, not one task.

The score that is reported and that decides ties is the double-precision sum from left to right, the
same number as ``functions.vectors.dot``. The block product only preselects, with a margin that covers
its rounding error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softseek.operators.joins import lookup_join

PAIR_SCHEMA = "q_id long, e_id long, pos int, score double"

BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20
MAX_BROADCAST_BUCKETS = 100_000
TASK_FLOPS = 5e9
CELLS_AT_ONCE = 4_000_000
TILE_ENTRIES = 16_384
#: Scores of a row that one maximum stands for.
STRAND = 32
#: Entries that a task streams past all lookups, at least.
TASK_ENTRIES = 16_384
#: Entries whose sets are all held against a lookup's; behind them only the sets of those that score enough.
FIRST_ENTRIES = 2_048


@dataclass(frozen=True)
class Rule:
    """What counts as a match.

    Lookups carry ``q_id``, ``q_vec`` and, as the flags ask, ``q_buckets`` (ordered ids), ``q_floor``,
    ``q_before``, ``q_k`` and ``q_sets``; entries carry ``e_id``, ``e_vec``, ``e_bucket`` and ``e_sets``.
    """

    k: int = 1
    bucketed: bool = False  # only entries in one of the lookup's buckets
    earlier: bool = False  # only entries with e_id < q_id
    before: bool = False  # only entries with e_id < q_before
    floor: bool = False  # only scores >= q_floor
    row_k: bool = False  # q_k results instead of k
    skip_self: bool = False  # not the entry with the lookup's own id
    by_position: bool = False  # equal scores: earlier bucket of the lookup first, then lower e_id
    sets: bool = False  # only entries that share a bit of q_sets and e_sets, which are as many longs in all rows


# ---------------------------------------------------------------------------------- block arithmetic


def vector_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a matrix, one row per vector; every vector must be there."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or lengths.min() != lengths.max():
        raise ValueError("vectors must be present and of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def masked_vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as a matrix, one row per vector, and which rows can match at all.

    A null vector, or one with a null or non-finite component, is a row of zeros that matches nothing.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    valid = np.ones(n, dtype=bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if not valid.any():
        return np.zeros((n, 0)), valid
    present = column.drop_null()
    values = present.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(present.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError("vectors must be of one length")
    matrix = values.reshape(len(present), -1)
    finite = np.isfinite(matrix).all(axis=1)
    if finite.all() and valid.all():
        return matrix, valid
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    out[np.flatnonzero(valid)[finite]] = matrix[finite]
    valid = valid.copy()
    valid[np.flatnonzero(valid)[~finite]] = False
    return out, valid


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added from left to right in double precision."""
    out = np.empty(len(a))
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for at in range(0, len(a), step):
        products = a[at : at + step].astype(np.float64) * b[at : at + step].astype(np.float64)
        out[at : at + step] = np.add.accumulate(products, axis=1)[:, -1]
    return out


def _row_norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))


@dataclass
class Lookups:
    ids: np.ndarray
    vectors: np.ndarray
    k: np.ndarray
    floor: np.ndarray
    # one row per (lookup, bucket), grouped by bucket; a single pseudo bucket when not bucketed
    groups: dict[int, tuple[np.ndarray, np.ndarray]]
    # entries count only below this id
    before: np.ndarray
    # one row of bits per lookup, if the rule asks for them
    sets: np.ndarray | None = None

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, rule: Rule) -> Lookups:
        ids = table.column("q_id").to_numpy()
        n = len(ids)
        k = table.column("q_k").to_numpy() if rule.row_k else np.full(n, rule.k)
        floor = table.column("q_floor").to_numpy() if rule.floor else np.full(n, -np.inf)
        if not rule.bucketed:
            groups = {0: (np.arange(n), np.zeros(n, dtype=np.int32))}
        elif "q_bucket" in table.schema.names:  # one bucket per row already (grid cells)
            pos = table.column("q_pos").to_numpy()
            groups = {int(table.column("q_bucket")[0].as_py()): (np.arange(n), pos)} if n else {}
        else:
            groups = _bucket_groups(table.column("q_buckets"))
        before = table.column("q_before").to_numpy() if rule.before else ids
        vectors, valid = masked_vectors(table.column("q_vec"))
        sets = vector_matrix(table.column("q_sets")) if rule.sets else None
        return Lookups(ids, vectors, np.where(valid, k, 0), floor, groups, before, sets)


def _bucket_groups(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buckets = column.flatten().to_numpy(zero_copy_only=False)
    counts = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(counts)), counts)
    pos = (np.arange(len(buckets)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    return {int(buckets[part[0]]): (rows[part], pos[part]) for part in np.split(order, cuts) if len(part)}


@dataclass
class Entries:
    # bucket -> (ids ascending, vectors)
    groups: dict[int, tuple[np.ndarray, np.ndarray]]
    # bucket -> one row of bits per entry, if the rule asks for them
    sets: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, rule: Rule, max_k: int) -> Entries:
        ids = table.column("e_id").to_numpy()
        vectors, valid = masked_vectors(table.column("e_vec"))
        buckets = table.column("e_bucket").to_numpy() if rule.bucketed else np.zeros(len(ids), dtype=np.int64)
        bits = vector_matrix(table.column("e_sets")) if rule.sets else None
        if not valid.all():
            ids, vectors, buckets = ids[valid], vectors[valid], buckets[valid]
            bits = bits[valid] if rule.sets else None
        order = np.lexsort((ids, buckets))
        cuts = np.flatnonzero(np.diff(buckets[order])) + 1
        keep = max_k + int(rule.skip_self)
        groups, sets = {}, {}
        for part in np.split(order, cuts):
            if len(part):
                # A copy stands for another only where both may be found by the same lookups.
                rows = np.hstack([_words(vectors[part]), _words(bits[part])]) if rule.sets else vectors[part]
                part = part[~_dominated_copies(rows, keep)]
                groups[int(buckets[part[0]])] = (ids[part], vectors[part])
                if rule.sets:
                    sets[int(buckets[part[0]])] = bits[part]
        return Entries(groups, sets)


def _words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint32)


def _dominated_copies(vectors: np.ndarray, keep: int) -> np.ndarray:
    """Rows that can never be reported: ``keep`` identical vectors with lower ids precede them.

    Rows come in id order. Equal vectors score equally for every lookup and the lower id wins, so the
    result stays exact, and a block full of copies costs no more than one of distinct vectors.
    """
    words = _words(vectors).astype(np.uint64)
    odd = np.random.default_rng(7).integers(1, 2**63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = (words * odd).sum(axis=1)
    _, first, group, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    surplus = np.zeros(len(vectors), dtype=bool)
    if counts.max() <= keep:
        return surplus
    same = (vectors == vectors[first[group]]).all(axis=1)
    order = np.argsort(group, kind="stable")
    running = np.cumsum(same[order])
    start = np.cumsum(counts) - counts
    before_group = running[start] - same[order][start]
    rank = running - np.repeat(before_group, counts)
    surplus[order] = same[order] & (rank > keep)
    return surplus


@dataclass
class Found:
    """Matches so far: parallel arrays, at most k per lookup row after ``best``."""

    row: np.ndarray
    score: np.ndarray
    pos: np.ndarray
    eid: np.ndarray

    @staticmethod
    def none() -> Found:
        return Found(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))

    @staticmethod
    def best(parts: Iterable[Found], k: np.ndarray, by_position: bool) -> Found:
        parts = [p for p in parts if len(p.row)]
        if not parts:
            return Found.none()
        row = np.concatenate([p.row for p in parts])
        score = np.concatenate([p.score for p in parts])
        pos = np.concatenate([p.pos for p in parts])
        eid = np.concatenate([p.eid for p in parts])
        order = np.lexsort((eid, pos, -score, row) if by_position else (eid, -score, row))
        row = row[order]
        new = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        order, row = order[rank < k[row]], row[rank < k[row]]
        return Found(row, score[order], pos[order], eid[order])

    def weakest(self, k: np.ndarray) -> np.ndarray:
        """Score of each row's k-th match; -inf while it has fewer than k."""
        counts = np.bincount(self.row, minlength=len(k))
        low = np.full(len(k), np.inf)
        np.minimum.at(low, self.row, self.score)
        return np.where((counts >= k) & (counts > 0), low, -np.inf)

    def batches(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.row), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[self.row[part]], pa.int64()),
                    pa.array(self.eid[part], pa.int64()),
                    pa.array(self.pos[part], pa.int32()),
                    pa.array(self.score[part], pa.float64()),
                ],
                names=["q_id", "e_id", "pos", "score"],
            )


def _match(q: Lookups, entries: Entries, rule: Rule, so_far: Found) -> Found:
    """Best matches of all lookups against one block of entries, merged with ``so_far``."""
    parts = [so_far]
    bar = np.maximum(so_far.weakest(q.k), q.floor)
    for bucket, (rows, pos) in q.groups.items():
        if bucket in entries.groups:
            parts.append(_match_bucket(q, rows, pos, *entries.groups[bucket], entries.sets.get(bucket), rule, bar))
    return Found.best(parts, q.k, rule.by_position)


def _match_bucket(q, rows, pos, e_ids, e_vecs, e_sets, rule: Rule, bar: np.ndarray) -> Found:
    n_e = len(e_ids)
    if not q.k.any():
        return Found.none()
    eps = max(np.finfo(q.vectors.dtype).eps, np.finfo(e_vecs.dtype).eps)
    margin = 2.0 * e_vecs.shape[1] * eps * _row_norms(e_vecs).max()
    # Both sides are cut: a product of a few rows with very many spends its time on copying these.
    step = max(1, CELLS_AT_ONCE // min(n_e, TILE_ENTRIES))
    starts = _growing_starts(n_e) if rule.sets else range(0, n_e, TILE_ENTRIES)
    out = []
    for at in range(0, len(rows), step):
        r, p = rows[at : at + step], pos[at : at + step]
        vecs = q.vectors[r]
        top = int(q.k[r].max())
        if top == 0:
            continue
        near = margin * _row_norms(vecs)
        least, best = bar[r], Found.none()
        for low, high in zip(starts, [*starts[1:], n_e]):
            ids, tile = e_ids[low:high], e_vecs[low:high]
            scores = vecs @ tile.T
            if rule.earlier or rule.before:
                scores[ids[None, :] >= q.before[r][:, None]] = -np.inf
            if rule.skip_self:
                scores[ids[None, :] == q.ids[r][:, None]] = -np.inf
            if rule.sets:
                i, j = _near_top_shared(scores, min(top, len(ids)), least, near, q.sets[r], e_sets[low:high])
            else:
                i, j = _near_top(scores, min(top, len(ids)), least, near)
            exact = exact_scores(vecs[i], tile[j])
            ok = exact >= q.floor[r][i]
            if rule.sets:
                # Rows of this step by their numbers in it: their weakest is what the next entries have to reach.
                best = Found.best([best, Found(i[ok], exact[ok], p[i][ok], ids[j][ok])], q.k[r], rule.by_position)
                least = np.maximum(best.weakest(q.k[r]), bar[r])
            else:
                out.append(Found(r[i][ok], exact[ok], p[i][ok], ids[j][ok]))
            if len(out) > 64:
                out = [Found.best(out, q.k, rule.by_position)]
        if rule.sets:
            out.append(Found(r[best.row], best.score, best.pos, best.eid))
    return Found.best(out, q.k, rule.by_position)


def _growing_starts(n: int) -> list[int]:
    """Starts of tiles that double: the bar that each leaves lets few scores of the next one through."""
    starts, size = [0], FIRST_ENTRIES
    while starts[-1] + size < n:
        starts.append(starts[-1] + size)
        size = min(2 * size, TILE_ENTRIES)
    return starts


def _near_top_shared(
    scores: np.ndarray, k: int, bar: np.ndarray, margin: np.ndarray, own: np.ndarray, other: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``_near_top`` among the columns whose bits ``other`` share one with the row's ``own``.

    A row that has a bar looks up the bits of the few scores that reach it; only without one, all bits are compared.
    """
    low = _rounded_down(bar - margin, scores.dtype)
    free = np.flatnonzero(bar == -np.inf)
    low[free] = np.inf
    i, j = _reaching(scores, low) if len(free) < len(scores) else (free[:0], free[:0])
    held = (own[i] & other[j]).any(axis=1)
    i, j = i[held], j[held]
    if not len(free):
        return i, j
    shared = np.zeros((len(free), len(other)), bool)
    for word in range(own.shape[1]):
        shared |= (own[free, word, None] & other[None, :, word]) != 0
    free_i, free_j = _near_top(np.where(shared, scores[free], -np.inf), k, bar[free], margin[free])
    return np.concatenate([i, free[free_i]]), np.concatenate([j, free_j])


def _near_top(scores: np.ndarray, k: int, bar: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all scores that may be among their row's ``k`` largest and reach the row's ``bar``, up to ``margin``.

    Columns are taken in strands (every ``m``-th column); the ``k``-th largest of the strands' maxima is at most the
    ``k``-th largest score. So one pass over the scores finds the few strands that are looked into at all.
    """
    n, width = scores.shape
    m = width // STRAND
    if m < 4 * k:
        kth = scores.max(axis=1) if k == 1 else np.partition(scores, width - k, axis=1)[:, width - k]
        least = np.maximum(kth.astype(np.float64), bar) - margin
        return np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    tops = _strand_tops(scores)
    kth = tops.max(axis=1) if k == 1 else np.partition(tops, m - k, axis=1)[:, m - k]
    return _reaching(scores, _rounded_down(np.maximum(kth.astype(np.float64), bar) - margin, scores.dtype), tops)


def _rounded_down(least: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """So that scores are compared in their own precision."""
    return np.nextafter(least.astype(dtype), np.array(-np.inf, dtype))


def _strand_tops(scores: np.ndarray) -> np.ndarray:
    n, width = scores.shape
    m = width // STRAND
    return scores[:, : m * STRAND].reshape(n, STRAND, m).max(axis=1)


def _reaching(scores: np.ndarray, low: np.ndarray, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all scores that reach their row's ``low``; only strands whose maximum does are looked into."""
    n, width = scores.shape
    m = width // STRAND
    tops = _strand_tops(scores) if tops is None else tops
    whole, rest = scores[:, : m * STRAND].reshape(n, STRAND, m), scores[:, m * STRAND :]
    i, strand = np.nonzero((tops >= low[:, None]) & (tops > -np.inf))
    at, row = np.nonzero(whole[i, :, strand] >= low[i, None])
    rest_i, rest_j = np.nonzero(rest >= low[:, None])
    i, j = np.concatenate([i[at], rest_i]), np.concatenate([row * m + strand[at], rest_j + m * STRAND])
    held = scores[i, j] > -np.inf
    return i[held], j[held]


# --------------------------------------------------------------------------------- physical strategies


@dataclass(frozen=True)
class Sizes:
    """Measured before the strategy is chosen."""

    lookups: int
    entries: int
    width: int  # bytes of one vector in double precision
    max_k: int
    results: int  # bound on the rows found
    buckets: int = 1  # about how many buckets share the entries
    lookup_parts: int = 0  # partitions that hold lookups, 0 where not measured
    entry_parts: int = 0

    def entries_fit(self, limit: int) -> bool:
        return self.entries * (self.width + 16) <= limit

    def lookups_fit(self, limit: int) -> bool:
        return self.lookups * (self.width + 64) <= limit

    def tasks(self, streamed: int) -> int:
        """Tasks that the arithmetic is worth, at most one per row of the side that is streamed."""
        work = 2.0 * self.lookups * self.entries * self.width / 8 * min(1.0, 2.0 / self.buckets)
        return max(1, int(min(streamed, -(-work // TASK_FLOPS))))


def measure(lookups: DataFrame, entries: DataFrame, rule: Rule) -> Sizes:
    """Row counts and vector width; the counts prune all columns but ``q_k`` and ``e_bucket``."""
    k = F.col("q_k") if rule.row_k else F.lit(rule.k)
    buckets = F.approx_count_distinct("e_bucket") if rule.bucketed else F.lit(1)
    parts = F.max("_part").alias("parts")
    placed = F.spark_partition_id()
    asked = lookups.withColumn("_part", placed).agg(F.count("*").alias("n"), F.max(k).alias("top"), F.sum(k).alias("total"), F.lit(0).alias("buckets"), parts)
    stored = entries.withColumn("_part", placed).agg(F.count("*").alias("n"), F.lit(0).alias("top"), F.lit(0).alias("total"), buckets.alias("buckets"), parts)
    # Two rows of one job.
    both = asked.withColumn("side", F.lit("q")).unionByName(stored.withColumn("side", F.lit("e"))).collect()
    q, e = sorted(both, key=lambda r: r["side"], reverse=True)
    # Bits of sets are held and compared as components are.
    first = entries.select((F.size("e_vec") + (F.size("e_sets") if rule.sets else F.lit(0))).alias("d")).head(1)
    width = 8 * first[0]["d"] if first else 0
    held = [1 + (-1 if r["parts"] is None else r["parts"]) for r in (q, e)]
    return Sizes(q["n"], e["n"], width, int(q["top"] or 0), int(q["total"] or 0), max(1, e["buckets"]), *held)


def nearest_pairs(
    lookups: DataFrame,
    entries: DataFrame,
    rule: Rule,
    *,
    sizes: Sizes | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``q_id, e_id, pos, score, rank`` of the best entries per lookup, rank from 1."""
    q_cols = ["q_id", "q_vec"]
    q_cols += ["q_buckets"] if rule.bucketed else []
    q_cols += ["q_floor"] if rule.floor else []
    q_cols += ["q_before"] if rule.before else []
    q_cols += ["q_k"] if rule.row_k else []
    q_cols += ["q_sets"] if rule.sets else []
    lookups = lookups.select(*q_cols)
    entries = entries.select("e_id", "e_vec", *(["e_bucket"] if rule.bucketed else []), *(["e_sets"] if rule.sets else []))

    sizes = sizes or measure(lookups, entries, rule)
    if sizes.entries_fit(broadcast_bytes):
        found = _entries_everywhere(_spread(lookups, "q_id", sizes.tasks(sizes.lookups), sizes.lookup_parts), entries, rule, sizes.max_k)
    elif sizes.lookups_fit(broadcast_bytes):
        # Every task emits its best for all lookups: it has to see enough entries to be worth that.
        enough = max(sizes.entries // TASK_ENTRIES, lookups.sparkSession.sparkContext.defaultParallelism)
        tasks = min(sizes.tasks(sizes.entries), enough)
        streamed = _spread(entries, "e_id", tasks, sizes.entry_parts)
        found = _lookups_everywhere(lookups, streamed.coalesce(enough) if sizes.entry_parts > enough else streamed, rule, sizes.max_k)
    else:
        found = _grid(lookups, entries, rule, sizes, max(1, block_bytes // max(sizes.width, 1)))

    order = [F.desc("score"), *([F.asc("pos")] if rule.by_position else []), F.asc("e_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= sizes.max_k)
    if rule.row_k:
        ranked = ranked.join(lookups.select("q_id", "q_k"), "q_id").where("rank <= q_k").drop("q_k")
    return ranked


def with_best_match(
    df: DataFrame,
    entries: DataFrame,
    rule: Rule,
    *,
    sizes: Sizes | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df``, which holds the lookup columns among others, plus ``e_id`` and ``score`` of its best entry.

    Rows without a match keep nulls. While the entries fit the broadcast bound this is a pass over
    ``df`` without any shuffle; otherwise the matches are joined back by ``q_id``.
    """
    assert rule.k == 1 and not rule.row_k and not rule.sets
    sizes = sizes or measure(df, entries, rule)
    if not sizes.entries_fit(broadcast_bytes):
        found = nearest_pairs(
            df, entries, rule, sizes=sizes, broadcast_bytes=broadcast_bytes, block_bytes=block_bytes
        )
        return df.join(found.select("q_id", "e_id", "score"), "q_id", "left").select(*df.columns, "e_id", "score")

    # Checked above: the entries fit the broadcast bound.
    columns = ["e_id", "e_vec", "e_bucket"] if rule.bucketed else ["e_id", "e_vec"]
    shared, token = df.sparkSession.sparkContext.broadcast(entries.select(*columns).toArrow()), uuid4().hex
    schema = T.StructType([*df.schema.fields, T.StructField("e_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            n = batch.num_rows
            eid, score, missing = np.zeros(n, np.int64), np.zeros(n), np.ones(n, dtype=bool)
            if n and shared.value.num_rows:
                block = block or _shared_entries(token, shared, rule, 1)
                found = _match(Lookups.of(batch, rule), block, rule, Found.none())
                eid[found.row], score[found.row], missing[found.row] = found.eid, found.score, False
            added = [pa.array(eid, pa.int64(), mask=missing), pa.array(score, pa.float64(), mask=missing)]
            yield pa.RecordBatch.from_arrays(batch.columns + added, names=[*batch.schema.names, "e_id", "score"])

    return _spread(df, "q_id", sizes.tasks(sizes.lookups), sizes.lookup_parts).mapInArrow(task, schema)


_ready: dict[str, Entries] = {}


def _shared_entries(token: str, shared: Broadcast, rule: Rule, max_k: int) -> Entries:
    """Broadcast entries, put in order once per Python worker rather than once per task.

    ``token`` names the broadcast. Only the latest one is kept: a worker serves one stage at a time.
    """
    if token not in _ready:
        _ready.clear()
        _ready[token] = Entries.of(shared.value, rule, max_k)
    return _ready[token]


def _spread(df: DataFrame, key: str, tasks: int, parts: int) -> DataFrame:
    """Stream the partitions as they are, unless there are too few of them for the arithmetic."""
    return df if tasks <= max(1, parts) else df.repartition(tasks, F.xxhash64(key))


def _entries_everywhere(lookups: DataFrame, entries: DataFrame, rule: Rule, max_k: int) -> DataFrame:
    # Checked by the caller: the entries fit the broadcast bound.
    shared, token = lookups.sparkSession.sparkContext.broadcast(entries.toArrow()), uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if batch.num_rows and shared.value.num_rows:
                block = block or _shared_entries(token, shared, rule, max_k)
                q = Lookups.of(batch, rule)
                yield from _match(q, block, rule, Found.none()).batches(q.ids)

    return lookups.mapInArrow(task, PAIR_SCHEMA)


def _lookups_everywhere(lookups: DataFrame, entries: DataFrame, rule: Rule, max_k: int) -> DataFrame:
    # Checked by the caller: the lookups fit the broadcast bound.
    shared = entries.sparkSession.sparkContext.broadcast(lookups.toArrow())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, found = None, Found.none()
        for batch in batches:
            if batch.num_rows and shared.value.num_rows:
                q = q or Lookups.of(shared.value, rule)
                found = _match(q, Entries.of(batch, rule, max_k), rule, found)
        if q is not None:
            yield from found.batches(q.ids)

    return entries.mapInArrow(task, PAIR_SCHEMA)


def _grid(lookups: DataFrame, entries: DataFrame, rule: Rule, sizes: Sizes, block_rows: int) -> DataFrame:
    """Cut every bucket into blocks of ``block_rows`` lookups by ``block_rows`` entries.

    Each lookup is sent once per entry block of its bucket and the other way round. A cell therefore
    costs one block product, which outweighs shipping its two blocks.
    """
    if rule.bucketed:
        q = lookups.select("*", F.posexplode("q_buckets").alias("q_pos", "bucket")).drop("q_buckets")
        q = q.withColumn("bucket", F.col("bucket").cast("long"))
        e = entries.withColumnRenamed("e_bucket", "bucket").withColumn("bucket", F.col("bucket").cast("long"))
    else:
        q = lookups.withColumns({"q_pos": F.lit(0), "bucket": F.lit(0).cast("long")})
        e = entries.withColumn("bucket", F.lit(0).cast("long"))
    counts = (
        q.groupBy("bucket").agg(F.count("*").alias("n_q"))
        .join(e.groupBy("bucket").agg(F.count("*").alias("n_e")), "bucket")
        .select(
            "bucket",
            F.ceil(F.col("n_q") / block_rows).cast("int").alias("q_blocks"),
            F.ceil(F.col("n_e") / block_rows).cast("int").alias("e_blocks"),
        )
    )
    if sizes.buckets <= MAX_BROADCAST_BUCKETS:  # three numbers per bucket
        counts = F.broadcast(counts)
    blocks = F.sequence(F.lit(0), F.col("e_blocks") - 1)
    q = (
        _with_counts(q, counts, sizes)
        .withColumn("q_block", F.pmod(F.xxhash64("q_id"), "q_blocks").cast("int"))
        .withColumn("e_block", F.explode(blocks))
        .drop("q_blocks", "e_blocks")
        .withColumn("q_bucket", F.col("bucket"))
    )
    e = (
        _with_counts(e, counts, sizes)
        .withColumn("e_block", F.pmod(F.xxhash64("e_id"), "e_blocks").cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .drop("q_blocks", "e_blocks")
        .withColumn("e_bucket", F.col("bucket"))
    )
    cell = ["bucket", "q_block", "e_block"]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_ARROW_SCHEMA)
        q_side = Lookups.of(left, rule)
        found = _match(q_side, Entries.of(right, rule, sizes.max_k), rule, Found.none())
        return pa.Table.from_batches(found.batches(q_side.ids), schema=_ARROW_SCHEMA)

    return q.groupBy(*cell).cogroup(e.groupBy(*cell)).applyInArrow(task, PAIR_SCHEMA)


def _with_counts(rows: DataFrame, counts: DataFrame, sizes: Sizes) -> DataFrame:
    """A hot bucket is not shuffled whole: few buckets are broadcast, of many the hot ones are salted."""
    return rows.join(counts, "bucket") if sizes.buckets <= MAX_BROADCAST_BUCKETS else lookup_join(rows, counts, "bucket")


_ARROW_SCHEMA = pa.schema([("q_id", pa.int64()), ("e_id", pa.int64()), ("pos", pa.int32()), ("score", pa.float64())])
