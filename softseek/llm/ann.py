"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stop.

A vector x is lifted by one component to the length of the longest vector; queries are stretched to
that length. Squared distance is then a decreasing function of the inner product. For Gaussian
(2-stable) projections to m dimensions, projected over true squared distance has the chi-square law
with m degrees of freedom, so a vector nearer than d lies within d * sqrt(quantile(confidence)) of
the query in the projection with that confidence. Neighbours are verified in the order of a
kd-tree's leaves around the projected query, in doubling rounds, until the next leaf is farther than
that for the k-th best distance so far. (Sun et al., SRS, 2014.)

The upper part of the tree is fitted on a bounded sample and deals all vectors into cells; each
cell is indexed where it is searched. A query is searched in its own cell, then in the cells that
its radius reaches. Copies of a vector beyond the k + 1 of smallest id can never be among k results
and are not indexed; queries with one vector are searched once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softseek.session import materialize

LEAF = 64
BATCH = 512


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile for an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Projection:
    """``longest``: length of the longest vector times ``scale``, a power of two that keeps squares of
    very large or small components in range; ``project`` gives the images of stretched queries
    (``lifted`` false) or lifted vectors."""

    def __init__(self, width: int, m: int, longest: float, seed: int, scale: float = 1.0):
        self.longest, self.scale = longest, scale
        self.axes = np.random.default_rng(seed).standard_normal((width + 1, m))

    def project(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        if not lifted:
            return x * (self.longest / lengths(x))[:, None] @ self.axes[:-1]
        x = x * self.scale
        extra = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return x @ self.axes[:-1] + extra[:, None] * self.axes[-1]

    def stretched(self, scores: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Inner products of lifted vectors with stretched queries, from those of the originals."""
        return scores / norms * (self.scale * self.longest)


def lengths(x: np.ndarray) -> np.ndarray:
    """Of vectors that are not zero, without squaring their components as they are."""
    largest = np.abs(x).max(axis=1)
    return largest * np.sqrt(((x / largest[:, None]) ** 2).sum(axis=1))


def split(points: np.ndarray, leaves: int, least: int) -> list:
    """kd-tree as nested ``[axis, value, left, right]``; a leaf is the array of its point numbers."""

    def build(own: np.ndarray, leaves: int):
        if leaves <= 1 or len(own) <= least:
            return own
        p = points[own]
        axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        half = leaves // 2
        at = min(max(len(own) * half // leaves, 1), len(own) - 1)
        order = np.argpartition(p[:, axis], at)
        value = p[order[at], axis]
        below = p[:, axis] < value
        if not below.any():  # half of the points and more share the smallest value
            below = np.zeros(len(own), bool)
            below[order[:at]] = True
        return [axis, float(value), build(own[below], half), build(own[~below], leaves - half)]

    return build(np.arange(len(points)), leaves)


def _leaves(tree) -> list:
    return _leaves(tree[2]) + _leaves(tree[3]) if isinstance(tree, list) else [tree]


def numbered(tree, count: list[int] | None = None):
    """The tree with leaf numbers in place of points."""
    count = [0] if count is None else count
    if isinstance(tree, list):
        return [tree[0], tree[1], numbered(tree[2], count), numbered(tree[3], count)]
    count[0] += 1
    return count[0] - 1


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def walk(node, own: np.ndarray) -> None:
        if isinstance(node, list):
            below = points[own, node[0]] < node[1]
            walk(node[2], own[below])
            walk(node[3], own[~below])
        else:
            out[own] = node

    walk(tree, np.arange(len(points)))
    return out


def cells_within(tree, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point number, cell) of all cells within a squared distance of each point."""
    numbers, cells = [], []

    def walk(node, own: np.ndarray, offset: np.ndarray) -> None:
        if not len(own):
            return
        if not isinstance(node, list):
            numbers.append(own)
            cells.append(np.full(len(own), node, np.int32))
            return
        axis, value = node[:2]
        beyond = offset.copy()
        beyond[:, axis] = np.maximum(beyond[:, axis], np.abs(points[own, axis] - value))
        close = (beyond * beyond).sum(axis=1) <= radius[own] * (1 + 1e-9)
        below = points[own, axis] < value
        for child, near in ((node[2], below), (node[3], ~below)):
            far = ~near & close
            walk(child, np.concatenate([own[near], own[far]]), np.concatenate([offset[near], beyond[far]]))

    walk(tree, np.arange(len(points)), np.zeros(points.shape))
    return np.concatenate(numbers), np.concatenate(cells)


def _box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for i in range(points.shape[1]):
        p = points[:, i : i + 1]
        out += np.maximum(np.maximum(low[:, i] - p, p - high[:, i]), 0) ** 2
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


class Best:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, at = np.unique(query, return_inverse=True)
        k = self.k
        query = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        scores = np.concatenate([self.score[touched].ravel(), scores])
        order = np.lexsort((ids, -scores, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[rank < k]
        self.id[touched], self.score[touched] = ids[order].reshape(-1, k), scores[order].reshape(-1, k)


def search_cell(
    ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, projection: Projection, factor: float
) -> Best:
    """k best of one cell for each query that can beat ``bounds`` (k-th scores known so far).

    ``factor``: the chi-square quantile.
    """
    points = projection.project(vectors, lifted=True)
    leaves = _leaves(split(points, max(1, len(points) // LEAF), LEAF))
    low = np.array([points[own].min(axis=0) for own in leaves])
    high = np.array([points[own].max(axis=0) for own in leaves])
    best = Best(len(queries), k)
    for start in range(0, len(queries), BATCH):
        q = queries[start : start + BATCH]
        norms = lengths(q)
        far = _box_distances(projection.project(q, lifted=False), low, high)
        near = np.argsort(far, axis=1, kind="stable")
        done, step = 0, 1
        while done < len(leaves):
            kth = np.maximum(best.score[start : start + len(q), -1], bounds[start : start + len(q)])
            # Squared true distance of the k-th: 2 (L * L - stretched score).
            radius = factor * np.maximum(2 * (projection.longest**2 - projection.stretched(kth, norms)), 0)
            ranks = near[:, done : done + step]
            wanted = np.take_along_axis(far, ranks, axis=1) <= radius[:, None] * (1 + 1e-9)
            if not wanted.any():
                break
            who, which = np.nonzero(wanted)
            leaf = ranks[who, which]
            order = np.argsort(leaf, kind="stable")
            found = []
            for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                own, ask = leaves[leaf[group[0]]], who[group]
                scores = q[ask] @ vectors[own].T
                a, b = np.nonzero(scores >= kth[ask][:, None] - 1e-9 * np.abs(kth[ask][:, None]) if np.isfinite(kth[ask]).all() else scores > -np.inf)
                found.append((ask[a], own[b]))
            ask, own = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            if len(ask):  # summed row by row, so that equal vectors have equal scores
                best.add(ask + start, ids[own], np.concatenate([(q[ask[i : i + 65536]] * vectors[own[i : i + 65536]]).sum(axis=1) for i in range(0, len(ask), 65536)]))
            done, step = done + step, min(2 * step, 256)
    return best


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def _search(shared, k: int, factor: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        asked = right.column("query_id").to_numpy()
        bounds = right.column("bound").to_numpy()
        ids = left.column("vec_id").to_numpy()
        best = search_cell(ids, _matrix(left.column("embedding")), _matrix(right.column("embedding")), bounds, k, shared.value[0], factor)
        held = best.id < np.iinfo(np.int64).max
        return pa.table([np.repeat(asked, held.sum(axis=1)), best.id[held], best.score[held]], schema=_FOUND)

    return run


def _cells(shared, lifted: bool):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                projection, tree = shared.value
                points = projection.project(_matrix(pa.chunked_array([batch.column("embedding")])), lifted)
                extra = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), points.shape[1]).cast(pa.list_(pa.float64()))
                columns = [batch.column(0), batch.column(1), pa.array(cell_of(tree, points)), extra]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:2], "cell", "image"])

    return run


def _reached(shared):
    """The cells besides its own that a query's radius reaches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tree = shared.value[1]
                images = _matrix(pa.chunked_array([batch.column("image")]))
                at, cell = cells_within(tree, images, batch.column("radius").to_numpy())
                other = batch.column("cell").to_numpy()[at] != cell
                at, cell = pa.array(at[other]), pa.array(cell[other])
                taken = [batch.column(c).take(at) for c in ("query_id", "embedding", "bound")]
                yield pa.RecordBatch.from_arrays([*taken[:2], cell, taken[2]], names=["query_id", "embedding", "cell", "bound"])

    return run


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not all zero, and finite throughout."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull()).where(finite).where(F.exists(x, lambda v: v != 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    dimensions: int = 8,
    confidence: float = 0.96,
    cell_rows: int = 16_384,
    query_rows: int = 4_096,
    sample_rows: int = 20_000,
    seed: int = 5,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries(query_id, embedding)`` the ``k`` vectors of
    largest inner product found among ``vectors(vec_id, embedding)``, itself (equal id) left out.

    Scores are double sums over the original vectors; ties go to the smaller vec_id. Vectors that
    ``usable`` refuses, rows without id and vectors of another length than most have take no part.
    Rows repeated with one id and vector count once; an empty table gives no rows.
    ``confidence`` is the chance that a true neighbour lies within the radius searched.
    """
    if dimensions % 2:
        raise ValueError("dimensions is even")
    spark = vectors.sparkSession
    valid = usable(vectors).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    largest = F.array_max(F.transform("embedding", F.abs))
    widths = valid.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(largest).alias("largest"))
    width = widths.orderBy(F.desc("n"), "width").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fits = F.size("embedding") == width["width"]
    longest, scale = math.sqrt(width["square"]), 1.0
    if not 1e-100 < longest < 1e100:  # squares leave the range of doubles
        scale = 2.0 ** -math.frexp(width["largest"])[1]
        scaled = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * F.lit(scale) * (v * F.lit(scale)))
        longest = math.sqrt(valid.where(fits).agg(F.max(scaled)).first()[0])
    hashes = [F.xxhash64("embedding").alias("_h"), F.xxhash64(F.lit(1), "embedding").alias("_g")]
    copy = F.dense_rank().over(Window.partitionBy("_h", "_g").orderBy("vec_id"))
    index = valid.where(fits).select("*", *hashes).withColumn("_copy", copy).where(F.col("_copy") <= k + 1)
    index = materialize(index.dropDuplicates(["_h", "_g", "vec_id"]).select("vec_id", "embedding"), "vectors")
    asked = usable(queries).where(fits & F.col("query_id").isNotNull())
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.select("*", *hashes).dropDuplicates(["_h", "_g", "query_id"])
    first = asked.groupBy("_h", "_g").agg(F.min("query_id").alias("first"))
    asked = asked.join(first, ["_h", "_g"]).drop("_h", "_g")
    asked = materialize(asked, "queries")

    sample = index.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(sample_rows).toArrow()
    projection = Projection(width["width"], dimensions, longest, seed, scale)
    cells = max(1, -(-index.count() // cell_rows))
    tree = numbered(split(projection.project(_matrix(sample.column("embedding")), lifted=True), cells, 1)) if cells > 1 else 0
    shared = spark.sparkContext.broadcast((projection, tree))
    factor = chi_square_quantile(confidence, dimensions)

    placed = materialize(index.mapInArrow(_cells(shared, True), "vec_id long, embedding array<double>, cell int, image array<double>"), "cells")
    heads = asked.where("query_id = first").select("query_id", "embedding")
    heads = materialize(heads.mapInArrow(_cells(shared, False), "query_id long, embedding array<double>, cell int, image array<double>"), "heads")
    stock = placed.select("cell", "vec_id", "embedding")

    def searched(wanted: DataFrame, label: str) -> DataFrame:
        """``wanted``: cell, query_id, embedding, bound; in groups of bounded size."""
        groups = wanted.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("long").alias("groups"))
        dealt = wanted.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")))
        tasks = groups.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
        left = stock.join(tasks, "cell").groupBy("cell", "group")
        found = left.cogroup(dealt.groupBy("cell", "group")).applyInArrow(_search(shared, k + 1, factor), FOUND_SCHEMA)
        return materialize(found, label)

    home = searched(heads.select("cell", "query_id", "embedding", F.lit(float("-inf")).alias("bound")), "home")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = home.withColumn("rank", F.row_number().over(order))
    bounds = ranked.where(F.col("rank") == k + 1).select("query_id", F.col("score").alias("bound"))
    length = F.lit(longest)
    ratio = F.aggregate(F.transform("embedding", lambda v: v / largest), F.lit(0.0), lambda a, v: a + v * v)
    own = largest * F.sqrt(ratio)
    routed = heads.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    routed = routed.withColumn("radius", F.greatest(F.lit(factor) * 2 * (length * length - F.col("bound") / own * (F.lit(scale) * length)), F.lit(0.0)))
    routed = routed.select("query_id", "embedding", "cell", "image", "radius", "bound")
    reached = routed.mapInArrow(_reached(shared), "query_id long, embedding array<double>, cell int, bound double")
    reached = materialize(reached, "reached")
    away = searched(reached, "away")

    best = home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    best = best.withColumnRenamed("query_id", "first").drop("rank")
    found = asked.select("query_id", "first").join(best, "first").where("query_id <> vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
