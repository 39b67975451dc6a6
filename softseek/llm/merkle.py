"""Merkle manifest of a table: a tree per source, a tree over the sources, stored every few levels only.

A tree's nodes stand in order; each run of ``fanout`` neighbours is hashed into one node of the level
above (the last run may be shorter, even one node) until a single node remains. Of all levels only every
``every``-th is written: the nodes below one stored node are an aligned subtree of at most
``fanout ** every`` stored descendants, which one task folds. A proof walks down again: every aligned
subtree is regenerated from its stored descendants, the siblings on the way of each descendant are
emitted behind those of the levels above, and the interior nodes are forgotten.

Digests are lower-case hexadecimal SHA-256 of the concatenated digests of a run, as text. Rows of a
source stand by key (null first), rows that share a key by their digest. An empty table has no root.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODE = "tree string, pos long, node string"
#: A node's proof: what stands before and behind it in its run, level by level, and the digests above it.
PROOF = "before array<string>, after array<string>, tops array<string>"


def row_digest(*columns: str | Column) -> Column:
    """Digest of values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    marked = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*marked), 256)


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _climb(nodes: list[str], alone: bool, fanout: int, every: int) -> list[list[str]]:
    """The levels of an aligned subtree from its stored descendants up to its stored node.

    The only subtree of a tree ends where one node remains; any other has all levels.
    """
    levels = [nodes]
    while len(levels) <= every and not (alone and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _is_alone(block: int, size: int, fanout: int, every: int) -> bool:
    return block == 0 and size < fanout**every


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of one tree and block, at most ``fanout ** every`` and a row for the block itself."""
    rows = itertools.chain.from_iterable(batch.to_pylist() for batch in batches)
    for key, group in itertools.groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield key, list(group)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("pos").asc_nulls_first())


def _level_above(nodes: DataFrame, fanout: int, every: int) -> DataFrame:
    """The next stored level."""
    out = StructType.fromDDL(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (tree, block), rows in _subtrees(batches):
                levels = _climb([r["node"] for r in rows], _is_alone(block, len(rows), fanout, every), fanout, every)
                yield tree, block, levels[-1][0]

        yield from _batches(made(), out)

    blocks = nodes.select("tree", F.expr(f"pos div {fanout**every}").alias("block"), "pos", "node")
    return _in_blocks(blocks).mapInArrow(run, out)


def _batches(rows: Iterator[tuple], schema: StructType, size: int = 2000) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), arrow.types, strict=True)], schema=arrow)


def _ways(levels: list[list[str]], fanout: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each lowest node what stands before and behind its way up, inside the subtree."""
    sides = []
    for level in levels[:-1]:
        runs = [level[i // fanout * fanout : (i // fanout + 1) * fanout] for i in range(len(level))]
        sides.append([("".join(r[: i % fanout]), "".join(r[i % fanout + 1 :])) for i, r in enumerate(runs)])
    for i in range(len(levels[0])):
        way = [side[i // fanout**t] for t, side in enumerate(sides)]
        yield [b for b, _ in way], [a for _, a in way]


def _proofs_below(nodes: DataFrame, above: DataFrame, fanout: int, every: int) -> DataFrame:
    """``nodes`` with their proofs, from ``above(tree, block, <proof>)``, one row per aligned subtree.

    A subtree's own row goes ahead of its nodes in the sorted partition, so the proof of the levels
    above travels once per subtree.
    """
    out = StructType.fromDDL(PROOF)
    out = StructType(nodes.schema.fields + out.fields)
    kept = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (_, block), (head, *rows) in _subtrees(batches):
                levels = _climb([r["node"] for r in rows], _is_alone(block, len(rows), fanout, every), fanout, every)
                for row, (before, after) in zip(rows, _ways(levels, fanout), strict=True):
                    yield *(row[c] for c in kept), before + head["before"], after + head["after"], head["tops"]

        yield from _batches(made(), out)

    blocks = nodes.withColumn("block", F.expr(f"pos div {fanout**every}"))
    return _in_blocks(blocks.unionByName(above, allowMissingColumns=True)).mapInArrow(run, out)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(tree, ...)`` by tree and ``order``, with ``_part`` and ``_place``, its place among the tree's rows there."""
    out = StructType(rows.schema.fields + StructType.fromDDL("_part int, _place long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, last, at = TaskContext.get().partitionId(), False, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = batch.column("tree")
            codes = tree.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            fresh = np.append(not begun or tree[0].as_py() != last, codes[1:] != codes[:-1])
            begins = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            place = np.where(begins >= 0, np.arange(n) - begins, np.arange(n) + at)
            begun, last, at = True, tree[n - 1].as_py(), int(place[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


@dataclass
class Forest:
    """Trees by their stored levels; ``levels[0]`` are the leaves, the last has one node per tree."""

    levels: list[DataFrame]
    fanout: int
    every: int

    def tops(self) -> DataFrame:
        return self.levels[-1].select("tree", "node")

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with their proofs; ``above(tree, <proof>)`` continues them beyond the trees."""
        blocks = above.withColumn("block", F.lit(0).cast("long"))
        for nodes in self.levels[-2:0:-1]:
            below = _proofs_below(nodes, blocks, self.fanout, self.every)
            blocks = below.select("tree", F.col("pos").alias("block"), "before", "after", "tops")
        return _proofs_below(self.levels[0], blocks, self.fanout, self.every)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grow(rows: DataFrame, order: list[str], folder: str, fanout: int, every: int) -> Forest:
    """Trees over ``rows(tree, node, ...)``, written level by level below ``folder``."""
    parts = _stored(_numbered(rows, *order), f"{folder}/order")
    sizes = parts.groupBy("_part", "tree").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first tree of a partition can have rows in an earlier one: at most a row per partition.
    carried = sizes.select(F.col("_part").alias("p"), F.col("tree").alias("t"), F.sum("n").over(earlier).alias("carry")).where("carry > 0")
    here = (F.col("_part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t"))
    leaves = parts.join(F.broadcast(carried), here, "left").withColumn("pos", F.col("_place") + F.coalesce("carry", F.lit(0)))
    levels = [_stored(leaves.drop("_part", "_place", "p", "t", "carry"), f"{folder}/level=0")]
    most = levels[0].agg(F.max("pos")).first()[0] or 0
    while len(levels) == 1 or most > 0:
        levels.append(_stored(_level_above(levels[-1], fanout, every), f"{folder}/level={every * len(levels)}"))
        most //= fanout**every
    return Forest(levels, fanout, every)


@dataclass
class Manifest:
    """``rows``: trees of the table's rows, one per source; ``sources``: the tree over their subroots."""

    rows: Forest
    sources: Forest

    def root(self) -> str | None:
        """None for an empty table."""
        top = self.sources.tops().first()
        return top["node"] if top else None

    def proofs(self) -> DataFrame:
        """Every row's ``tree, pos, node`` and key columns with its proof.

        ``before`` and ``after``: the siblings left and right of its way from its level to the root, a
        string of digests per level, empty where it has none. ``tops``: root and subroot.
        """
        empty = F.array().cast("array<string>")
        top = self.sources.tops().select("tree", empty.alias("before"), empty.alias("after"), F.array("node").alias("tops"))
        subroots = self.sources.proofs(top).select(
            F.col("source").alias("tree"), "before", "after", F.array_append("tops", F.col("node")).alias("tops")
        )
        return self.rows.proofs(subroots)


def write_manifest(rows: DataFrame, folder: str, order: list[str], fanout: int = 3, every: int = 6) -> Manifest:
    """The manifest of ``rows(tree, node, ...)``: a leaf digest ``node`` per row and the tree it belongs to.

    Leaves of a tree stand in the order of the columns ``order``, null first, then by digest; trees
    by name, null first. Columns beyond these travel with the leaves. Only narrow rows are sorted;
    a tree with a third of all rows is spread over partitions like any other.
    """
    forest = _grow(rows, [*order, "node"], f"{folder}/rows", fanout, every)
    subroots = forest.tops().select(F.lit("").alias("tree"), "node", F.col("tree").alias("source"))
    return Manifest(forest, _grow(subroots, ["source"], f"{folder}/sources", fanout, every))


def read_manifest(spark: SparkSession, folder: str, fanout: int = 3, every: int = 6) -> Manifest:
    """What ``write_manifest`` has written."""

    def forest(path: str) -> Forest:
        base = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = [s.getPath().getName() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)]
        numbers = sorted(int(name.removeprefix("level=")) for name in found if name.startswith("level="))
        return Forest([spark.read.parquet(f"{path}/level={n}") for n in numbers], fanout, every)

    return Manifest(forest(f"{folder}/rows"), forest(f"{folder}/sources"))


def _steps() -> Column:
    return F.arrays_zip("before", "after")


def fold(leaf: str | Column) -> Column:
    """The root that a leaf digest and the proof columns ``before`` and ``after`` lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(_steps(), start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings() -> Column:
    """All siblings of a proof in order, as one string."""
    return F.array_join(F.transform(_steps(), lambda step: F.concat(step["before"], step["after"])), "")
