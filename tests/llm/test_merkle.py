import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from softseek.llm import merkle
from softseek.llm.queries import op12_merkle_manifest
from softseek.session import scratch_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, i, fanout=3):
    """For each level the run a node lies in and its place there."""
    for level in levels[:-1]:
        yield level[i // fanout * fanout : i // fanout * fanout + fanout], i % fanout
        i //= fanout


def expected(rows, fanout=3):
    """Rows are (source, doc_id or None, leaf, forged or None); the whole trees are kept."""
    order = lambda s: (s is not None, (s or "").encode())
    sources = sorted({r[0] for r in rows}, key=order)
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[s] = own, tree([r[2] for r in own], fanout)
    crown = tree([trees[s][1][-1][0] for s in sources], fanout)
    out = []
    for place, s in enumerate(sources):
        own, levels = trees[s]
        for i, (_, key, leaf, forged) in enumerate(own):
            steps = [*way(levels, i, fanout), *way(crown, place, fanout)]
            proof = "".join("".join(run[:at] + run[at + 1 :]) for run, at in steps)
            node = forged or leaf
            for run, at in steps:
                node = sha("".join([*run[:at], node, *run[at + 1 :]]))
            root = crown[-1][0]
            out.append((key, leaf, levels[-1][0], root, sha(proof), node, node == root))
    return sorted(out, key=str)


def result(rows):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def even(key):
    return key is not None and zlib.crc32(str(key).encode()) % 2 == 0


def digest_columns(proofs):
    folded = merkle.fold(F.coalesce("forged", "node"))
    return proofs.select(
        "doc_id", F.col("node").alias("leaf"), F.col("tops")[1].alias("subroot"), F.col("tops")[0].alias("root"),
        F.sha2(merkle.siblings(), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("tops")[0]).alias("verified"),
    )


@pytest.mark.parametrize("every", [1, 2, 6])
@pytest.mark.parametrize("fanout", [2, 3])
def test_proofs_against_whole_trees(spark, every, fanout):
    random.seed(every)
    sizes = {None: 1, "a": 40, "": 3, "é": 10, "z": 9, "only": 1}
    rows = [(s, random.choice([None, *range(30)]), leaf_of(s, i % 35), None) for s, n in sizes.items() for i in range(n)]
    rows = [(s, k, n, sha("forged" + n) if even(k) else None) for s, k, n, _ in rows]
    table = spark.createDataFrame(rows, "tree string, doc_id long, node string, forged string").repartition(5)
    folder = scratch_path(spark, "manifest")
    made = merkle.write_manifest(table, folder, ["doc_id"], fanout=fanout, every=every)
    back = merkle.read_manifest(spark, folder, fanout=fanout, every=every)
    assert made.root() == back.root()
    assert len(made.rows.levels) == len(back.rows.levels) > (3 if every == 1 else 1)
    want = expected(rows, fanout)
    assert result(digest_columns(made.proofs()).collect()) == want
    assert result(digest_columns(back.proofs()).collect()) == want


def test_query_on_odd_rows(spark, odd, none, tmp_path):
    odd = odd.select("*", F.lit(None).cast("string").alias("lang"), F.col("doc_id").alias("n_chars"), F.lit("x").alias("tree"), F.lit(1).alias("node"))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = []
    for r in odd.collect():
        forged = r.text.replace("\n", "") if r.text is not None else None
        leaves = [leaf_of(r.doc_id, r.source, None, r.n_chars, t) for t in (r.text, forged)]
        rows.append((r.source, r.doc_id, leaves[0], leaves[1] if even(r.doc_id) else None))
    got = op12_merkle_manifest(spark, str(tmp_path))
    assert result(got.collect()) == expected(rows)
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_merkle_manifest(spark, f"{tmp_path}/none").collect() == []


def test_one_changed_byte_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op12_merkle_manifest(spark, sf)
    changed = docs.where(F.col("text").contains("\n") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)).select("doc_id")
    assert got.where("not verified").select("doc_id").exceptAll(changed).isEmpty()
    assert changed.exceptAll(got.where("not verified").select("doc_id")).isEmpty()
