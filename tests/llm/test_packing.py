import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from softseek.llm import packing
from softseek.llm.queries import op13_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity):
    """Every id of every document lies in one piece, sequences have no gaps, all but powers of two are full."""
    whole = Tokenizer.from_file(WORDS)
    want = sorted(str((d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in docs)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length * 4 == len(r.ids) > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0
    assert sum(sum(r.length for r in own) < capacity for own in by_sequence.values()) < capacity.bit_length()
    got = []
    for (doc_id, tokens), own in by_doc.items():
        starts = {}
        for r in sorted(own, key=lambda r: (r.start, -r.length)):
            starts.setdefault(r.start, []).append(r)
        while starts.get(0):  # rows that share a doc_id are equal in these tests, or differ in length
            at, ids = 0, b""
            while at < tokens:
                r = starts[at].pop()
                ids, at = ids + bytes(r.ids), at + r.length
            assert at == tokens
            got.append(str((doc_id, ids)))
        assert not any(starts.values())
    assert sorted(got) == want


@pytest.mark.parametrize("capacity", [64, 4096])
def test_odd_rows(spark, odd, none, capacity):
    docs = [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id <> 9").collect()]
    rows = packing.pack(odd.where("doc_id is null or doc_id <> 9"), WORDS, capacity=capacity).collect()
    check(rows, docs, capacity)
    assert packing.pack(none, WORDS, capacity=capacity).collect() == []


def test_repeated_rows(spark, odd):
    nine = odd.where("doc_id = 9")
    rows = packing.pack(nine, WORDS).collect()
    tokens = 2 * rows[0].doc_tokens
    assert sum(r.length for r in rows) == tokens and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_many_small_documents(spark):
    random.seed(3)
    docs = [(i, " ".join(["word"] * int(random.paretovariate(0.6)) )[:3000]) for i in range(4000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    made = packing.pack(table, WORDS, capacity=256)
    rows = made.collect()
    check(rows, docs, 256)
    # Few documents are cut beyond what their length demands.
    needed = sum(-(-r.doc_tokens // 256) for r in {r.doc_id: r for r in rows}.values())
    assert len(rows) < 1.05 * needed + 20
    whole = {r.sequence_id: r for r in packing.sequences(made).collect()}
    for r in rows[:500]:
        s = whole[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset in s.starts


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = Tokenizer.from_file(WORDS)
    rows = op13_packing(spark, sf).collect()
    spans = {}
    for r in rows:
        ids = np.array([*whole.encode(docs[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    assert spans.keys() == docs.keys()
    assert all([a for a, _ in sorted(s)][1:] == [b for _, b in sorted(s)][:-1] for s in spans.values())


def best(sizes, demand, capacity):
    """Fewest sequences, over all ways to deal out a few items."""
    seen = {}

    def least(left):
        if not any(left):
            return 0
        if left not in seen:
            first = next(i for i, n in enumerate(left) if n)
            options = []
            for n in range(capacity // min(sizes)):
                for more in combinations_with_replacement(range(len(sizes)), n):
                    take = [more.count(i) + (i == first) for i in range(len(sizes))]
                    if sum(t * s for t, s in zip(take, sizes)) <= capacity and all(t <= n for t, n in zip(take, left)):
                        options.append(tuple(n - t for n, t in zip(left, take)))
            seen[left] = 1 + min(map(least, options))
        return seen[left]

    return least(tuple(demand))


def test_patterns_hold_the_histogram_and_are_nearly_best():
    random.seed(1)
    for _ in range(60):
        capacity = random.randint(6, 12)
        sizes = sorted(random.sample(range(2, capacity + 1), random.randint(1, 3)))
        histogram = {s: random.randint(1, 4) for s in sizes}
        made = packing.patterns(histogram, capacity)
        assert all(sum(s * n for s, n in p.items()) <= capacity for p, _ in made)
        assert {s: sum(p.get(s, 0) * t for p, t in made) for s in sizes} == histogram
        used = sum(t for _, t in made)
        assert used <= best(sizes, list(histogram.values()), capacity) + 1
        basis, times = packing.column_generation(np.array(sizes), np.array(list(histogram.values())), capacity)
        assert np.allclose(basis @ times, list(histogram.values())) and times.sum() <= used + 1e-6


def test_large_histogram():
    random.seed(2)
    histogram = {s: random.randint(1, 10**9) for s in range(1, 257)}
    made = packing.patterns(histogram, 256)
    used, least = sum(t for _, t in made), sum(s * n for s, n in histogram.items()) / 256
    assert {s: sum(p.get(s, 0) * t for p, t in made) for s in histogram} == histogram
    _, times = packing.column_generation(np.arange(1, 257), np.array(list(histogram.values())), 256)
    assert least <= times.sum() <= used + 1e-3 <= times.sum() + 2 * 256
    assert used <= 1.02 * least
