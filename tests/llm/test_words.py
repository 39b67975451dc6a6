import random
import re

import numpy as np
import pyarrow as pa
import pytest

from softseek.llm import words as W

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TEXTS = ["", "a  B c", "  a\nb ", "x" * 500 + " yy", "x" * 96, "x" * 97, "x" * 98, "é" * 60 + " é", None, "a b c d e", "A B C D E", "y" * 3000]


@pytest.mark.parametrize("window", [97, 1 << 17])
def test_words_equal_the_pattern(monkeypatch, window):
    monkeypatch.setattr(W, "WINDOW", window)
    column = pa.array(TEXTS * 3)[1:]
    words, begins = W.word_hashes(*W.string_bytes(column))
    names = {}
    for i, text in enumerate(column.to_pylist()):
        want = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        got = words[begins[i] : begins[i + 1]]
        assert len(want) == len(got)
        for w, h in zip(want, got, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_shingle_sets():
    column = pa.array(["a b c d a b c d", "d c b a", "a b", "b a", "a", None])
    sets = W.shingle_sets(*W.word_hashes(*W.string_bytes(column)), 4)
    assert [len(s) for s in sets] == [4, 1, 1, 1, 1, 0]
    assert len({s.tobytes() for s in sets}) == 6


def test_chunks_keep_all_rows():
    random.seed(1)
    batch = pa.record_batch({"text": ["z" * random.randint(0, 50) for _ in range(200)]})
    parts = list(W.chunks(iter([batch]), "text", 100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(map(len, p.column(0).to_pylist())) <= 100 for p in parts)
    assert not list(W.chunks(iter([batch.slice(0, 0)]), "text", 10))


def test_mix_is_one_to_one():
    assert len(np.unique(W.mix(np.arange(100_000, dtype=np.uint64)))) == 100_000
