"""Benchmark decontamination: one Aho-Corasick automaton over all windows of benchmark words.

Texts and items are lower-cased (A-Z) and reduced to words parted by single blanks; a window is
``window`` consecutive words of an item, a shorter item is one window. The automaton holds the
windows with a blank on either side, so that matches begin and end with words, and one scan finds
every window at every place. Hits are mapped back to code points of the original text.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from softseek.llm.frames import append

#: Everything below 0x80 but digits and letters parts words; upper case becomes lower case.
NORMAL = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(items: list[tuple[str, str | None]], window: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Window text to its number of words and the items (by position) that have it."""
    found: dict[str, tuple[int, set[int]]] = {}
    for at, (_, text) in enumerate(items):
        words = normal_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            key = " " + b" ".join(words[i : i + n]).decode() + " "
            found.setdefault(key, (n, set()))[1].add(at)
    return {k: (n, tuple(sorted(at))) for k, (n, at) in found.items()}


@lru_cache(maxsize=2)
def _automaton(items: tuple, window: int) -> ahocorasick.Automaton | None:
    automaton = ahocorasick.Automaton()
    for key, value in windows(list(items), window).items():
        automaton.add_word(key, value)
    automaton.make_automaton()
    return automaton if len(automaton) else None


def _original_words(raw: bytes) -> np.ndarray:
    """Code point offsets (start, end) of the words of the original text."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.stack([point[np.flatnonzero(edges == 1)], point[np.flatnonzero(edges == -1)]], axis=1)


def scan(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[int, int, set[int], list[tuple[int, int]]]:
    """Words, words hit, items hit, and the hit stretches of the original (code points, end exclusive)."""
    raw = (text or "").encode()
    words = raw.translate(NORMAL).split()
    if not words or automaton is None:
        return len(words), 0, set(), []
    normal = " " + b" ".join(words).decode() + " "
    hits = list(automaton.iter(normal))
    if not hits:
        return len(words), 0, set(), []
    blanks = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
    last = np.searchsorted(blanks, [end for end, _ in hits])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - [n for _, (n, _) in hits], 1)
    np.add.at(change, last, -1)
    hit = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    places = _original_words(raw)
    spans = zip(places[np.flatnonzero(edges == 1), 0].tolist(), places[np.flatnonzero(edges == -1) - 1, 1].tolist(), strict=True)
    return len(words), int(hit.sum()), {i for _, (_, at) in hits for i in at}, list(spans)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", max_benchmark_bytes: int = 64 << 20
) -> DataFrame:
    """``docs`` with ``n_words long, n_hit long, items array<string>, spans array<struct<start,end>>``.

    ``benchmark(item_id, text)`` is broadcast after a check of its bytes; a larger one is an error,
    as its automaton would not fit a worker. Null and wordless texts and items hit nothing; an item
    without item_id is named "null"; repeated items count once per name.
    """
    sizes = benchmark.selectExpr("coalesce(sum(octet_length(text)), 0) as n").first()
    if sizes["n"] > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {sizes['n']} bytes, more than {max_benchmark_bytes}: scan it in parts")
    rows = benchmark.selectExpr("coalesce(cast(item_id as string), 'null') as item_id", "text").collect()
    items = tuple((r["item_id"], r["text"]) for r in rows)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def compute(column: pa.Array) -> list:
        items = shared.value
        automaton = _automaton(items, window)
        n_words, n_hit, names, spans = [], [], [], []
        for value in column.to_pylist():
            n, hit, found, where = scan(value, automaton)
            n_words.append(n)
            n_hit.append(hit)
            names.append(sorted({items[i][0] for i in found}))
            spans.append([{"start": a, "end": b} for a, b in where])
        return [n_words, n_hit, names, spans]

    fields = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    return append(docs, text, fields, compute)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", share: int = 20) -> str:
    """The rule: some word hit, and at least one in ``share``."""
    return f"{n_hit} > 0 and {share} * {n_hit} >= {n_words}"
