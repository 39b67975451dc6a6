"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python object per word.

A word's hash depends on its bytes alone (A-Z count as a-z), so workers agree without exchanging
a vocabulary. Texts are walked in windows cut between words: memory follows the window and the
number of words, not a text's length times the width of the intermediate arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 17
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(index: np.ndarray | int) -> np.ndarray:
    """Fixed pseudo-random 64-bit values by index."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(index, np.uint64) * _MULTIPLIER + _MULTIPLIER)


def byte_values(separators: bytes) -> np.ndarray:
    """A value for each byte, 0 for separators; upper case has the value of lower case."""
    values = spread(np.arange(256)) | np.uint64(1)
    values[65:91] = values[97:123]
    values[np.frombuffer(separators, np.uint8)] = 0
    return values


#: White space that separates words: 0x20 and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
BLANK_SEPARATED = byte_values(SPACES)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 64), spread(7) | np.uint64(1), np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors)
    return _powers


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``max_bytes`` of text, or one longer text."""
    for batch in batches:
        _, offsets = string_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def _window_end(data: np.ndarray, offsets: np.ndarray, start: int, values: np.ndarray) -> int:
    """Where the window that begins at ``start`` may end: after a separator or where a text ends."""
    stop = start + WINDOW
    if stop >= len(data):
        return len(data)
    breaks = np.flatnonzero(values[data[start:stop]] == 0)
    text_end = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
    best = max(start + int(breaks[-1]) + 1 if len(breaks) else 0, text_end)
    if best > start:
        return best
    text_end = int(offsets[np.searchsorted(offsets, stop, side="left")])
    while stop < text_end:  # one word longer than the window
        breaks = np.flatnonzero(values[data[stop : min(stop + WINDOW, text_end)]] == 0)
        if len(breaks):
            return stop + int(breaks[0]) + 1
        stop += WINDOW
    return text_end


def word_places(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = BLANK_SEPARATED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the byte at which each begins."""
    hashes, firsts = [], []
    start = 0
    while start < len(data):
        stop = _window_end(data, offsets, start, values)
        own = values[data[start:stop]]
        word = own != 0
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        edge = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop)] - start
        before[edge] = False
        first = np.flatnonzero(word & ~before)
        if len(first):
            gaps = np.diff(np.append(first, len(own)))
            place = np.arange(first[0], len(own)) - np.repeat(first, gaps)
            np.minimum(place, WINDOW if len(own) <= WINDOW else len(own), out=place)
            factors = powers(int(place.max()) + 1)
            hashes.append(mix(np.add.reduceat(own[first[0] :] * factors[place], first - first[0])))
            firsts.append(first + start)
        start = stop
    starts = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), starts


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, values: np.ndarray = BLANK_SEPARATED
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more than texts)."""
    words, starts = word_places(data, offsets, values)
    return words, np.searchsorted(starts, offsets)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words, also across texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * (spread(100 + i) | np.uint64(1))
    return mix(total)


def shingle_sets(words: np.ndarray, begins: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``n`` words; a shorter text is one run."""
    every = runs(words, n)
    sets = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix(runs(words[a:b], b - a) + spread(1000 + b - a))
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
    return sets
