"""Token ids of whole texts, word by word, on Arrow buffers, with a memory of words bounded in bytes.

For tokenizers that lower-case, drop white space and never join a letter with a mark: no token depends
on what stands beyond white space, so a text's ids are those of its words. A chunk of texts is hashed
word by word, its distinct words are looked up together, and the ids of all places are gathered in
arrays; only words that the memory does not hold become Python strings. The hash has 64 bits and the
length is compared too: among a million words held, a new word is mistaken for one of them with a
probability of 5e-14.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from softseek.llm import words as W

_SEPARATORS = b" \t\n\r"
_VALUES = W.byte_values(_SEPARATORS)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MARKS = ".,!?;:$%&*#|"
#: Letters that no normalisation changes.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: Longer words are encoded every time.
LONGEST = 64
#: Longer texts are encoded part by part.
_LONG_TEXT = 1 << 20
_SPACE = re.compile("[ \t\n\r]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable,
    the others in order from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def gather(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return pool[:0]
    return pool[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])]


def _parts(text: str) -> Iterator[str]:
    """A long text cut at white space into parts of some ``_LONG_TEXT`` characters, or one longer word."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _LONG_TEXT)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


class _Segment:
    """Words by ascending hash: their lengths in bytes and their ids in one pool."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, pool: np.ndarray):
        self.hashes, self.sizes, self.counts, self.pool = hashes, sizes, counts, pool
        self.begins = (np.cumsum(counts) - counts).astype(np.uint32)

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.hashes, self.sizes, self.counts, self.pool, self.begins))

    def merged(self, other: _Segment) -> _Segment:
        hashes = np.concatenate((self.hashes, other.hashes))
        order = np.argsort(hashes, kind="stable")
        counts = np.concatenate((self.counts, other.counts))
        begins = np.concatenate((self.begins, other.begins + np.uint32(len(self.pool))))
        pool = gather(np.concatenate((self.pool, other.pool)), begins[order].astype(np.int64), counts[order].astype(np.int64))
        return _Segment(hashes[order], np.concatenate((self.sizes, other.sizes))[order], counts[order], pool)


class WordMemory:
    """Two generations of words; the older is dropped when the younger reaches half of ``max_bytes``."""

    def __init__(self, max_bytes: int = 16 << 20):
        self.max_bytes = max_bytes
        self.young: list[_Segment] = []
        self.old: list[_Segment] = []

    def nbytes(self) -> int:
        return sum(s.nbytes() for s in (*self.young, *self.old))

    def _add(self, segment: _Segment) -> None:
        while self.young and len(self.young[-1].hashes) < 8 * len(segment.hashes):
            segment = self.young.pop().merged(segment)
        self.young.append(segment)
        if sum(s.nbytes() for s in self.young) > self.max_bytes // 2:
            self.old, self.young = self.young, []

    def ids(self, hashes: np.ndarray, sizes: np.ndarray, encode: Callable[[np.ndarray], list[bytes]]):
        """Ids of distinct words by ascending hash: where each word's begin in a pool, how many, and the pool.

        ``encode`` gets the places of unknown words and returns their ids.
        """
        begins, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        unknown, recent, pools, total = np.ones(len(hashes), bool), np.zeros(len(hashes), bool), [], 0

        def put(places: np.ndarray, own: np.ndarray, pool: np.ndarray) -> None:
            nonlocal total
            counts[places] = own
            begins[places] = total + np.cumsum(own) - own
            pools.append(pool)
            total += len(pool)

        for young, segment in [*((True, s) for s in self.young), *((False, s) for s in self.old)]:
            at = np.searchsorted(segment.hashes, hashes)
            at[at == len(segment.hashes)] = 0
            places = np.flatnonzero(unknown & (segment.hashes[at] == hashes) & (segment.sizes[at] == sizes))
            own = segment.counts[at[places]].astype(np.int64)
            put(places, own, gather(segment.pool, segment.begins[at[places]].astype(np.int64), own))
            unknown[places] = False
            recent[places] = young
        places = np.flatnonzero(unknown)
        if len(places):
            coded = encode(places)
            put(places, np.array([len(c) // 4 for c in coded], np.int64), np.frombuffer(b"".join(coded), np.uint32))
        pool = np.concatenate(pools) if pools else np.zeros(0, np.uint32)
        keep = np.flatnonzero(~recent & (sizes <= LONGEST))
        if len(keep):
            own = counts[keep]
            self._add(_Segment(hashes[keep], sizes[keep].astype(np.uint8), own.astype(np.uint16), gather(pool, begins[keep], own)))
        return begins, counts, pool


class WordEncoder:
    """Ids of whole texts by a tokenizers file as the module describes.

    Texts in which special tokens may begin are cut at white space only and not remembered.
    """

    def __init__(self, path: str, max_bytes: int = 16 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.marks: dict[str, bytes] = {"": b""}
        self.memory = WordMemory(max_bytes)

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self._encode_together([marks])[0]
        return self.marks[marks]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Plain letters, with a few marks behind or none, are one or two splits that normalisation does
        not change: the merges alone give their ids. All other words go through the whole tokenizer."""
        found, others = [b""] * len(words), []
        for i, word in enumerate(words):
            core = word.rstrip(_MARKS)
            if len(word) - len(core) <= 3 and _PLAIN(core):
                letters = core if core.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, core.encode()))
                found[i] = array("I", [t.id for t in self.merges.tokenize(letters)]).tobytes() + self._marks(word[len(core) :])
            elif word:
                others.append(i)
        at = 0
        while at < len(others):  # some 64 KB of words together
            stop, chars = at, 0
            while stop < len(others) and (stop == at or chars + len(words[others[stop]]) < 1 << 16):
                chars += len(words[others[stop]])
                stop += 1
            for i, coded in zip(others[at:stop], self._encode_together([words[i] for i in others[at:stop]]), strict=True):
                found[i] = coded
            at = stop
        return found

    def _encode_together(self, words: list[str]) -> list[bytes]:
        """Encodes words in one go, as a text, and deals the ids out by their offsets."""
        coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *[len(w) + 1 for w in words]])
        at = np.array([a for a, _ in coded.offsets], np.int64)
        cuts = np.searchsorted(at, begins) * 4
        ids = np.array(coded.ids, np.uint32).tobytes()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column and the number of ids of each row; null is empty."""
        texts = pc.fill_null(texts, "")
        if len(texts) == 1 and texts.nbytes > 2 * _LONG_TEXT:
            parts = [self.encode_column(pa.array([p], pa.string())) for p in _parts(texts[0].as_py())]
            return np.concatenate([ids for ids, _ in parts]), np.array([sum(int(n[0]) for _, n in parts)])
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            return self._with_special(texts, special)
        data, offsets = W.string_bytes(texts)
        hashes, starts = W.word_places(data, offsets, _VALUES)
        rows = np.searchsorted(starts, offsets)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        begin = starts[first]
        breaks = np.sort(np.concatenate((np.flatnonzero(_VALUES[data] == 0), offsets)))
        end = breaks[np.searchsorted(breaks, begin, side="right")]

        def encode(places: np.ndarray) -> list[bytes]:
            raw = data.tobytes()
            spans = zip(begin[places].tolist(), end[places].tolist(), strict=True)
            return self._encode([raw[a:b].translate(_LOWER).decode() for a, b in spans])

        begins, counts, pool = self.memory.ids(distinct, end - begin, encode)
        lengths = counts[which]
        totals = np.concatenate(([0], np.cumsum(lengths)))[rows]
        return gather(pool, begins[which], lengths), np.diff(totals)

    def _with_special(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain_ids, plain_counts = self.encode_column(texts.filter(pa.array(~special)))
        coded = []
        for text in texts.filter(pa.array(special)).to_pylist():
            coded.append(b"".join(self._encode(re.split("[ \t\n\r]+", text))))
        counts = np.zeros(len(texts), np.int64)
        counts[~special] = plain_counts
        counts[special] = [len(c) // 4 for c in coded]
        pool = np.concatenate((plain_ids, np.frombuffer(b"".join(coded), np.uint32)))
        begins = np.zeros(len(texts), np.int64)
        begins[~special] = np.cumsum(plain_counts) - plain_counts
        begins[special] = len(plain_ids) + np.cumsum(counts[special]) - counts[special]
        return gather(pool, begins, counts), counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [raw[b - n * 4 : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` behind the ids of every row."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1
