"""Secrets in whole texts: keyword automaton, anchored patterns near its hits, checksums.

One Aho-Corasick pass over the lower-cased text finds where a secret may begin; a pattern is tried
only there. Long runs of hexadecimal digits have no keyword: the automaton's second pass reads the
text's character classes, where the class written 24 times is one. Formats with a checksum inside
(CRC-32 in base 62, Luhn) are kept only if it is right.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from softseek.llm.frames import append

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crc_token", "card")
# Prefixes of tokens that end in the CRC-32 of their body, six digits in base 62.
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(r"[0-9]{13,19}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Class of each byte: h hexadecimal letter, d digit, - other.
_CLASSES = bytes(ord("d") if 48 <= b <= 57 else ord("h") if 97 <= b <= 102 else ord("-") for b in range(256))
HEX_LEAST, CARD_LEAST = 24, 13


def _keywords() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        automaton.add_word(word, (0, len(word)))
    automaton.add_word("akia", (1, 4))
    for word in CRC_PREFIXES:
        automaton.add_word(word, (3, len(word)))
    automaton.make_automaton()
    return automaton


def _class_runs() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    automaton.add_word("x" * HEX_LEAST, 2)
    automaton.add_word("d" * CARD_LEAST, 4)
    automaton.make_automaton()
    return automaton


KEYWORDS, RUNS = _keywords(), _class_runs()


def crc_right(body: str, check: str) -> bool:
    value, n = zlib.crc32(body.encode()), 0
    for c in check:
        n = n * 62 + BASE62.index(c)
    return n == value


def luhn_right(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _long_runs(text: str) -> list[tuple[int, int]]:
    """(kind, code point) inside every long run of hexadecimal digits or of digits, in order."""
    raw = text.encode()
    classes = raw.translate(_CLASSES)
    found = []
    # Where the class text has no run at all, which is the rule, bytes.find ends the matter.
    as_hex = classes.replace(b"h", b"x").replace(b"d", b"x")
    for kind, plain in ((2, as_hex), (4, classes)):
        if (b"x" * HEX_LEAST if kind == 2 else b"d" * CARD_LEAST) not in plain:
            continue
        ends = [end for end, k in RUNS.iter(plain.decode("latin-1")) if k == kind]
        if len(raw) != len(text):
            ends = _code_points(raw, ends)
        found += [(kind, e) for e in ends]
    return found


def _code_points(raw: bytes, places: list[int]) -> list[int]:
    """Code point offsets of ascending byte offsets."""
    out, at, count = [], 0, 0
    for p in places:
        count += len(raw[at:p].decode("utf-8", "ignore"))
        out.append(count)
        at = p
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then in the order of KINDS."""
    spans, free = [], [0] * len(KINDS)
    for end, (kind, length) in KEYWORDS.iter(text.encode().translate(_LOWER).decode()):
        start = end + 1 - length
        if start < free[kind]:
            continue
        match = (ASSIGN, ACCESS, None, CRC_TOKEN)[kind].match(text, start)
        if match:
            free[kind] = match.end()
            if (
                (kind == 0 and len(match[1]) >= 6)
                or (kind == 1 and len(match[0]) >= 20)
                or (kind == 3 and crc_right(match[1], match[2]) and not text[start - 1 : start].isalnum())
            ):
                spans.append((start, kind, match.end()))
    for kind, inside in _long_runs(text):
        if inside < free[kind]:
            continue
        pattern = HEX if kind == 2 else CARD
        start = inside
        digits = "0123456789abcdef" if kind == 2 else "0123456789"
        while start > free[kind] and text[start - 1] in digits:
            start -= 1
        match = HEX.match(text, start) if kind == 2 else None
        stop = match.end() if match else inside + 1
        if kind == 4:
            while stop < len(text) and text[stop] in digits:
                stop += 1
        free[kind] = stop
        if kind == 2 and stop - start >= HEX_LEAST or kind == 4 and pattern.fullmatch(text, start, stop) and luhn_right(text[start:stop]):
            spans.append((start, kind, stop))
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets array<struct<kind,start,end>>``; null and empty texts have none.

    ``assign``, ``access`` and ``hex`` are leftmost, non-overlapping matches per kind of the base
    patterns with the lengths asked for; ``crc_token`` and ``card`` have a right checksum. Spans of
    different kinds may overlap.
    """

    def compute(column: pa.Array) -> list:
        return [[[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] if t else [] for t in column.to_pylist()]]

    return append(docs, text, "secrets array<struct<kind: string, start: long, end: long>>", compute)
