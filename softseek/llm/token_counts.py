"""Token counts of whole texts as an Arrow function that returns lengths only.

A byte-level tokenizer never joins what stands before white space with what follows another
character: every match of its splitting pattern ends where a non-blank is followed by a blank.
Texts of any length are therefore counted in pieces cut there. Pieces repeat, so a worker keeps
the counts of recent ones; the others are encoded in batches of a bounded number of characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from softseek.llm import words as W
from softseek.llm.memo import Memo

#: White space but blank and newline: texts with it are cut by the general pattern.
_OTHER = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
_CUT = re.compile(r"(?<=\S)(?=\s)")


def pieces(text: str) -> list[str]:
    """The text cut where a non-blank is followed by white space, and around single newlines."""
    if not text:
        return []
    if "  " in text or _OTHER.search(text):
        return _CUT.split(text)
    out: list[str] = []
    for line in text.split("\n"):
        words = line.split(" ")
        if not words[0] or not words[-1]:  # white space beside a newline, or at an end
            return _CUT.split(text)
        out.append(words[0])
        out += [" " + w for w in words[1:]]
        out.append("\n")
    out.pop()
    return out


class Counter:
    def __init__(self, path: str, batch_chars: int):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            merges = tokenizer.model

            def lengths(batch: list[str]) -> list[int]:
                """Blank and letters a to z, the rule, are one split: they need the merges alone."""
                plain = {s: len(merges.tokenize("Ġ" + s[1:])) for s in batch if s[0] == " " and s.isascii() and s[1:].isalpha()}
                others = [s for s in batch if s not in plain]
                coded = tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else []
                plain.update(zip(others, map(len, coded), strict=True))
                return [plain[s] for s in batch]

            self.memo = Memo(lengths, batch_chars=batch_chars)
            self.count = lambda texts: [sum(n) for n in self.memo.get_lists([pieces(t) for t in texts])]


_counters: dict[tuple[str, int], Counter] = {}


def token_count(text: str | Column, tokenizer: str, batch_chars: int = 1 << 16) -> Column:
    """Number of tokens of a text column (long); null is empty and has none.

    ``tokenizer``: path, on every executor, of a byte-level ``.json`` file of the tokenizers
    library, or of a ``.model`` file of sentencepiece, whose texts are encoded whole as its merges
    may cross white space. No special tokens are added; their strings inside a text count as the
    library counts them by default.
    """

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        counter = _counters.get((tokenizer, batch_chars)) or _counters.setdefault((tokenizer, batch_chars), Counter(tokenizer, batch_chars))
        counts: list[int] = []
        for chunk in W.chunks(iter([pa.record_batch([column], names=["text"])]), "text", 1 << 20):
            counts += counter.count([t or "" for t in chunk.column("text").to_pylist()])
        return pa.array(counts, pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)
