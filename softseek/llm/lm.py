"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

*Model.* A trie of byte contexts up to ``order`` bytes, with counts from all training texts. A
symbol of count n is predicted in the longest context that has been seen with (n - 1/2) / T; where
it is new there, an escape of q / 2T (q distinct symbols, T in all) leads to the next shorter
context, in which symbols of the longer one are excluded from all sums. (Method D.) Below the
empty context all symbols left of 256 are alike. Texts are lower-cased (A-Z), white space is one blank, byte 0xFE stands before and
0xFF behind a text (neither occurs in UTF-8). A text's score is the sum of its log10 probabilities.

*Counting.* Tasks count their grams and send each distinct one once; Spark adds them up. Counts of
shorter contexts are sums of the longest's. The trie is cut by the last two context bytes into
shards of bounded size, so that all contexts of two and more bytes of a position are in one shard;
shorter contexts (65,536 grams at most) are in all. Shards are broadcast one at a time and add
their share of each text's code length.

*Base.* Every block of texts asks for the training counts of its distinct words, packed per range
of hashes; a range adds up what the blocks bring and answers each. No vocabulary is ever in one
place, and a frequent word travels once per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseek.llm import words as W
from softseek.session import materialize

BEGIN, END = b"\xfe", b"\xff"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENT = 1 << 20
BLOCK_BYTES = 8 << 20
FLUSH = 1 << 20


def symbols(text: str | None, order: int) -> bytes:
    return BEGIN * order + b" ".join((text or "").encode().translate(_LOWER).split()) + END


def grams(stream: np.ndarray, order: int) -> np.ndarray:
    """For each symbol behind the first ``order``: its context and itself, oldest byte highest."""
    n = len(stream) - order
    key = np.zeros(n, np.uint64)
    for i in range(order + 1):
        key <<= np.uint64(8)
        key |= stream[i : i + n]
    return key


def _segments(stream: np.ndarray, order: int) -> Iterator[np.ndarray]:
    for a in range(0, len(stream) - order, SEGMENT):
        yield grams(stream[a : a + SEGMENT + order], order)


# ---- trie -------------------------------------------------------------------------------------


class Level:
    """Contexts of one length: counts of their symbols, their totals, and what escaping to the
    next shorter context leaves there."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
        self.owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        self.total = np.bincount(self.owner, counts, len(first))
        self.distinct = np.bincount(self.owner, minlength=len(first)).astype(float)

    def find(self, wanted: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * order + 8)) - 1)


class Trie:
    """Log10 probabilities of grams. ``low``: grams of one context byte for the shorter contexts."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray):
        self.order = order
        self.levels: list[Level] = []
        for k in range(order + 1):
            source, n = (low, low_counts) if k < 2 else (keys, counts)
            own, at = np.unique(source & _mask(k), return_inverse=True)
            self.levels.append(Level(own, np.bincount(at, n, len(own))))
        # Leaving a context of k + 1 bytes: sums of the shorter context without the symbols seen.
        self.sum_left, self.distinct_left = [], []
        for k, (shorter, longer) in enumerate(zip(self.levels[:-1], self.levels[1:], strict=True)):
            at, _ = shorter.find(longer.keys & _mask(k), shorter.keys)
            excluded = np.bincount(longer.owner, shorter.counts[at], len(longer.contexts))
            context, _ = shorter.find(longer.contexts & (_mask(k) >> np.uint64(8)), shorter.contexts)
            self.sum_left.append(shorter.total[context] - excluded)
            self.distinct_left.append(shorter.distinct[context] - longer.distinct)
        top = self.levels[order]
        self._index(top.keys, np.log10((top.counts - 0.5) / top.total[top.owner]))

    def _index(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing; ``probes`` is the longest search."""
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, ~np.uint64(0))
        self.values = np.zeros(1 << bits)
        left, self.probes = np.arange(len(keys)), 0
        place = self._slot(keys)
        while len(left):
            at = (place[left] + self.probes) & ((1 << bits) - 1)
            free = self.slots[at] == ~np.uint64(0)
            self.slots[at[free]] = keys[left[free]]  # of several for one slot the last stays
            placed = self.slots[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, self.probes = left[~placed], self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        place = self._slot(keys)
        hit = self.slots[place] == keys
        out = np.where(hit, self.values[place], 0.0)
        left = np.flatnonzero(~hit)
        for i in range(1, self.probes):
            at = (place[left] + i) & (len(self.slots) - 1)
            found = self.slots[at] == keys[left]
            out[left[found]] = self.values[at[found]]
            left = left[~found]
        if len(left):
            unknown, at = np.unique(keys[left], return_inverse=True)
            out[left] = self._backed_off(unknown)[at]
        return out

    def _backed_off(self, keys: np.ndarray) -> np.ndarray:
        """Symbols that their longest context has not."""
        out = np.zeros(len(keys))
        open_, above = np.ones(len(keys), bool), np.full(len(keys), -1)  # the longer context seen
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            context, seen = level.find((keys & _mask(k)) >> np.uint64(8), level.contexts)
            seen &= open_
            at, has = level.find(keys & _mask(k), level.keys)
            total, distinct = level.total[context] if len(level.total) else out, level.distinct[context] if len(level.total) else out
            if k < self.order and len(self.sum_left[k]):
                total = np.where(above >= 0, self.sum_left[k][above], total)
                distinct = np.where(above >= 0, self.distinct_left[k][above], distinct)
            known = seen & has
            out[known] += np.log10((level.counts[at[known]] - 0.5) / total[known]) if known.any() else 0
            fell = seen & ~has & (distinct > 0)
            out[fell] += np.log10(distinct[fell] / 2 / total[fell])
            open_ &= ~known
            above = np.where(seen, context, -1)
        out[open_] -= np.log10(256 - (self.levels[0].distinct[0] if len(self.levels[0].distinct) else 0))
        return out


_tries: dict[str, Trie] = {}


def _trie(shared, order: int) -> Trie:
    """One trie at a time per worker."""
    name, counts = shared.value
    if name not in _tries:
        _tries.clear()
        _tries[name] = Trie(order, *counts)
    return _tries[name]


def _text_scores(texts: list[str | None], trie: Trie, shard: int, shards: int) -> np.ndarray:
    """Sums over the symbols whose contexts are in the shard."""
    order, out = trie.order, np.zeros(len(texts))
    for group in _groups(texts):
        streams = [symbols(texts[i], order) for i in group]
        sizes = np.array([len(s) - order for s in streams])
        if len(group) == 1:
            parts = [_shard_scores(k, trie, shard, shards).sum() for k in _segments(np.frombuffer(streams[0], np.uint8), order)]
            out[group[0]] = sum(parts)
            continue
        keys = grams(np.frombuffer(b"".join(streams), np.uint8), order)
        begins = np.concatenate(([0], np.cumsum(sizes + order)))
        inside = np.zeros(len(keys) + order, bool)  # grams across texts are of no text
        for b, n in zip(begins[:-1].tolist(), sizes.tolist(), strict=True):
            inside[b : b + n] = True
        scores = _shard_scores(keys[inside[: len(keys)]], trie, shard, shards)
        out[group] = np.add.reduceat(scores, np.cumsum(sizes) - sizes)
    return out


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Neighbouring texts of about a segment together."""
    group, size = [], 0
    for i, t in enumerate(texts):
        n = len(t or "") + 8
        if group and size + n > SEGMENT:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return W.mix(keys >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(shards)


def _shard_scores(keys: np.ndarray, trie: Trie, shard: int, shards: int) -> np.ndarray:
    if shards == 1:
        return trie.score(keys)
    own = _shard_of(keys, shards) == shard
    out = np.zeros(len(keys))
    out[own] = trie.score(keys[own])
    return out


# ---- blocks of texts --------------------------------------------------------------------------

BLOCKS_SCHEMA = "part int, block long, ordinal int, doc_id long, held_out boolean, text string, hashes binary, counts binary"
_BLOCKS = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
     ("text", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())]
)
GRAMS_PART = -1


class Tally:
    """Counts of grams, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        self.keys.append(own)
        self.counts.append(n)
        self.held += len(own)
        if self.held > FLUSH:
            self.merge()

    def merge(self) -> None:
        own, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(at, np.concatenate(self.counts), len(own)).astype(np.int64)]
        self.keys, self.held = [own], len(own)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys[0], self.counts[0]
        self.__init__()
        return out


def _block_rows(order: int, parts: int):
    def rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOCKS.types, strict=True)], schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tally = TaskContext.get().partitionId() << 32, Tally()
        for chunk in W.chunks(batches, "text", BLOCK_BYTES):
            size = chunk.num_rows
            empty = pa.nulls(size, pa.binary())
            block_column = pa.array(np.full(size, block, np.int64))
            docs = [pa.nulls(size, pa.int32()), block_column, pa.array(np.arange(size, dtype=np.int32)),
                    chunk.column("doc_id"), chunk.column("held_out"), chunk.column("text"), empty, empty]
            yield pa.RecordBatch.from_arrays(docs, schema=_BLOCKS)

            data, offsets = W.string_bytes(chunk.column("text"))
            words, begins = W.word_hashes(data, offsets)
            trains = ~chunk.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            learnt = words[np.repeat(trains, np.diff(begins))]
            distinct = np.unique(words)
            own, n = np.unique(learnt, return_counts=True)
            counts = np.zeros(len(distinct), np.uint32)
            counts[np.searchsorted(distinct, own)] = n
            cuts = np.searchsorted(_part(distinct, parts), np.arange(parts + 1)).tolist()
            asked = [
                (p, block, None, None, None, None, distinct[a:b].tobytes(), counts[a:b].tobytes())
                for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a
            ]
            if asked:
                yield rows(asked)

            texts = chunk.column("text").to_pylist()
            texts = [t for t, learn in zip(texts, trains.tolist(), strict=True) if learn]
            for group in _groups(texts):
                # BEGIN bytes of the next text part grams of one text from those of another.
                stream = np.frombuffer(b"".join(symbols(texts[i], order) for i in group), np.uint8)
                for keys in _segments(stream, order):
                    tally.add(keys[(keys & np.uint64(0xFF)) != np.uint64(BEGIN[0])])
            if tally.held > FLUSH:
                yield rows([(GRAMS_PART, block, None, None, None, None, *(x.tobytes() for x in tally.take()))])
            block += 1
        if tally.held:
            yield rows([(GRAMS_PART, block, None, None, None, None, *(x.tobytes() for x in tally.take()))])

    return run


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield pa.record_batch([np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)], ["gram", "n"])


_ANSWERS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("vocabulary", pa.int64())])
ANSWERS_SCHEMA = "part int, block long, counts binary, vocabulary long"


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all blocks of each block's words, in the order of their hashes; the range's vocabulary once."""
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    replies = [x.tobytes() for x in np.split(total[at], ends)]
    vocabulary = pa.array([int((total > 0).sum())] + [0] * (table.num_rows - 1), pa.int64())
    return pa.table([table.column("part"), table.column("block"), pa.array(replies, pa.binary()), vocabulary], schema=_ANSWERS)


_SCORES = pa.schema(
    [("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
     ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
SCORES_SCHEMA = "block long, ordinal int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_block(shared, order: int, shards: int, tokens: int, texts_learnt: int, vocabulary: int):
    """Base scores of a block, and the first shard's share of the model's."""
    floor = np.log10(tokens + 0.5 * (vocabulary + 1)) if tokens else np.log10(0.5)

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        counts = np.frombuffer(b"".join(replies.sort_by("part").column("counts").to_pylist()), np.int64)
        data, offsets = W.string_bytes(docs.column("text"))
        words, begins = W.word_hashes(data, offsets)
        _, at = np.unique(words, return_inverse=True)
        n = np.diff(begins) + 1
        # Sums text by text, so that a score does not depend on its neighbours.
        base = _sums(np.log10(counts + 0.5)[at], begins) + np.log10(texts_learnt + 0.5) - n * floor
        known = np.diff(np.concatenate(([0], np.cumsum(counts[at] > 0)))[begins]) + (texts_learnt > 0)
        del data, words, at
        model = [np.zeros(0)]
        for chunk in W.chunks(docs.combine_chunks().to_batches(), "text", 2 << 20):
            model.append(_text_scores(chunk.column("text").to_pylist(), _trie(shared, order), 0, shards))
        columns = [docs.column(c) for c in ("block", "ordinal", "doc_id", "held_out")]
        made = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(np.concatenate(model))]
        return pa.table([*columns, *made], schema=_SCORES)

    return run


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    padded = np.append(values, 0.0)
    sums = np.add.reduceat(padded, begins[:-1]) if len(begins) > 1 else np.zeros(0)
    return np.where(np.diff(begins) > 0, sums, 0.0)


_SHARES = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("share", pa.float64())])


def _shard_share(shared, order: int, shard: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, "text", 2 << 20):
            share = _text_scores(chunk.column("text").to_pylist(), _trie(shared, order), shard, shards)
            yield pa.RecordBatch.from_arrays([chunk.column("block"), chunk.column("ordinal"), pa.array(share)], schema=_SHARES)

    return run


def score_texts(docs: DataFrame, order: int = 5, shard_grams: int = 1_200_000) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of
    ``docs(doc_id, held_out, text)``.

    Rows with ``held_out`` true teach nothing; a null there counts as held out. Null and blank texts
    are the end alone. Both scores are log10 probabilities of the lower-cased words and the end:
    the base's by add-half word frequencies, the model's by the trie of ``order`` (2 to 6) bytes.
    Repeated rows count and are scored each. Words are told apart by 64-bit hashes.
    """
    if not 2 <= order <= 6:
        raise ValueError("order is 2 to 6")
    spark = docs.sparkSession
    parts = max(8, 2 * docs.select("text").rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(True)).alias("held_out"), "text")
    blocks = materialize(rows.mapInArrow(_block_rows(order, parts), BLOCKS_SCHEMA), "blocks")
    texts = blocks.where("part is null").select("block", "ordinal", "doc_id", "held_out", "text")

    counted = blocks.where(F.col("part") == GRAMS_PART).select("hashes", "counts").mapInArrow(_gram_rows, "gram long, n long")
    counted = materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    shards = max(1, -(-counted.count() // shard_grams))
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    low = counted.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n"))
    low = low.orderBy("gram").toArrow()  # at most 65,536 rows
    if shards > 1:
        of_pair = F.udf(lambda p: int(_shard_of(np.array([p << 8], np.uint64), shards)[0]), "int")
        pairs = counted.select(pair.alias("pair")).distinct().withColumn("shard", of_pair("pair"))
        counted = materialize(counted.withColumn("pair", pair).join(F.broadcast(pairs), "pair"), "shards")

    def shared(shard: int):
        own = (counted.where(F.col("shard") == shard) if shards > 1 else counted).select("gram", "n").toArrow()
        keys, n = own.column(0).to_numpy().view(np.uint64), own.column(1).to_numpy()
        order_ = np.argsort(keys)
        counts = keys[order_], n[order_], low.column(0).to_numpy().view(np.uint64), low.column(1).to_numpy()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, counts))

    asked = blocks.where("part >= 0").select("part", "block", "hashes", "counts")
    answers = materialize(asked.groupBy("part").applyInArrow(_answer, ANSWERS_SCHEMA), "answers")
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    learnt = texts.where("not held_out")
    texts_learnt = learnt.count()
    tokens = _train_words(blocks) + texts_learnt

    replies = answers.select("part", "block", "counts")
    run = _score_block(shared(0), order, shards, tokens, texts_learnt, vocabulary + (texts_learnt > 0))
    scored = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORES_SCHEMA)
    if shards > 1:
        shares = []
        for shard in range(1, shards):
            part = texts.select("block", "ordinal", "text").mapInArrow(_shard_share(shared(shard), order, shard, shards), "block long, ordinal int, share double")
            shares.append(materialize(part, "share"))
        both = shares[0]
        for part in shares[1:]:
            both = both.unionByName(part)
        both = both.groupBy("block", "ordinal").agg(F.sum("share").alias("share"))
        scored = scored.join(both, ["block", "ordinal"]).withColumn("score", F.col("score") + F.col("share"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _train_words(blocks: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int(np.frombuffer(x, np.uint32).sum(dtype=np.int64)) for x in batch.column("counts").to_pylist())
            yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    total = blocks.where("part >= 0").select("counts").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return total or 0
