"""Collocations from a weighted de Bruijn graph of word runs, a graph per language in one table.

Texts are cut into pieces, pieces into words. At every place of a piece stands one record: the run of
``WIDTH`` words from there on, or the shorter rest of the piece. Full runs are the edges between two
overlapping nodes of ``WIDTH - 1`` words; the rests are the corrections for ends of pieces. Tasks count
the records of a million words at a time and send them, sorted and packed, by their first two words; a
hot pair is spread by its third word. Where they meet, equal edges are added up, and the count of every
shorter run is what flows through its node: all edges that begin with it plus the ends. So only the
longest runs are ever counted and shuffled.

Edges that are frequent enough form the graph that is searched: chains of nodes with one way in and one
way out of the same weight are compacted into passages by pointer doubling; phrases are scored by their
weakest cut and dropped where a longer one is nearly as frequent.

Words are nodes by a 64-bit hash of language and word; the names of all nodes are kept and compared,
and a collision has the count done again with another hash, so that counts are exact.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softseek.llm import frames
from softseek.llm import words as W
from softseek.session import materialize

WIDTH = 4
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Words counted together in a task, bytes of text for which there is a bucket, and those of the sample of the layout.
FLUSH_WORDS, BUCKET_BYTES, LAYOUT_BYTES = 1 << 20, 12 << 20, 8 << 20
#: A pair is spread if it has this share of the sample, or a quarter of a bucket.
HOT_SHARE = 1 / 16384

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[np.frombuffer(BREAKS, np.uint8)] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PACKED = "bucket int, kind string, n long, lang string, packed binary"
_COUNTED = "kind string, run array<long>, node long, f long, lang string, word string"
_COUNTED_NAMES = ["kind", "run", "node", "f", "lang", "word"]


def _compress(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _decompress(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True)


def _byte_values(seed: int) -> np.ndarray:
    values = W.spread(np.arange(256) + 4096 * (seed + 1)) | np.uint64(1)
    values[65:91] = values[97:123]
    values[np.frombuffer(BLANKS + BREAKS, np.uint8)] = 0
    return values


def _lang_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _windows(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets; one long text in windows that end behind a break."""
    if len(offsets) > 2 or len(data) <= 2 * size:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        stop = at + size
        while stop < len(data):
            breaks = np.flatnonzero(_IS_BREAK[data[stop : stop + size]])
            if len(breaks):
                stop += int(breaks[0]) + 1
                break
            stop += size
        stop = min(stop, len(data))
        yield data[at:stop], np.array([0, stop - at])
        at = stop


class _Words:
    """Words of texts in order: their node, their piece, and what they are called."""

    def __init__(self, seed: int):
        self.values = _byte_values(seed)
        self.clear()

    def clear(self) -> None:
        self.nodes, self.pieces, self.sources, self.n, self.last = [], [], [], 0, 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        hashes, starts = W.word_places(data, offsets, self.values)
        text = np.searchsorted(offsets, starts, side="right") - 1
        distinct = sorted(set(langs))
        which = np.array([distinct.index(x) for x in langs] or [0])[text] if len(text) else text
        seeds = np.array([_lang_seed(x) for x in distinct] or [0], np.uint64)
        nodes = W.mix(hashes + seeds[which])
        nodes[nodes == 0] = 1  # 0 stands behind the end of a piece
        breaks = np.flatnonzero(_IS_BREAK[data])
        self.nodes.append(nodes)
        self.pieces.append(np.searchsorted(breaks, starts) + text + self.last)
        self.last += len(breaks) + len(offsets)
        self.sources.append((self.n, starts, which, distinct, data, offsets))
        self.n += len(nodes)

    def names(self, places: np.ndarray) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        """The words at ascending places, by language: numbers into ``places`` and the words."""
        for first, starts, which, distinct, data, offsets in self.sources:
            a, b = np.searchsorted(places, (first, first + len(starts)))
            own = places[a:b] - first
            ends = np.sort(np.concatenate((np.flatnonzero(self.values[data] == 0), offsets)))
            begin = starts[own]
            end = ends[np.searchsorted(ends, begin, side="right")]
            raw = data.tobytes().translate(_LOWER)
            for k, lang in enumerate(distinct):
                mine = np.flatnonzero(which[own] == k)
                if len(mine):
                    yield lang, a + mine, [raw[x:y] for x, y in zip(begin[mine].tolist(), end[mine].tolist(), strict=True)]

    def lang_counts(self) -> Iterator[tuple[str, int]]:
        for _, _, which, distinct, _, _ in self.sources:
            yield from zip(distinct, np.bincount(which, minlength=len(distinct)).tolist())

    def runs(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The distinct nodes behind a 0, the place where each stands first, and the distinct records:
        four columns of numbers into the nodes (0 behind a piece's end) in ascending order, and their counts."""
        nodes, piece = np.concatenate(self.nodes), np.concatenate(self.pieces)
        distinct, first, which = np.unique(nodes, return_index=True, return_inverse=True)
        codes = [(which + 1).astype(np.int32)]
        del nodes, which
        for k in range(1, WIDTH):
            code = np.zeros(len(piece), np.int32)
            code[:-k] = np.where(piece[k:] == piece[:-k], codes[0][k:], 0)
            codes.append(code)
        del piece
        base = np.int64(len(distinct) + 1)
        _, low = np.unique(codes[2] * base + codes[3], return_inverse=True)
        high, lows = codes[0] * base + codes[1], int(low.max()) + 1
        if int(base) * int(base) * lows < 1 << 63:
            high *= lows
            high += low
            del low
            order = np.argsort(high)
            high = high[order]
            fresh = high[1:] != high[:-1]
        else:
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            fresh = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        del high
        begins = np.flatnonzero(np.append(True, fresh))
        rows = order[begins]
        return np.append(np.uint64(0), distinct), first, [c[rows] for c in codes], np.diff(np.append(begins, len(order)))


def _pack(names: np.ndarray, codes: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Records as numbers into the nodes that they have, these nodes, and counts, each as narrow as it can be."""
    used = np.zeros(len(names), bool)
    for c in codes:
        used[c] = True
    own = np.flatnonzero(used)
    place = np.zeros(len(names), np.int32)
    place[own] = np.arange(len(own), dtype=np.int32)
    wide, long = len(own) > 1 << 16, int(counts.max()) > 255
    columns = [place[c].astype(np.uint32 if wide else np.uint16).tobytes() for c in codes]
    raw = b"".join([names[own].tobytes(), *columns, counts.astype(np.uint32 if long else np.uint8).tobytes()])
    head = np.array([len(own), len(counts), wide, long, len(raw)], np.int64).tobytes()
    return head + _compress(raw)


def _unpack(packed: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    own, n, wide, long, size = np.frombuffer(packed, np.int64, 5).tolist()
    raw = _decompress(packed[40:], size)
    names = np.frombuffer(raw, np.uint64, own)
    kind, at, nodes = np.dtype(np.uint32 if wide else np.uint16), 8 * own, []
    for _ in range(WIDTH):
        nodes.append(names[np.frombuffer(raw, kind, n, at)])
        at += n * kind.itemsize
    return nodes, np.frombuffer(raw, np.uint32 if long else np.uint8, n, at).astype(np.int64)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(W.mix(first + np.uint64(17)) + second)


class Layout:
    """Which bucket a record goes to: by its first two words, those of hot pairs by the third too."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = buckets
        self.hot = np.array(sorted(hot), np.uint64)
        self.salts = np.array([hot[h] for h in sorted(hot)], np.uint64)

    def is_hot(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.hot, pairs), len(self.hot) - 1)
        return self.hot[at] == pairs

    def bucket(self, pairs: np.ndarray, third: np.ndarray) -> np.ndarray:
        pairs = pairs.copy()
        hot = self.is_hot(pairs)
        if hot.any():
            salts = self.salts[np.searchsorted(self.hot, pairs[hot])]
            with np.errstate(over="ignore"):
                pairs[hot] = W.mix(pairs[hot] + W.mix(third[hot] + np.uint64(29)) % salts + np.uint64(1))
        return (pairs % np.uint64(self.buckets)).astype(np.int64)

    def name_bucket(self, nodes: np.ndarray) -> np.ndarray:
        return (nodes % np.uint64(max(1, self.buckets // 4))).astype(np.int64)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the rows that have it, in their order."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    own = keys[order]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
    for a, b in itertools.pairwise([*cuts, len(own)]):
        yield int(own[a]), order[a:b]


def _read(batches: Iterator[pa.RecordBatch], words: _Words, flush) -> Iterator:
    """Adds all texts to ``words`` and yields what ``flush`` makes of it, once per ``FLUSH_WORDS`` and at the end."""
    for chunk in W.chunks(batches, "text", 1 << 20):
        data, offsets = W.string_bytes(chunk.column("text"))
        langs = chunk.column("lang").to_pylist()
        for part, ends in _windows(data, offsets):
            words.add(part, ends, langs)
            if words.n >= FLUSH_WORDS:
                yield from flush()
                words.clear()
    if words.n:
        yield from flush()


def _pack_runs(layout: Layout, seed: int):
    """Texts to packed records, names and totals by bucket."""
    names = ["bucket", "kind", "n", "lang", "packed"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(seed)

        def rows() -> Iterator[tuple]:
            nodes, first, codes, counts = words.runs()
            for bucket, own in _slices(layout.bucket(_pair_hash(nodes[codes[0]], nodes[codes[1]]), nodes[codes[2]])):
                yield bucket, "run", len(own), None, _pack(nodes, [c[own] for c in codes], counts[own])
            order = np.argsort(first)
            ordered = nodes[1:][order]
            for lang, places, called in words.names(first[order]):
                own = ordered[places]
                for bucket, mine in _slices(layout.name_bucket(own)):
                    # No word holds a break, so a newline parts them.
                    raw = own[mine].tobytes() + b"\n".join([called[i] for i in mine.tolist()])
                    yield bucket, "name", len(mine), lang, len(raw).to_bytes(8, "little") + _compress(raw)
            for lang, n in words.lang_counts():
                yield 0, "total", n, lang, b""

        def flush() -> Iterator[pa.RecordBatch]:
            made = rows()
            while part := list(itertools.islice(made, 512)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

        yield from _read(batches, words, flush)

    return run


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin to differ from the row before."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _counted(kind: str, nodes: list[np.ndarray], f: np.ndarray) -> pa.RecordBatch:
    n, width = len(f), len(nodes)
    flat = np.stack(nodes, axis=1).reshape(-1).view(np.int64) if n else np.zeros(0, np.int64)
    runs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), runs, pa.nulls(n, pa.int64()), pa.array(f.astype(np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
        names=_COUNTED_NAMES,
    )


def _add_up(layout: Layout, least: int):
    """Packed rows, bucket by bucket, to counted runs: ``run`` (frequent, whole), ``pair`` and ``word``
    (flows to be added up), ``name``, ``total`` and ``collision``."""

    def flows(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(p) for p in packed]
        nodes = [np.concatenate([n[k] for n, _ in parts]) for k in range(WIDTH)]
        counts = np.concatenate([c for _, c in parts])
        parts.clear()
        order = np.lexsort(nodes[::-1])
        nodes = [n[order] for n in nodes]
        counts = counts[order]
        for width in range(WIDTH, 0, -1):
            # A node's flow: all records that begin with it, those that end behind it included.
            begins = _starts(nodes[:width])
            counts = np.add.reduceat(counts, begins)
            nodes = [n[begins] for n in nodes[:width]]
            whole = nodes[-1] != 0
            if width == 1:
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["word"] * n, pa.string()), pa.nulls(n, pa.list_(pa.int64())), pa.array(nodes[0].view(np.int64)), pa.array(counts),
                     pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=_COUNTED_NAMES
                )
                return
            spread = layout.is_hot(_pair_hash(*nodes)) if width == 2 else np.zeros(len(counts), bool)
            final = np.flatnonzero(whole & ~spread & (counts >= least))
            yield _counted("run", [n[final] for n in nodes], counts[final])
            if spread.any():
                part = np.flatnonzero(whole & spread)
                yield _counted("pair", [n[part] for n in nodes], counts[part])

    def called(packed: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[str, bytes]] = {}
        for n, lang, blob in packed:
            raw = _decompress(blob[8:], int.from_bytes(blob[:8], "little"))
            nodes = np.frombuffer(raw, np.int64, n).tolist()
            for node, word in zip(nodes, raw[8 * n :].split(b"\n"), strict=True):
                if known.setdefault(node, (lang, word)) != (lang, word):
                    yield _counted("collision", [np.zeros(1, np.uint64)], np.ones(1))
        n, nodes = len(known), pa.array(list(known), pa.int64())
        langs, words = pa.array([v[0] for v in known.values()], pa.string()), pa.array([v[1] for v in known.values()], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["name"] * n, pa.string()), pa.nulls(n, pa.list_(pa.int64())), nodes, pa.nulls(n, pa.int64()), langs, words], names=_COUNTED_NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "n", "lang", "packed")), strict=True)

        for (_, kind), group in itertools.groupby(rows(), key=lambda r: r[:2]):
            if kind == "run":
                yield from flows([p for *_, p in group])
            elif kind == "name":
                yield from called([(n, lang, p) for _, _, n, lang, p in group])
            else:
                totals: dict[str, int] = {}
                for _, _, n, lang, _ in group:
                    totals[lang] = totals.get(lang, 0) + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["total"] * len(totals), pa.string()), pa.nulls(len(totals), pa.list_(pa.int64())), pa.nulls(len(totals), pa.int64()),
                     pa.array(list(totals.values()), pa.int64()), pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string())],
                    names=_COUNTED_NAMES,
                )

    return run


def _layout(texts: DataFrame, bucket_bytes: int, seed: int) -> Layout:
    """Buckets by the bytes of all texts; hot pairs by a sample, which decides where records meet and nothing else."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(seed)

        def flush() -> Iterator[pa.RecordBatch]:
            nodes, _, codes, counts = words.runs()
            begins = _starts(codes[:2])
            sums, found = np.add.reduceat(counts, begins), _pair_hash(nodes[codes[0][begins]], nodes[codes[1][begins]])
            many = np.flatnonzero(sums >= 0.5 * HOT_SHARE * words.n)
            hashes = np.append(found[many], np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.append(sums[many], words.n))], names=["pair", "n"])

        yield from _read(batches, words, flush)

    sample = texts.sample(min(1.0, LAYOUT_BYTES / max(total, 1)), seed=1)
    counted = sample.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    every = counted.where("pair = 0").first()
    if every is None:
        return Layout(buckets, {})
    share = max(HOT_SHARE, 1 / (4 * buckets))
    # At most 1 / share rows.
    hot = counted.where((F.col("n") >= share * every["n"]) & (F.col("pair") != 0)).collect()
    return Layout(buckets, {r["pair"] % (1 << 64): -(-4 * buckets * r["n"] // every["n"]) for r in hot})


def count_runs(docs: DataFrame, least: int, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All runs of 1 to ``WIDTH`` words that stand at least ``least`` times in ``docs(lang, text)``.

    Returns ``run array<long>, f``; the names of nodes, ``node, lang, word``; ``lang, n``, all words of
    each language. Null texts are empty, a null language is ``und``.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in itertools.count():
        layout = _layout(texts, bucket_bytes, seed)
        with frames.batches_of(docs.sparkSession, 4 << 20):
            packed = texts.mapInArrow(_pack_runs(layout, seed), _PACKED)
            met = packed.repartition(layout.buckets, "bucket").sortWithinPartitions("bucket", "kind")
            counted = materialize(met.mapInArrow(_add_up(layout, least), _COUNTED), "runs")
        if counted.where("kind = 'collision'").isEmpty():
            break
    pairs = counted.where("kind = 'pair'").groupBy("run").agg(F.sum("f").alias("f"))
    words = counted.where("kind = 'word'").groupBy("node").agg(F.sum("f").alias("f")).select(F.array("node").alias("run"), "f")
    runs = counted.where("kind = 'run'").select("run", "f").unionByName(pairs.unionByName(words).where(F.col("f") >= least))
    runs = materialize(runs, "frequent")
    names = counted.where("kind = 'name'").select("node", "lang", "word")
    return runs, names, counted.where("kind = 'total'").groupBy("lang").agg(F.sum("f").alias("n"))


def _doubled(state: DataFrame, label: str) -> DataFrame:
    """Pointer doubling on ``edge, back, steps, least, open``: ``back`` lies ``steps`` edges before.

    Ends when all rows have come to a beginning, or when those left go round in circles and know the
    least edge there: then neither their number nor what they know changes.
    """
    before = None
    while True:
        state = materialize(state, label)
        seen = state.where("open").agg(F.count("*"), F.sum(F.xxhash64("least").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == before:
            return state
        before = tuple(seen)
        ahead = state.select(F.col("edge").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"), F.col("least").alias("other"), F.col("open").alias("still"))
        moved = state.where("open").join(ahead, "back").select(
            "edge", F.col("further").alias("back"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "other").alias("least"),
            F.col("still").alias("open"),
        )
        state = state.where("not open").unionByName(moved)


def passages(runs: DataFrame) -> DataFrame:
    """Compacted unary paths of the graph of frequent edges: ``edge, passage, at, passage_words``.

    A node is passed through if one edge comes in, one goes out, and both have the same count.
    ``passage`` is the first edge, ``at`` the edge's place; a circle begins at its least edge. The
    passage has ``passage_words`` words.
    """
    edges = runs.where(F.size("run") == WIDTH).select(F.col("run").alias("edge"), "f")
    tail, head = F.slice("edge", 1, WIDTH - 1), F.slice("edge", 2, WIDTH - 1)
    ends = edges.select(tail.alias("node"), F.struct("f", "edge").alias("out"), F.lit(None).cast("struct<f: bigint, edge: array<bigint>>").alias("into"))
    ends = ends.unionByName(edges.select(head.alias("node"), F.lit(None).cast("struct<f: bigint, edge: array<bigint>>").alias("out"), F.struct("f", "edge").alias("into")))
    nodes = ends.groupBy("node").agg(F.count("out").alias("ways_out"), F.count("into").alias("ways_in"), F.max("out").alias("out"), F.max("into").alias("into"))
    through = nodes.where("ways_out = 1 and ways_in = 1 and out.f = into.f").select(F.col("out.edge").alias("edge"), F.col("into.edge").alias("prior"))
    linked = materialize(edges.join(through, "edge", "left").select("edge", "prior"), "edges")

    def begun(rows: DataFrame, first: Column) -> DataFrame:
        return rows.select(
            "edge", F.when(first, F.col("edge")).otherwise(F.col("prior")).alias("back"),
            F.when(first, 0).otherwise(1).cast("long").alias("steps"), F.col("edge").alias("least"), (~first).alias("open"),
        )

    state = _doubled(begun(linked, F.col("prior").isNull()), "paths")
    circles = state.where("open").select("edge", F.col("least").alias("first"))
    if not circles.isEmpty():
        cut = circles.join(linked, "edge")
        state = state.where("not open").unionByName(_doubled(begun(cut, F.col("edge") == F.col("first")), "circles"))
    found = state.select("edge", F.col("back").alias("passage"), F.col("steps").alias("at"))
    sizes = found.groupBy("passage").agg((F.count("*") + WIDTH - 1).alias("passage_words"))
    return found.join(sizes, "passage").select("edge", "passage", "at", "passage_words")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorbed: int = 80, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``WIDTH`` words by score.

    Returns ``lang, rank, phrase, a, l, r, n, score, passage_words``: ``a`` times the phrase, ``l`` and
    ``r`` the parts of its weakest cut, ``n`` words of the language, ``score`` 2,000,000 a / (l + r) rounded down, and for a
    phrase of ``WIDTH`` words the length of the compacted passage in which it lies (else null). Dropped are
    phrases inside a longer one that has at least ``absorbed`` percent of their count. Texts without
    words add nothing; an empty table gives no rows.
    """
    runs, names, totals = count_runs(docs, least, bucket_bytes)
    phrases = runs.where(F.size("run") > 1).select("run", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("run") - 1)))
    sides = F.array(
        F.struct(F.lit(True).alias("first"), F.slice("run", F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("first"), F.slice("run", F.col("k") + 1, F.size("run") - F.col("k")).alias("part")),
    )
    parts = cuts.withColumn("side", F.explode(sides)).select("run", "a", "k", "side.first", "side.part")
    known = parts.join(runs.select(F.col("run").alias("part"), "f"), "part")
    l, r = (F.max(F.when(F.col("first") == side, F.col("f"))).alias(c) for side, c in ((True, "l"), (False, "r")))
    exact = "decimal(20,0)"
    score = F.expr(f"(cast(2000000 as {exact}) * cast(a as {exact})) div (cast(l as {exact}) + cast(r as {exact}))")
    scored = known.groupBy("run", "a", "k").agg(l, r).withColumn("score", score)
    weakest = scored.groupBy("run", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every shorter phrase inside a longer one, with the largest count of those.
    spans = [(at + 1, size) for size in range(2, WIDTH) for at in range(WIDTH - size + 1)]
    fits = [F.when((F.size("run") > size) & (F.size("run") >= at + size - 1), F.slice("run", at, size)) for at, size in spans]
    inside = phrases.where(F.size("run") > 2).select(F.explode(F.array_compact(F.array(*fits))).alias("run"), F.col("a").alias("longer"))
    covered = inside.groupBy("run").agg(F.max("longer").alias("longer"))
    kept = weakest.join(covered, "run", "left").where(
        F.expr(f"longer is null or cast(100 as {exact}) * cast(longer as {exact}) < cast({absorbed} as {exact}) * cast(a as {exact})")
    )
    spelled = kept.select("run", F.posexplode("run").alias("at", "node")).join(names, "node")
    called = spelled.groupBy("run").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = kept.join(called, "run").join(totals, "lang").select(
        "run", "lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    within = passages(runs).select(F.col("edge").alias("run"), "passage_words")
    return ranked.join(within, "run", "left").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "passage_words")
