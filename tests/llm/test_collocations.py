import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from softseek.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, least, top, absorbed):
    """Counts every run of one to four words by itself."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        rows, lengths, longest = [], chains(frequent), Counter()
        for q, b in frequent.items():
            for inner in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q)}:
                longest[inner] = max(longest[inner], b)
        for p, a in frequent.items():
            if p in longest and 100 * longest[p] >= absorbed * a:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), a, l, r, n[lang], score, lengths.get(p)))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def chains(frequent):
    """Words of the unary path through every edge, walked one edge at a time."""
    edges = {q: a for q, a in frequent.items() if len(q) == 4}
    begin, end = defaultdict(list), defaultdict(list)
    for q in edges:
        begin[q[:3]].append(q)
        end[q[1:]].append(q)
    after = {q: begin[q[1:]][0] for q in edges if len(begin[q[1:]]) == len(end[q[1:]]) == 1 and edges[begin[q[1:]][0]] == edges[q]}
    firsts = edges.keys() - set(after.values())
    out = {}
    for first in [*firsts, *edges]:  # then those on circles, which no first edge reaches
        walk, q = [], first
        while q is not None and q not in out and q not in walk:
            walk.append(q)
            q = after.get(q)
        out |= dict.fromkeys(walk, len(walk) + 3)
    return out


def result(frame):
    return sorted(((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score, r.passage_words) for r in frame.collect()), key=str)


def corpus(seed, n=200):
    random.seed(seed)
    vocabulary = ["the", "The", "of", "a", "é", "b-c", "中文", "x" * 70, "new", "york", "1"]
    passage = "this passage stands in many of the texts of this small corpus word by word"
    docs = []
    for _ in range(n):
        words = random.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=random.randint(0, 30))
        text = "".join(w + random.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for w in words)
        if random.random() < 0.3:
            text += random.choice([" ", ". "]) + passage
        if random.random() < 0.2:
            text += " ha" * random.randint(1, 9) + ". do re mi do re mi do re mi"
        docs.append((random.choice(["en", "en", "de", None, "und"]), text))
    return docs


@pytest.mark.parametrize("seed, bucket_bytes", [(1, 1 << 20), (3, 4000)])
def test_against_counting_every_run(spark, seed, bucket_bytes):
    docs = corpus(seed)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = C.collocations(table, least=8, top=40, absorbed=80, bucket_bytes=bucket_bytes)
    assert result(got) == expected(docs, 8, 40, 80)


def test_layout_spreads_hot_pairs():
    first, second, third = (W := np.arange(1, 10_001, dtype=np.uint64)) * 0 + 5, W * 0 + 6, W
    pairs = C._pair_hash(first, second)
    assert len(set(C.Layout(50, {}).bucket(pairs, third).tolist())) == 1
    hot = C.Layout(50, {int(pairs[0]): 40})
    assert len(set(hot.bucket(pairs, third).tolist())) > 20
    assert hot.is_hot(pairs).all() and not hot.is_hot(pairs + np.uint64(1)).any()


def test_hot_pair_of_a_corpus(spark):
    random.seed(8)
    docs = [("en", " ".join("hot pair " + random.choice("abcdefghijklmnop") for _ in range(30)) + f" w{i % 50}") for i in range(200)]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    layout = C._layout(table, 2000, 0)
    assert len(layout.hot) and layout.buckets > 5
    assert result(C.collocations(table, least=5, top=100, bucket_bytes=2000)) == expected(docs, 5, 100, 80)


def test_windows_of_a_long_text():
    text = np.frombuffer(("ab cd, " * 500 + "x" * 900 + ". tail").encode(), np.uint8)
    parts = list(C._windows(text, np.array([0, len(text)]), size=100))
    assert len(parts) > 10 and b"".join(p.tobytes() for p, _ in parts) == text.tobytes()
    assert all(p[-1] in C.BREAKS for p, _ in parts[:-1]) and all(o.tolist() == [0, len(p)] for p, o in parts)


def test_collisions_are_seen():
    def name(bucket, lang, node, word):
        raw = np.array([node], np.uint64).tobytes() + word
        return bucket, "name", 1, lang, len(raw).to_bytes(8, "little") + C._compress(raw)

    rows = [name(0, "en", 7, b"one"), name(0, "en", 7, b"one"), name(1, "en", 9, b"one"), name(1, "de", 9, b"one"), name(2, "en", 4, b"a"), name(2, "en", 4, b"b")]
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "kind", "n", "lang", "packed"])
    kinds = Counter(k for b in C._add_up(C.Layout(1, {}), 1)(iter([batch])) for k in b.column("kind").to_pylist())
    assert kinds == {"name": 3, "collision": 2}


def test_odd_rows(spark, odd, none):
    docs = [(None, r.text) for r in odd.collect()]
    table = odd.withColumn("lang", F.lit(None).cast("string"))
    assert result(C.collocations(table, least=2, top=500)) == expected(docs, 2, 500, 80)
    assert C.collocations(none.withColumn("lang", F.lit("en"))).collect() == []
    assert C.collocations(table.where("text is null"), least=1).collect() == []
