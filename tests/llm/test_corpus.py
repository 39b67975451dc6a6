"""Near duplicates, decontamination, mixing and quality against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from softseek.llm import components, decontaminate, jaccard, mixing, quality
from softseek.llm.queries import op3_mixing, op4_quality, op7_jaccard_join, op9_decontamination

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BLANKS, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- near duplicates ----


def shingles(text, k):
    w = BLANKS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(rows, k, percent):
    """Sizes of sets and smallest doc_id reachable, by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    real = [(i, s) for i, s in sets if s and i is not None]
    for n, (i, a) in enumerate(real):
        for j, b in real[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=key), key


@pytest.mark.parametrize(("cap", "pivots"), [(1000, 24), (4, 3)])
def test_near_duplicates_of_odd_rows(odd, none, cap, pivots):
    got = jaccard.near_duplicates(odd, 4, 85, region_documents=cap, region_pivots=pivots).collect()
    want, key = classes([(r.doc_id, r.text) for r in odd.collect()], 4, 85)
    assert sorted(map(tuple, got), key=key) == want
    assert jaccard.near_duplicates(none, 4, 85).count() == 0


@pytest.mark.parametrize(("cap", "pivots", "seed"), [(1000, 24, 1), (6, 4, 2), (3, 2, 3), (25, 5, 4)])
def test_near_duplicates_of_copies(spark, cap, pivots, seed):
    """Large groups of near copies around the threshold, chains, shared passages, hot copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(2, 45)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if rng.random() < 0.2 else base
    rows += [" ".join([word() for _ in range(rng.randint(1, 60))] + passage) for _ in range(40)]
    rows += [rows[3]] * 50 + [""] * 5
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    frame = spark.createDataFrame(numbered, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(frame, 3, 80, region_documents=cap, region_pivots=pivots).collect()
    want, key = classes(numbered, 3, 80)
    assert sorted(map(tuple, got), key=key) == want


def test_links_are_links(spark, odd):
    sets, links = jaccard.jaccard_join(odd, 4, 85)
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    assert sets.count() == odd.count() and links.count()
    for a, b in links.collect():
        x, y = shingles(texts[a], 4), shingles(texts[b], 4)
        assert 100 * len(x & y) >= 85 * len(x | y)


def test_query_near_duplicates(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, key = classes(rows, 4, 85)
    assert sorted(map(tuple, op7_jaccard_join(spark, sf).collect()), key=key) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (9, 8), (200, 139), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys([*range(100, 140), 200], 100)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination ----


def contamination(text, items, size=13):
    words = PLAIN.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for name, item in items:
        own = PLAIN.findall((item or "").translate(LOW))
        k = min(size, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else ()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(name)
    return words, hit, sorted(found)


def test_query_decontamination(spark, sf):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_decontamination(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        words, hit, found = contamination(docs[r.doc_id], items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), digest, bad)


def test_spans_cover_the_words_hit(spark, odd, none):
    items = [(1, "Lazy-dog, and RUNS"), (2, "été"), (3, None), (4, "..."), (None, "words here"), (5, "wort5"), (5, "wort5"), (6, "x" * 300_000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = [("null" if i is None else str(i), t) for i, t in items]
    rows = decontaminate.benchmark_hits(odd, benchmark, window=3).collect()
    assert len(rows) == odd.count() and rows[0].score == 1
    for r in rows:
        words, hit, found = contamination(r.text, names, 3)
        assert (r.n_words, r.n_hit, r["items"]) == (len(words), len(hit), found)
        covered = [w for s in r.spans for w in PLAIN.findall(r.text[s.start : s.end].translate(LOW))]
        assert covered == [words[i] for i in sorted(hit)]
    assert decontaminate.benchmark_hits(none, benchmark).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.benchmark_hits(odd, benchmark.limit(0)).collect())
    with pytest.raises(ValueError, match="bytes"):
        decontaminate.benchmark_hits(odd, benchmark, max_benchmark_bytes=10)


# ---- mixing ----


def seats_by_quotient(votes, seats):
    """One block at a time to the highest quotient, the smaller key in a tie."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = min((k for k in votes if votes[k]), key=lambda k: (-Fraction(votes[k]) / (2 * got[k] + 1), k))
        got[best] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 7, 64, 500])
def test_apportionment(spark, seats):
    rng = random.Random(seats)
    for votes in ([5, 5, 5, 5], [0, 0], [1], [rng.randint(0, 1000) for _ in range(40)], [2**k for k in range(12)], [300, 100, 60, 0]):
        frame = spark.createDataFrame(list(enumerate(votes)), "key long, votes long")
        got = {r.key: r.seats for r in mixing.apportion(frame, seats).collect()}
        assert got == seats_by_quotient(dict(enumerate(votes)), seats)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if most * sizes[s] < level * weight[s] or not sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for doc_id, text, source in docs:
        sizes[source] += len(BLANKS.findall(text or ""))
    want, taken = targets(sizes), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 24 for s in want)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(odd.where("text is null or doc_id in (4, 5)")).collect())


@pytest.mark.parametrize("shard", [300, 2_000_000])
def test_query_mix(spark, sf, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if shard != 300:
        assert op3_mixing(spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = mixing.mix(docs, shard_words=shard).collect()
    if shard == 300:  # many shards round more often
        assert abs(sum(r.taken for r in rows) / sum(r.size for r in rows) - 1.5) < 0.02
        assert all(r.taken <= 2 * r.size for r in rows)
    else:
        check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])


# ---- quality ----


def test_query_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_quality(spark, sf).collect()
    assert len(rows) == 1000
    right = known = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            known += 1
            right += labels[r.doc_id] == r.predicted
    assert known > 50 and right / known >= 0.95


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (8, None), (None, 1), (99, 0), (7, 0)], "doc_id long, quality int")
    weights = quality.fit_quality(odd, labels)
    rows = quality.score_quality(odd, weights).collect()
    assert len(rows) == odd.count() and rows[0].n == 2
    by = {r.doc_id: r.score for r in rows if r.doc_id}
    assert by[1] > 0.5 > by[6] and by[6] == by[7]
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    blind = quality.fit_quality(odd, labels.limit(0))
    assert {r.score for r in quality.score_quality(odd, blind).collect()} == {0.5}
    assert quality.score_quality(none, weights).count() == 0


def test_labels_beyond_the_bound_are_sampled(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.sampled(labels.select("doc_id", "quality"), 40).count() < 70
    assert quality.sampled(labels.select("doc_id", "quality"), 10_000).count() == labels.count()
    assert quality.fit_quality(docs, labels, quality.Settings(max_rows=40)).any()


def test_scores_use_the_text_alone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.fit_quality(docs, labels)
    shuffled = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("q").alias("lang"), F.lit("z").alias("source"))
    a = {r.doc_id + 7: r.score for r in quality.score_quality(docs, weights).collect()}
    assert a == {r.doc_id: r.score for r in quality.score_quality(shuffled, weights).collect()}
