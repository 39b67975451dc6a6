"""The pipeline stage by stage against what each stage's rule keeps."""

import zlib

import pytest

import corpus_pipeline
from softseek.llm import decontaminate, mixing, quality
from softseek.session import materialize
from test_corpus import classes, contamination
from test_tokens import check

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage on the smallest tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SMALL), name)
        out[name] = docs, made
        docs = made
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    *others, _ = stages.values()
    assert all(made.schema.simpleString() == docs.schema.simpleString() for docs, made in others)


def test_quality_keeps_what_scores(spark, stages):
    docs, made = stages["quality"]
    weights = quality.fit_quality(
        corpus_pipeline.learnable(docs), corpus_pipeline.learnable(spark.read.parquet(f"{SMALL}/labels.parquet"))
    )
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, weights).collect()}
    assert rows(made) == {i: r for i, r in rows(docs).items() if scores[i] >= 0.7}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i in scores if labels.get(i) == 1]
    assert sum(scores[i] >= 0.7 for i in clean) >= 0.98 * len(clean)


def test_one_of_each_group_stays(stages):
    docs, made = stages["near_duplicates"]
    groups, _ = classes([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(rows(made)) == sorted({first for _, _, first in groups})


def test_contaminated_documents_go(spark, stages):
    docs, made = stages["decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = set()
    for i, r in rows(docs).items():
        words, hit, _ = contamination(r.text, items)
        if hit and 20 * len(hit) >= len(words):
            bad.add(i)
    assert rows(made).keys() == rows(docs).keys() - bad


def test_documents_appear_as_often_as_taken(stages):
    docs, made = stages["mixing"]
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    texts = {}
    for r in made.collect():
        texts.setdefault(r.doc_id, []).append(r)
    whole = rows(docs)
    for i, t in taken.items():
        own = texts.get(i, [])
        assert sum(len((r.text or "").split()) for r in own) == t.taken if t.size else len(own) == 1
        full = [r for r in own if r.text == whole[i].text]
        part = [r for r in own if r.text != whole[i].text]
        assert len(part) <= 1 and (not t.size or len(full) >= t.taken // t.size)
        for r in part:
            words = whole[i].text.split()
            n = t.taken % t.size
            assert r.text.split() == (words[:n] if t.head else words[-n:]) and r.n_chars == len(r.text)


def test_token_files(stages):
    docs, made = stages["token_files"]
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1]))
    check(made.collect(), texts)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(got.collect()) == sorted(stages["token_files"][1].collect())


def test_stages_take_odd_rows(spark, odd, none):
    extra = odd.selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars", "score", "items")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, extra, SMALL)
        empty = stage(spark, none.selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars"), SMALL)
        assert empty.count() == 0
        got = made.collect()
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in got) == sorted(["1", "3", "4", "5", "6", "8", "None", "None", "10", "11"])
        elif name == "decontamination":
            assert len(got) == odd.count()
        elif name == "token_files":
            assert len(got) == odd.count()
        else:
            assert made.columns == extra.columns


CLASHES = ("score", "items", "n_words", "n_hit", "spans", "taken", "size", "whole", "place", "head", "print", "kept0")


def test_other_columns_are_handed_on(spark, odd):
    """Extra columns keep their values, whatever they are called."""
    extra = odd.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars", *[f"{-i} as {c}" for i, c in enumerate(CLASHES, 2)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, extra, SMALL)
        assert made.columns == extra.columns
        assert made.select(*CLASHES).distinct().collect() == [tuple(-i for i, _ in enumerate(CLASHES, 2))]


def test_texts_that_share_a_doc_id(spark):
    words = " ".join(f"word{i}" for i in range(60))
    docs = [(1, words), (2, words + " more"), (2, "other words " * 9), (2, "other words " * 9), (3, "something else here"), (3, None), (3, ""), (None, words), (None, words)]
    table = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, table, SMALL).collect()
    want = [(1, words), (2, docs[2][1]), (3, docs[4][1]), (3, None), (3, ""), (None, words), (None, words)]
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, want))


def test_rows_without_doc_id_take_what_the_mix_takes(spark):
    docs = [(None, f"a{i} b c d e f g", "s") for i in range(40)] + [(i, "x y z", "t") for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    taken = mixing.mix(table).where("doc_id is null").agg({"taken": "sum"}).first()[0]
    made = corpus_pipeline.mixing_stage(spark, table, SMALL).where("doc_id is null").collect()
    assert sum(len(r.text.split()) for r in made) == taken


def test_learning_leaves_a_quarter_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.learnable(docs).collect()}
    assert ids == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}


def test_rule_of_contamination():
    assert decontaminate.contaminated() == "n_hit > 0 and 20 * n_hit >= n_words"
