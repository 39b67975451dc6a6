"""Answers over a stream against the batch job, and what a batch reads of the store."""

import re
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry.queries import QUERIES
from softseek.plans import answer
from softseek.operators.search import topk_search
from softseek.streaming import cache_stream
from softseek.streaming.store import Store
from test_cache import LOG, one_by_one, random_log


@dataclass
class Held:
    """A model whose memberships come with the queries."""

    table: object

    def memberships(self, df):
        return df.join(self.table, "seq")


def index_of(spark, n=40):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        v = rng.normal(size=5)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), f"cat{i % 3}", f"subject {i}", f"text of {i} " * 5))
    return spark.createDataFrame(rows, "point_id long, embedding array<double>, category string, subject string, text string")


def log_of(spark, rows):
    log = spark.createDataFrame(rows, LOG)
    return log.drop("memberships").withColumn("top_k", F.expr("cast(seq % 4 + 1 as int)")), Held(log.select("seq", "memberships"))


@pytest.mark.parametrize("controls, compact_every", [(False, 2), (True, 3)])
def test_answers_of_batches_equal_one_job(spark, tmp_path, controls, compact_every):
    rows = random_log(91, n=140, controls=controls)
    log, model = log_of(spark, rows)
    index, store = index_of(spark), str(tmp_path / "store")
    for n in range(7):
        part = log.where((F.col("seq") >= n * 20) & (F.col("seq") < (n + 1) * 20))
        cache_stream.answer_batch(part, n, store, index, model, 0.8, compact_every)
    got = {r.seq: r for r in cache_stream.read_answers(spark, store).collect()}
    expected = one_by_one(rows, 0.8)
    assert {s: (r.cache_hit, round(r.similarity_score, 4) if r.cache_hit else None) for s, r in got.items()} == {
        s: (hit, score) for s, (hit, _, score) in expected.items()
    }
    if not controls:
        whole = answer.answer_queries(log.drop("is_flush", "set_theta"), index, model, 0.8).collect()
        assert sorted(map(str, whole)) == sorted(map(str, got.values()))
    texts = {r.seq: r.query for r in log.collect()}
    for seq, (hit, match, _) in expected.items():
        assert got[seq].matched_query == (texts[match] if hit else None)
        assert got[seq].result == got[match if hit else seq].result
        assert got[seq].top_k == (match if hit else seq) % 4 + 1
    # a batch that is run again gives its own tables again, whatever came later
    cache_stream.answer_batch(log.where("seq between 100 and 119"), 5, store, index, model, 0.8, compact_every)
    assert sorted(map(str, cache_stream.read_answers(spark, store).collect())) == sorted(map(str, got.values()))
    held = cache_stream.read_entries(spark, store, answers=True)
    misses = [s for s, r in expected.items() if not r[0]]
    last_flush = max([r[0] for r in rows if r[4]], default=-1)
    assert sorted(r.seq for r in held.collect()) == [s for s in misses if s > last_flush]


def test_a_batch_opens_one_epoch_and_few_folders(spark, tmp_path):
    rows = random_log(17, n=200, controls=False)
    rows[90] = (90, None, None, None, True, None)
    log, model = log_of(spark, rows)
    index, path = index_of(spark), str(tmp_path / "store")
    for n in range(10):
        part = log.where((F.col("seq") >= n * 20) & (F.col("seq") < (n + 1) * 20))
        cache_stream.answer_batch(part, n, path, index, model, 0.8, 2)
    store = Store(spark, path)
    control = store.control()
    assert (control["epoch"], control["last_seq"]) == (1, 199) and control["compacted"] >= 7
    assert store._numbers("control", "batch_id") == [7, 8, 9]
    entries = cache_stream.read_entries(spark, path, answers=True)
    files = entries.inputFiles()
    assert files and all("/epoch=1/" in f for f in files)
    assert all(f"upto={control['compacted']}/" in f or "/batches/" in f for f in files)
    some = store.entries("seq long, query string, embedding array<double>, memberships array<double>, top_k int, result string", control, clusters=[2])
    assert "cluster_id" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_payload_is_joined_where_it_lies(spark):
    index = index_of(spark)
    queries = index.limit(4).select(F.col("point_id").alias("query_id"), "embedding")
    found = topk_search(queries, index.repartition(6), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.columns == ["point_id", "query_id", "rank", "score", "category", "subject", "text"]
    assert found.count() == 12


def test_payload_beside_an_index_of_vectors(spark):
    index = index_of(spark)
    queries = index.limit(4).select(F.col("point_id").alias("query_id"), "embedding")
    whole = topk_search(queries, index, 3)
    apart = topk_search(queries, index.select("point_id", "embedding"), 3, payload=index.drop("embedding"))
    assert apart.columns == whole.columns and sorted(apart.collect()) == sorted(whole.collect())


@pytest.mark.parametrize("name, searches", [("answer_stream", 4), ("answer_queries", 1)])
def test_texts_are_not_joined_with_vectors_in_every_search(spark, sf, monkeypatch, name, searches):
    plans = []

    def kept(*args, **options):
        found = topk_search(*args, **options)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(answer, "topk_search", kept)
    QUERIES[name](spark, sf)
    assert len(plans) == searches
    assert not any(re.search(r"\b_vec#", plan) for plan in plans)
