"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's features are its words, runs of neighbouring words, punctuation marks, runs of these, and
for each pair of neighbouring words whether they are the same, hashed to a fixed number of weights; x[j] is the number of occurrences over the root of their total.
Slices of the labelled rows learn side by side with per-coordinate FTRL-proximal updates and their
weights are averaged. (McMahan et al., Ad Click Prediction, 2013; Zinkevich et al., Parallelized
Stochastic Gradient Descent, 2010.) The score of a text is a sparse dot product, one pass over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softseek.llm import words as W
from softseek.llm.frames import append
from softseek.session import materialize

#: Letters, digits and white space separate punctuation marks.
MARKS = W.byte_values(bytes(b for b in range(256) if b <= 32 or b >= 127 or chr(b).isalnum()))


@dataclass(frozen=True)
class Settings:
    """``bits``: log2 of the number of weights. ``max_rows``: bound of the labelled sample, of which
    every ``slice_rows`` learn side by side."""

    bits: int = 18
    ngram: int = 2
    max_rows: int = 20_000
    slice_rows: int = 2_500
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


def _features(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of all texts, and where each text's begin."""
    data, offsets = W.string_bytes(column)
    found, owner = [], []
    for kind, values in enumerate((W.BLANK_SEPARATED, MARKS)):
        words, begins = W.word_hashes(data, offsets, values)
        text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        for n in range(1, settings.ngram + 1):
            if len(words) < n:
                continue
            inside = text[: len(words) - n + 1] == text[n - 1 :]
            hashed = W.runs(words, n) + W.spread(50 * kind + n)
            found.append((W.mix(hashed) >> np.uint64(64 - settings.bits))[inside].astype(np.int64))
            owner.append(text[: len(words) - n + 1][inside])
        if len(words) > 1:
            inside = text[:-1] == text[1:]
            pattern = W.spread(90 + 2 * kind + (words[:-1] == words[1:])) >> np.uint64(64 - settings.bits)
            found.append(pattern[inside].astype(np.int64))
            owner.append(text[:-1][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(offsets)))


_EXAMPLES = pa.schema([("slice", pa.int32()), ("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary()), ("counts", pa.binary())])
EXAMPLES_SCHEMA = "slice int, doc_id long, label int, features binary, counts binary"


def _example_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.chunks(batches, "text", 2 << 20):
            found, begins = _features(chunk.column("text"), settings)
            features, counts = [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                index, n = np.unique(found[a:b], return_counts=True)
                features.append(index.astype(np.uint32).tobytes())
                counts.append(n.astype(np.uint32).tobytes())
            columns = [chunk.column(c) for c in ("slice", "doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(features, pa.binary()), pa.array(counts, pa.binary())], schema=_EXAMPLES)

    return run


_WEIGHTS = pa.schema([("feature", pa.int64()), ("weight", pa.float64())])
WEIGHTS_SCHEMA = "feature long, weight double"


def _learn(settings: Settings):
    """FTRL-proximal over the examples of one slice; the last weight is the bias."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        bias = 1 << settings.bits
        examples = []
        for label, f, c in zip(*(table.column(n).to_pylist() for n in ("label", "features", "counts")), strict=True):
            counts = np.frombuffer(c, np.uint32)
            x = np.append(counts / np.sqrt(max(counts.sum(), 1)), 1.0)
            examples.append((np.append(np.frombuffer(f, np.uint32).astype(np.int64), bias), x, label))
        z, n = np.zeros(bias + 1), np.zeros(bias + 1)
        shuffle = np.random.default_rng(7)

        def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
            shrunk = np.sign(z) * np.maximum(np.abs(z) - settings.l1, 0)
            return -shrunk / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)

        for _ in range(settings.epochs):
            for i in shuffle.permutation(len(examples)):
                index, x, label = examples[i]
                own_z, own_n = z[index], n[index]
                w = weights(own_z, own_n)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - label) * x
                sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / settings.alpha
                z[index] = own_z + g - sigma * w
                n[index] = own_n + g * g
        w = weights(z, n)
        held = np.flatnonzero(w)
        return pa.table([held, w[held]], schema=_WEIGHTS)

    return run


def sampled(labels: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the labels, chosen by the hash of doc_id; all, if there are no more."""
    share = min(1.0, rows / max(labels.count(), 1))
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from ``docs(doc_id, text)`` and ``labels(doc_id, quality 0/1)``.

    At most about ``settings.max_rows`` labelled rows are read, chosen by the hash of doc_id; that
    bounds what is broadcast and what a slice holds. Rows without label or doc_id teach nothing;
    repeated labels count each. Without any label all weights are 0 and every score is 0.5.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    taken = materialize(sampled(known, settings.max_rows), "labels")
    slices = max(1, -(-taken.count() // settings.slice_rows))
    sliced = taken.withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(slices)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sliced), "doc_id")
    examples = rows.select("slice", "doc_id", "label", "text").mapInArrow(_example_rows(settings), EXAMPLES_SCHEMA)
    learnt = examples.groupBy("slice").applyInArrow(_learn(settings), WEIGHTS_SCHEMA)
    total_weights = learnt.groupBy("feature").agg(F.sum("weight").alias("weight")).toArrow()  # at most 2 ** bits + 1 rows
    weights = np.zeros((1 << settings.bits) + 1)
    weights[total_weights.column("feature").to_numpy()] = total_weights.column("weight").to_numpy() / slices
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1). Null and blank texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(column: pa.Array) -> list:
        w = shared.value
        found, begins = _features(column, settings)
        # Summed text by text, so that equal texts have equal scores.
        sums = np.add.reduceat(np.append(w[found], 0.0), begins[:-1]) if len(begins) > 1 else np.zeros(0)
        raw = np.where(np.diff(begins) > 0, sums, 0.0) / np.sqrt(np.maximum(np.diff(begins), 1)) + w[-1]
        return [1 / (1 + np.exp(-np.clip(raw, -35, 35)))]

    return append(docs, text, "score double", compute, 2 << 20)
