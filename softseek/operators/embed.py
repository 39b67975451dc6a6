"""Batch embedding and index construction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softseek.functions.text import truncate_text
from softseek.operators.ordering import dense_index

DIMENSIONS = 384
MAX_CHARS = 4000
DOC_BATCH = 64
QUERY_BATCH = 32

PAYLOAD = ("doc_id", "category", "all_newsgroups", "is_cross_post", "subject", "word_count", "text")


def fit_text_model(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, max_chars: int = MAX_CHARS) -> PipelineModel:
    """The default embedder, for use without a neural model: hashed TF-IDF of unit length."""
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(_cut(text, max_chars).alias("_text")))


def _cut(text: str, max_chars: int) -> Column:
    """The text as the models get it; null is empty."""
    return truncate_text(F.coalesce(F.col(text), F.lit("")), max_chars)


def embed_texts(
    df: DataFrame,
    model: PipelineModel | Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "text",
    batch_size: int = DOC_BATCH,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Adds ``embedding``: unit vectors of the texts, truncated to ``max_chars`` characters.

    ``model`` is a fitted text model, or a function that loads a network once per worker and returns
    ``texts -> matrix``, which is called for ``batch_size`` texts at a time.
    """
    cut = _cut(text, max_chars)
    if isinstance(model, PipelineModel):
        out = model.transform(df.withColumn("_text", cut))
        unit = vector_to_array(F.col("_unit"), "float32")
        return out.withColumn("embedding", unit).drop("_text", "_tokens", "_counts", "_weights", "_unit")

    def load():
        predict = model()

        def unit_vectors(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(predict(texts), dtype=np.float64)
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            return (vectors / np.where(lengths > 0, lengths, 1.0)).astype(np.float32)

        return unit_vectors

    predict = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", predict(cut))


def assign_point_ids(df: DataFrame) -> DataFrame:
    """Dense ids from 0 in (category, doc_id) order."""
    return dense_index(df, "category", "doc_id", name="point_id")


def build_index(docs: DataFrame, model, batch_size: int = DOC_BATCH) -> DataFrame:
    """Documents as index points: id, vector, payload. Ids first, so that vectors are not sorted."""
    numbered = assign_point_ids(docs.select(*PAYLOAD))
    return embed_texts(numbered, model, batch_size=batch_size).select("point_id", "embedding", *PAYLOAD)
