"""Corpus jobs: raw posts to documents to index to cluster model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from softseek.operators.clusters import best_k, fcm_fit, fit_reducer, reduce_dims, sweep_k
from softseek.session import materialize
from softseek.sources.models import ClusterModel

COMPONENTS = 50


def train_clusters(
    index: DataFrame, n_components: int = COMPONENTS, ks: Iterable[int] = range(10, 21), m: float = 2.0, seed: int = 42
) -> ClusterModel:
    """Reduce the index vectors, choose k by silhouette, fit the final model."""
    reducer = fit_reducer(index, n_components)
    reduced = materialize(reduce_dims(index.select("point_id", "embedding"), reducer).drop("embedding"), "reduced")
    scores = sweep_k(reduced, ks, m, seed=seed, vector="reduced")
    model = fcm_fit(reduced, best_k(scores), m, seed=seed, vector="reduced")
    return ClusterModel(reducer, model.centers, m, model.iterations, scores)
