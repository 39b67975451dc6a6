"""Cluster model and assignments on disk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame, SparkSession

from softseek.operators.clusters import FcmModel, assignments, centers_array, centers_frame, fcm_memberships, reduce_dims

_PARAMS = "k int, m double, n_components int, iterations int"


@dataclass
class ClusterModel:
    """Reducer and centres that belong together, plus the scores k was chosen by."""

    reducer: PCAModel | None
    centers: np.ndarray
    m: float
    iterations: int = 0
    scores: DataFrame | None = None

    def memberships(self, df: DataFrame) -> DataFrame:
        """Project with the fitted reducer, then weigh the centres."""
        if self.reducer is None:
            return fcm_memberships(df, self.centers, self.m)
        return fcm_memberships(reduce_dims(df, self.reducer), self.centers, self.m, "reduced").drop("reduced")


def save_cluster_model(spark: SparkSession, model: ClusterModel | FcmModel, path: str) -> None:
    reducer, scores = getattr(model, "reducer", None), getattr(model, "scores", None)
    centers_frame(spark, model.centers).write.mode("overwrite").parquet(f"{path}/centroids")
    row = (len(model.centers), float(model.m), int(model.centers.shape[1]), int(model.iterations))
    spark.createDataFrame([row], _PARAMS).write.mode("overwrite").parquet(f"{path}/params")
    if reducer is not None:
        reducer.write().overwrite().save(f"{path}/reducer")
    if scores is not None:
        scores.write.mode("overwrite").parquet(f"{path}/scores")


def _optional(load):
    try:
        return load()
    except Exception as e:  # a missing part is reported by path, whatever layer notices it
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def load_cluster_model(spark: SparkSession, path: str) -> ClusterModel:
    try:
        centers = centers_array(spark.read.parquet(f"{path}/centroids"))
        params = spark.read.parquet(f"{path}/params").head()
    except AnalysisException as e:
        raise FileNotFoundError(f"no cluster model at {path}; fit and save one first") from e
    reducer = _optional(lambda: PCAModel.load(f"{path}/reducer"))
    scores = _optional(lambda: spark.read.parquet(f"{path}/scores"))
    return ClusterModel(reducer, centers, params["m"], params["iterations"], scores)


def write_assignments(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The per-document cluster table."""
    assignments(df).write.mode("overwrite").format(fmt).save(path)


def read_assignments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    schema = (
        "doc_id string, category string, dominant_cluster int, max_membership double, memberships array<double>"
    )
    return spark.read.format(fmt).schema(schema).load(path)
