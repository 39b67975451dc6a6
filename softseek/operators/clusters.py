"""Soft clustering: dimension reduction, fuzzy c-means, model selection and cluster profiles.

Fuzzy c-means follows Bezdek, Ehrlich and Full (1984). Only the model (``k`` centres of ``d`` numbers)
and scalars reach the driver; memberships are recomputed from the centres and never stored between
iterations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softseek.functions.vectors import dominant_cluster, is_boundary, max_membership
from softseek.operators.pairs import masked_vectors, vector_matrix
from softseek.session import materialize

MAX_CENTER_VALUES = 4_000_000


# ------------------------------------------------------------------------------------ reduction (E1)


def fit_reducer(df: DataFrame, n: int = 50) -> PCAModel:
    """Fit the projection of ``embedding`` to ``n`` dimensions on a corpus."""
    vectors = df.select(array_to_vector("embedding").alias("_vector"))
    return PCA(k=n, inputCol="_vector", outputCol="_reduced").fit(vectors)


def reduce_dims(df: DataFrame, model: PCAModel) -> DataFrame:
    """Apply a fitted projection; later queries use the corpus's own model."""
    projected = model.transform(df.withColumn("_vector", array_to_vector("embedding")))
    return projected.withColumn("reduced", vector_to_array("_reduced")).drop("_vector", "_reduced")


# -------------------------------------------------------------------------------------- memberships


def centers_array(centroids: DataFrame) -> np.ndarray:
    """The centre table as a matrix. A model, not data: its size is checked."""
    rows = centroids.select("cluster_id", F.size("center").alias("d")).agg(F.count("*"), F.max("d")).head()
    if (rows[0] or 0) * (rows[1] or 0) > MAX_CENTER_VALUES:
        raise ValueError("too many centre values to hold on one machine")
    table = centroids.select("cluster_id", "center").orderBy("cluster_id").collect()
    if [r["cluster_id"] for r in table] != list(range(len(table))):
        raise ValueError("cluster ids must be 0..k-1")
    return np.array([r["center"] for r in table], dtype=np.float64)


def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster_id int, center array<double>")


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, so that a row on a centre is at distance 0 exactly."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        diff = x - c
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def membership_matrix(x: np.ndarray, centers: np.ndarray, m: float) -> np.ndarray:
    """Rows of weights. A row on one or more centres gets 1 for each of them and 0 elsewhere."""
    if not len(x):
        return np.zeros((0, len(centers)))
    d = _distances(np.asarray(x, dtype=np.float64), centers)
    on_center = d == 0
    touching = on_center.any(axis=1)
    safe = np.where(touching[:, None], 1.0, d)
    closeness = (safe.min(axis=1, keepdims=True) / safe) ** (2.0 / (m - 1.0))
    u = closeness / closeness.sum(axis=1, keepdims=True)
    u[touching] = on_center[touching]
    return u


def _fit_memberships(x: np.ndarray, centers: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Memberships while fitting, and distances. A row on a centre counts as very near to it, so no
    centre loses all its weight."""
    d = np.fmax(_distances(x, centers), np.finfo(np.float64).eps)
    closeness = (d.min(axis=1, keepdims=True) / d) ** (2.0 / (m - 1.0))
    return closeness / closeness.sum(axis=1, keepdims=True), d


def _list_array(matrix: np.ndarray, valid: np.ndarray) -> pa.Array:
    """One list per row; null where not ``valid``."""
    n, d = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), pa.float64()))
    return lists if valid.all() else lists.take(pa.array(np.arange(n), mask=~valid))


def membership_column(vector: Column | str, centers: np.ndarray, m: float = 2.0) -> Column:
    """Memberships of a vector column as ``array<double>``, computed block-wise in Arrow batches.

    Null for a null vector and for one with a null or non-finite component.

    The function is declared nondeterministic, although it is not, so that the optimizer computes the
    column once instead of once per filter and column that is derived from it.
    """

    def weights(v: pa.Array) -> pa.Array:
        x, valid = masked_vectors(v)
        return _list_array(membership_matrix(x if x.shape[1] else np.zeros((len(x), centers.shape[1])), centers, m), valid)

    return F.arrow_udf(weights, "array<double>").asNondeterministic()(vector)


def fcm_memberships(df: DataFrame, centroids: DataFrame | np.ndarray, m: float = 2.0, vector: str = "embedding") -> DataFrame:
    """Adds ``memberships``, one weight per centre."""
    centers = centroids if isinstance(centroids, np.ndarray) else centers_array(centroids)
    return df.withColumn("memberships", membership_column(vector, centers, m))


# ------------------------------------------------------------------------------------------- fitting


@dataclass
class FcmModel:
    centers: np.ndarray
    m: float
    iterations: int
    objective: list[float] = field(default_factory=list)
    change: float = float("inf")

    @property
    def k(self) -> int:
        return len(self.centers)


_PARTIAL = "fit int, cluster int, dim int, value double"
_WEIGHT, _CHANGE, _OBJECTIVE = -1, -2, -3


@dataclass
class _Fit:
    """A fit on its way. ``centers`` None: the next pass uses the start memberships; ``previous`` None: the
    memberships before ``centers`` were the start memberships."""

    model: FcmModel
    n_clusters: int
    centers: np.ndarray | None
    previous: np.ndarray | None
    running: bool = True

    def uses_start(self) -> bool:
        return self.centers is None or self.previous is None


def _partial_rows(fit: int, total: np.ndarray, weight: np.ndarray, change: float, objective: float) -> pa.RecordBatch:
    k, d = total.shape
    cluster = np.concatenate([np.repeat(np.arange(k), d), np.arange(k), [-1, -1]])
    dim = np.concatenate([np.tile(np.arange(d), k), np.full(k, _WEIGHT), [_CHANGE, _OBJECTIVE]])
    value = np.concatenate([total.ravel(), weight, [change, objective]])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(value), fit), pa.int32()), pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(value, pa.float64())],
        names=["fit", "cluster", "dim", "value"],
    )


def _pass(points: DataFrame, fits: dict[int, _Fit], m: float, seed: int) -> dict[int, tuple[np.ndarray, float, float]]:
    """One distributed pass for all given fits: the next centres, the change of U and the objective of each.

    Each task sends k * (d + 1) + 2 sums per fit, which Spark adds up. Vectors that are null or have a
    null or non-finite component take no part. Start memberships are computed from the row id where a fit
    still needs them, and kept nowhere.
    """
    ways = {i: (f.n_clusters, f.centers, f.previous, f.uses_start()) for i, f in fits.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            x, valid = masked_vectors(batch.column("x"))
            if not valid.any():
                continue
            x = x[valid].astype(np.float64)
            for i, (_, centers, previous, use_start) in ways.items():
                start = vector_matrix(batch.column(f"start{i}"))[valid] if use_start else None
                u, d = (start, None) if centers is None else _fit_memberships(x, centers, m)
                um = np.fmax(u, np.finfo(np.float64).eps) ** m
                own = sums.setdefault(i, [0.0, 0.0, 0.0, 0.0])
                if centers is not None:
                    before = start if previous is None else _fit_memberships(x, previous, m)[0]
                    own[2] += float(((u - before) ** 2).sum())
                    own[3] += float((um * d**2).sum())
                own[0] = um.T @ x + own[0]
                own[1] = um.sum(axis=0) + own[1]
        for i, own in sums.items():
            yield _partial_rows(i, *own)

    starts = {f"start{i}": start_memberships(F.col("_id"), k, seed) for i, (k, _, _, use_start) in ways.items() if use_start}
    columns = points.withColumns(starts).select("x", *starts) if starts else points.select("x")
    sums = columns.mapInArrow(task, _PARTIAL).groupBy("fit", "cluster", "dim").agg(F.sum("value").alias("value"))
    # k * (d + 1) + 2 rows per fit: the models themselves.
    rows = {(r["fit"], r["cluster"], r["dim"]): r["value"] for r in sums.collect()}
    if not rows:
        raise ValueError("no vectors to cluster")
    d = max(dim for _, _, dim in rows) + 1
    found = {}
    for i, (k, _, _, _) in ways.items():
        weights = np.array([rows[i, j, _WEIGHT] for j in range(k)])
        totals = np.array([[rows[i, j, dim] for dim in range(d)] for j in range(k)])
        found[i] = totals / weights[:, None], float(np.sqrt(rows[i, -1, _CHANGE])), rows[i, -1, _OBJECTIVE]
    return found


def _advance(points: DataFrame, fits: list[_Fit], m: float, error: float, max_iter: int, seed: int) -> list[FcmModel]:
    """Takes all fits to their end together, one pass over the vectors per iteration; finished ones leave."""
    started = _pass(points, dict(enumerate(fits)), m, seed)
    following = {i: centers for i, (centers, _, _) in started.items()}
    for i, f in enumerate(fits):
        f.previous, f.centers, f.model.centers, f.running = f.centers, following[i], following[i], max_iter > 0
    for step in range(1, max_iter + 1):
        running = {i: f for i, f in enumerate(fits) if f.running}
        if not running:
            break
        for i, (centers, change, objective) in _pass(points, running, m, seed).items():
            f = running[i]
            f.model.centers, f.model.iterations, f.model.change = f.centers, step, change
            f.model.objective.append(objective)
            f.previous, f.centers, f.running = f.centers, centers, change >= error
    return [f.model for f in fits]


def start_memberships(row_id: Column, k: int, seed: int) -> Column:
    """Pseudo-random start weights that depend on the row id alone, not on partitioning."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda j: (F.pmod(F.xxhash64(row_id, j, F.lit(seed)), F.lit(1_000_003)) + 1) / F.lit(1_000_003.0),
    )
    totals = F.array_repeat(F.aggregate(raw, F.lit(0.0), lambda a, b: a + b), k)
    return F.zip_with(raw, totals, lambda u, total: u / total)


def fcm_fit(
    df: DataFrame,
    k: int | None = None,
    m: float = 2.0,
    error: float = 0.005,
    max_iter: int = 1000,
    seed: int = 42,
    vector: str = "embedding",
    row_id: str = "point_id",
    initial_centers: np.ndarray | None = None,
) -> FcmModel:
    """Iterate until the memberships move by less than ``error`` (Frobenius norm) or ``max_iter``.

    Iteration t computes centres from the memberships of t-1, then memberships from those centres.
    Vectors that are null or have a null or non-finite component teach nothing. With ``initial_centers`` the first memberships come from these instead of the seed.
    """
    if k is None:
        if initial_centers is None:
            raise ValueError("give k or initial_centers")
        k = len(initial_centers)
    current = np.asarray(initial_centers, dtype=np.float64) if initial_centers is not None else None
    return _fit_together(df, [_Fit(FcmModel(None, m, 0), k, current, current)], m, error, max_iter, seed, vector, row_id)[0]


def fcm_fits(
    df: DataFrame,
    ks: Iterable[int],
    m: float = 2.0,
    error: float = 0.005,
    max_iter: int = 1000,
    seed: int = 42,
    vector: str = "embedding",
    row_id: str = "point_id",
) -> list[FcmModel]:
    """``fcm_fit`` for several k at once: as many passes over the vectors as the slowest needs."""
    fits = [_Fit(FcmModel(None, m, 0), k, None, None) for k in ks]
    return _fit_together(df, fits, m, error, max_iter, seed, vector, row_id) if fits else []


def _fit_together(df: DataFrame, fits: list[_Fit], m: float, error: float, max_iter: int, seed: int, vector: str, row_id: str) -> list[FcmModel]:
    points = df.select(F.col(vector).alias("x"), F.col(row_id).alias("_id")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _advance(points, fits, m, error, max_iter, seed)
    finally:
        points.unpersist()


def fuzzy_partition_coefficient(df: DataFrame) -> DataFrame:
    """Mean of the squared memberships per row: 1 is crisp, 1/k is uniform."""
    squares = F.aggregate("memberships", F.lit(0.0), lambda acc, u: acc + u * u)
    return df.agg(F.avg(squares).alias("fpc"))


# ---------------------------------------------------------------------------------------- silhouette


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the lowest hash ``order``.

    Every task would offer its own lowest ``n``. In a large table only hashes in the lowest part of their
    range, wide enough for twice ``n`` rows, are looked at; if they are too few after all, every row is.
    """
    total = rows.count()
    if total > 4 * n:
        bound = int((2 * n + 1000) / total * 2**64) - 2**63
        low = rows.where(F.col("order") <= min(bound, 2**63 - 1))
        if low.select("id").count() >= n:
            rows = low
    return rows.orderBy("order", "id").limit(n)


def silhouette(
    df: DataFrame,
    label: str = "dominant_cluster",
    vector: str = "embedding",
    row_id: str = "point_id",
    sample: int = 3000,
    seed: int = 42,
) -> float:
    """Exact Euclidean silhouette of a seeded sample of ``sample`` rows.

    The sample is the operator's parameter and bounds what is shared with the tasks. Each task compares
    a block of rows with the whole sample and keeps one distance sum per row and cluster.
    """
    rows = df.select(
        F.col(vector).alias("x"), F.col(label).cast("int").alias("label"),
        F.xxhash64(F.col(row_id), F.lit(seed)).alias("order"), F.col(row_id).alias("id"),
    )
    chosen = _lowest(rows, sample).select("x", "label").toArrow()
    if not chosen.num_rows:
        raise ValueError("no rows")
    points = vector_matrix(chosen.column("x")).astype(np.float64)
    names, labels = np.unique(chosen.column("label").to_numpy(), return_inverse=True)
    n, n_labels = len(points), len(names)
    if not 2 <= n_labels <= n - 1:
        raise ValueError(f"silhouette needs between 2 and n - 1 labels, got {n_labels} for {n} rows")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((points, labels))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = shared.value
        members = np.eye(n_labels)[own]
        sizes = members.sum(axis=0)
        for batch in batches:
            rows = np.concatenate([np.arange(r["lo"], r["hi"]) for r in batch.to_pylist()] or [np.arange(0)])
            total = 0.0
            for i in rows:
                diff = x - x[i]
                sums = np.sqrt(np.einsum("ij,ij->i", diff, diff)) @ members
                mine = own[i]
                if sizes[mine] == 1:
                    continue
                a = sums[mine] / (sizes[mine] - 1)
                others = np.delete(sums / sizes, mine)
                b = others.min()
                total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
            yield pa.RecordBatch.from_pydict({"total": pa.array([total], pa.float64())})

    step = 256
    ranges = spark.createDataFrame([(lo, min(lo + step, n)) for lo in range(0, n, step)], "lo int, hi int")
    parts = ranges.repartition(max(1, -(-n // step))).mapInArrow(task, "total double")
    return float(parts.agg(F.sum("total")).head()[0]) / n


def sweep_k(
    df: DataFrame,
    ks: Iterable[int] = range(10, 21),
    m: float = 2.0,
    error: float = 0.005,
    max_iter: int = 300,
    seed: int = 42,
    vector: str = "embedding",
    row_id: str = "point_id",
    sample: int = 3000,
) -> DataFrame:
    """``k, silhouette, iterations, is_best``: largest silhouette, smallest k on ties.

    All k are fitted together (``fcm_fits``). A k that leaves too few clusters to score has null scores; if all do the smallest k is best. Other
    failures end the sweep.
    """
    ks = list(ks)
    scored = []
    points = df.select(row_id, vector).where(F.col(vector).isNotNull())
    try:
        models = fcm_fits(points, ks, m, error, max_iter, seed, vector, row_id)
    except ValueError:
        models = [None] * len(ks)
    for k, model in zip(ks, models, strict=True):
        try:
            if model is None:
                raise ValueError("no vectors to cluster")
            weighted = fcm_memberships(points, model.centers, m, vector).where("memberships is not null")
            hard = weighted.withColumn("dominant_cluster", dominant_cluster(F.col("memberships")))
            scored.append((k, silhouette(hard, "dominant_cluster", vector, row_id, sample, seed), model.iterations))
        except ValueError:
            scored.append((k, None, None))
    good = [s for s in scored if s[1] is not None and s[1] > -1.0]
    best = max(good, key=lambda s: (s[1], -s[0]))[0] if good else min(ks)
    rows = [(k, score, iterations, k == best) for k, score, iterations in scored]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, iterations int, is_best boolean")


def best_k(scores: DataFrame) -> int:
    return scores.where("is_best").head()["k"]


# ------------------------------------------------------------------------------------------ profiles


def assignments(df: DataFrame) -> DataFrame:
    """The per-document result table."""
    return df.select(
        "doc_id",
        "category",
        dominant_cluster(F.col("memberships")).alias("dominant_cluster"),
        max_membership(F.col("memberships")).alias("max_membership"),
        "memberships",
    )


def cluster_profile(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Per dominant cluster: documents, mean own membership, boundary documents."""
    u = F.col("memberships")
    return (
        df.select(
            dominant_cluster(u).alias("cluster_id"), max_membership(u).alias("own"), is_boundary(u, share).alias("boundary")
        )
        .groupBy("cluster_id")
        .agg(
            F.count("*").alias("docs"),
            F.avg("own").alias("avg_confidence"),
            F.count_if("boundary").alias("boundary_docs"),
        )
    )


def top_categories(df: DataFrame, n: int = 3) -> DataFrame:
    """Per cluster its ``n`` most common categories; ties by the lowest point id in the cluster.

    The counts per cluster and category are read twice, for the ranking and for the totals, and stored
    in between; the ranking drops all but ``n`` rows per cluster and task before it is shuffled.
    """
    counts = (
        df.select(dominant_cluster(F.col("memberships")).alias("cluster_id"), "category", "point_id")
        .groupBy("cluster_id", "category")
        .agg(F.count("*").alias("docs"), F.min("point_id").alias("_first"))
    )
    counts = materialize(counts, "counts")
    order = Window.partitionBy("cluster_id").orderBy(F.desc("docs"), F.asc("_first"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_first")
    totals = counts.groupBy("cluster_id").agg(F.sum("docs").alias("_total"))
    return top.join(totals, "cluster_id").select(
        "cluster_id", "rank", "category", "docs", (F.lit(100.0) * F.col("docs") / F.col("_total")).alias("percent")
    )


def boundary_summary(df: DataFrame, share: float = 0.7) -> DataFrame:
    boundary = F.count_if(is_boundary(F.col("memberships"), share))
    return df.agg(boundary.alias("boundary_docs"), F.count("*").alias("docs")).withColumn(
        "percent", F.try_divide(F.lit(100.0) * F.col("boundary_docs"), F.col("docs"))
    )
