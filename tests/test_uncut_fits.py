"""The registered fits run to the operators' own stopping rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry import inputs as src
from registry.queries import QUERIES
from softseek.operators import clusters


def one_machine(x, u, m, error=0.005, max_iter=300):
    for step in range(1, max_iter + 1):
        um = np.fmax(u, np.finfo(np.float64).eps) ** m
        new = clusters.membership_matrix(x, um.T @ x / um.sum(axis=0)[:, None], m)
        change = np.linalg.norm(new - u)
        u = new
        if change < error:
            break
    return u, step


def silhouette(x, labels):
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    total = 0.0
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            continue
        a = distance[i, mine].sum() / (mine.sum() - 1)
        b = min(distance[i, labels == other].mean() for other in set(labels) - {own})
        total += (b - a) / max(a, b)
    return total / len(x)


def start(spark, points, k):
    rows = points.select("point_id", "embedding", clusters.start_memberships(F.col("point_id"), k, 42).alias("s"))
    rows = rows.orderBy("point_id").collect()
    return np.array([r.embedding for r in rows], np.float64), np.array([r.s for r in rows])


def test_registered_sweep_is_whole(spark, sf):
    got = {r.k: r for r in QUERIES["sweep_k"](spark, sf).collect()}
    assert sorted(got) == list(range(10, 21))
    scores = {}
    for k in got:
        x, u = start(spark, src.embeddings(spark, sf), k)
        u, steps = one_machine(x, u, src.FUZZINESS)
        # of equal memberships the first cluster
        scores[k] = silhouette(x, u.argmax(axis=1))
        assert got[k].iterations == steps and got[k].silhouette == pytest.approx(scores[k], abs=1e-6)
    assert [k for k in got if got[k].is_best] == [max(scores, key=lambda k: (scores[k], -k))]


def test_registered_fits_converge(spark, sf, monkeypatch):
    models, fit = [], clusters.fcm_fit

    def kept(*args, **named):
        models.append(fit(*args, **named))
        return models[-1]

    monkeypatch.setattr(clusters, "fcm_fit", kept)
    shown = QUERIES["fcm_fit_seeded"](spark, sf).head()
    QUERIES["fcm_fit_converged"](spark, sf)
    assert all(model.change < 0.005 for model in models) and len(models) == 2
    x, u = start(spark, src.embeddings(spark, sf), 10)
    assert shown.iterations == one_machine(x, u, src.FUZZINESS, max_iter=1000)[1] and shown.objective_falls
