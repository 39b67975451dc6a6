"""Evaluation jobs: search quality, cache pairs, threshold sweep, latency."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softseek.functions.vectors import dot
from softseek.operators.joins import lookup_join
from softseek.operators.search import topk_search
from softseek.session import materialize

# The thresholds the sweep compares.
THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def first_relevant_rank(queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """Per labelled query the best rank whose category contains, or is contained in, the expected one.

    ``queries(query_id, embedding, expected_category)``; a hit without a category matches anything.
    """
    hits = topk_search(queries.select("query_id", "embedding"), index.select("point_id", "embedding", "category"), k)
    labelled = queries.select("query_id", "expected_category")
    category = F.coalesce("category", F.lit(""))
    related = category.contains(F.col("expected_category")) | F.col("expected_category").contains(category)
    ranks = hits.join(labelled, "query_id").where(related).groupBy("query_id").agg(F.min("rank").alias("found_at"))
    return labelled.join(ranks, "query_id", "left")


def hit_at_k(ranks: DataFrame, ks: Iterable[int] = (1, 3, 5)) -> DataFrame:
    """Share of queries with a relevant hit among the first k, for each k."""
    share = [F.avg(F.coalesce(F.col("found_at") <= k, F.lit(False)).cast("double")).alias(f"hit_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n_queries"), *share)


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(F.coalesce(F.lit(1.0) / F.col("found_at"), F.lit(0.0))).alias("mrr"))


def pair_features(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Per pair what a fresh cache holding the first query says about the second.

    ``pairs(pair_id, kind, q1, q2)``, ``queries(query_id, embedding, top_clusters, dominant_cluster)``.
    """
    first = queries.select(
        F.col("query_id").alias("q1"), F.col("embedding").alias("_v1"), F.col("dominant_cluster").alias("stored_cluster")
    )
    second = queries.select(F.col("query_id").alias("q2"), F.col("embedding").alias("_v2"), F.col("top_clusters").alias("_t2"))
    # One query can be in very many pairs.
    both = lookup_join(lookup_join(pairs, first, "q1", spread_by=("pair_id",)), second, "q2", spread_by=("pair_id",))
    return both.select(
        "pair_id", "kind", dot(F.col("_v1"), F.col("_v2")).alias("raw_sim"),
        F.array_contains("_t2", F.col("stored_cluster")).alias("routed"),
    )


def pair_outcomes(features: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Adds ``hit``, and ``routing_miss``: similar enough but stored in a cluster that is not searched."""
    similar = F.col("raw_sim") >= threshold
    return features.withColumns({"hit": similar & F.col("routed"), "routing_miss": similar & ~F.col("routed")})


def pair_rates(outcomes: DataFrame) -> DataFrame:
    """Per kind of pair: hit rate (for unrelated pairs the false-positive rate) and routing misses."""
    return outcomes.groupBy("kind").agg(
        F.count("*").alias("pairs"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.count_if("routing_miss").alias("routing_misses"),
    )


def threshold_sweep(features: DataFrame, thresholds: Iterable[float] = THRESHOLDS) -> DataFrame:
    """True and false positive rate, precision and F1 per threshold, in one pass over the pairs."""
    thetas = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    tried = features.withColumn("threshold", thetas)
    hit = ((F.col("raw_sim") >= F.col("threshold")) & F.col("routed")).cast("double")

    def rate(kind: str):
        return F.coalesce(F.avg(F.when(F.col("kind") == kind, hit)), F.lit(0.0))

    tpr, fpr, precision = (F.col(c) for c in ("true_positive_rate", "false_positive_rate", "precision"))
    rates = tried.groupBy("threshold").agg(
        rate("paraphrase").alias("true_positive_rate"), rate("unrelated").alias("false_positive_rate")
    )
    rates = rates.withColumn("precision", F.coalesce(F.try_divide(tpr, tpr + fpr), F.lit(1.0)))
    return rates.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * precision * tpr, precision + tpr), F.lit(0.0)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


#: Rank error of the sketch that brackets the percentile, as a share of the rows.
SKETCH_ACCURACY = 100_000


def latency_summary(log: DataFrame, warmup: int = 3, order: str = "seq", latency: str = "latency", stage: str | None = None) -> DataFrame:
    """Mean and 95th percentile (linear interpolation) after the first ``warmup`` positions; nulls are not measured.

    ``stage``: a column by which to summarise, one row each (embedding, lookup, search). The percentile is
    exact without sorting the log: a quantile sketch, whose rank error is known, brackets it; values below
    the bracket are counted, and only the distinct values inside are put in order. A bracket that does not
    hold the percentile after all is replaced by all values.
    """
    name = F.lit("") if stage is None else F.col(stage)
    rows = log.select(F.col(order).alias("_order"), F.col(latency).cast("double").alias("_x"), name.alias("_stage"))
    if warmup > 0:
        last = rows.select("_order").distinct().orderBy("_order").limit(warmup).agg(F.max("_order")).first()[0]
        rows = rows.where(F.col("_order") > F.lit(last))
    rows = rows.where("_x is not null").select("_stage", "_x")
    margin = 3 / SKETCH_ACCURACY
    edges = F.percentile_approx("_x", F.array(F.lit(max(0.0, 0.95 - margin)), F.lit(min(1.0, 0.95 + margin))), F.lit(SKETCH_ACCURACY))
    measures = [F.count("*").alias("n"), F.avg("_x").alias("avg_latency"), edges.alias("_edges")]
    totals = rows.agg(*measures).withColumn("_stage", F.lit("")) if stage is None else rows.groupBy("_stage").agg(*measures)
    spot = F.lit(0.95) * (F.col("n") - 1)
    totals = materialize(totals.withColumns({"_low": F.floor(spot), "_high": F.ceil(spot), "_share": spot - F.floor(spot)}), "totals")

    def beside(table: DataFrame) -> DataFrame:
        return rows.join(table.withColumnRenamed("_stage", "_s"), F.col("_stage").eqNullSafe(F.col("_s"))).drop("_s")

    below, inside = F.col("_x") < F.col("_edges")[0], (F.col("_x") >= F.col("_edges")[0]) & (F.col("_x") <= F.col("_edges")[1])
    counted = beside(totals.select("_stage", "_edges")).groupBy("_stage").agg(F.count_if(below).alias("_below"), F.count_if(inside).alias("_inside"))
    counted = counted.withColumnRenamed("_stage", "_s")
    held = (F.col("_below") <= F.col("_low")) & (F.col("_below") + F.col("_inside") > F.col("_high"))
    bracket = totals.join(counted, F.col("_stage").eqNullSafe(F.col("_s")), "left").drop("_s")
    bracket = bracket.withColumns({"_held": held, "_below": F.when(held, F.col("_below")).otherwise(0)})
    bracket = materialize(bracket, "bracket")
    near = beside(bracket.select("_stage", "_edges", "_held", "_below", "_low", "_high")).where(~F.col("_held") | inside)
    values = near.groupBy("_stage", "_x", "_below", "_low", "_high").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("_stage").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = values.withColumn("_upto", F.col("_below") + F.sum("_n").over(running))
    ends = upto.groupBy("_stage").agg(
        F.min(F.when(F.col("_upto") > F.col("_low"), F.col("_x"))).alias("_a"), F.min(F.when(F.col("_upto") > F.col("_high"), F.col("_x"))).alias("_b")
    )
    found = bracket.join(ends.withColumnRenamed("_stage", "_s"), F.col("_stage").eqNullSafe(F.col("_s")), "left")
    return found.select(
        *([F.col("_stage").alias("stage")] if stage is not None else []),
        F.col("n").alias("measured"), "avg_latency", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("p95_latency"),
    )


def evaluation_report(
    ranks: DataFrame, features: DataFrame, log: DataFrame, threshold: float = 0.80, warmup: int = 3
) -> DataFrame:
    """One row with the headline numbers of every section."""
    rates = pair_rates(pair_outcomes(features, threshold))

    def of(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    cache = rates.agg(
        of("paraphrase", "hit_rate").alias("paraphrase_hit_rate"),
        of("paraphrase", "routing_misses").alias("cluster_misses"),
        of("unrelated", "hit_rate").alias("false_positive_rate"),
    )
    best = best_threshold(threshold_sweep(features)).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    parts = [hit_at_k(ranks), mean_reciprocal_rank(ranks), cache, best, latency_summary(log, warmup)]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
