"""One query per operator. Arrays are shown as rows or text, doubles to six places."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import inputs as src
from softseek.functions import text as tx
from softseek.functions import vectors as vx
from softseek.operators import cache, clean, clusters, embed, graph, search
from softseek.plans import answer, evaluate
from softseek.session import materialize, scratch_path
from softseek.sources import docs, index, models, posts
from softseek.streaming import cache_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ------------------------------------------------------------------------------- A. sources and sinks


@query
def read_posts(spark, sf):
    root = scratch_path(spark, "posts")
    src.write_posts(src.raw_posts(spark, sf), root)
    return posts.read_posts(spark, root).select(
        "category", F.col("doc_id").rlike("^part-.*[.]txt$").alias("is_file_name"), F.md5("raw").alias("digest"), F.length("raw").alias("chars")
    )


def _doc_columns(df):
    return df.select(
        "doc_id", "category", joined("all_newsgroups").alias("all_newsgroups"), "is_cross_post", "subject", "text", "word_count"
    )


@query
def docs_round_trip(spark, sf):
    path = scratch_path(spark, "docs")
    docs.write_docs(clean.preprocess(src.raw_posts(spark, sf)), path)
    return _doc_columns(docs.read_docs(spark, path))


@query
def index_round_trip(spark, sf):
    path = scratch_path(spark, "index")
    index.write_index(src.clustered(spark, sf), path, by_cluster=True)
    scan = index.scan_index(spark, path, ["point_id", "category", "dominant_cluster", "embedding"])
    return scan.select("point_id", "category", "dominant_cluster", r6(F.array_max("embedding").cast("double")).alias("largest"))


@query
def upsert_index(spark, sf):
    base = src.embeddings(spark, sf).select("point_id", "category")
    delta = src.table(spark, sf, "events").selectExpr(
        f"event_id % {2 * base.count()} as point_id", "event_type as category", "event_id as version"
    )
    return index.upsert_index(base, delta, "version")


@query
def merge_index(spark, sf):
    """The stored index after a merge: new rows lie in three clusters, replaced ones anywhere."""
    path = scratch_path(spark, "index")
    base = src.clustered(spark, sf).select("point_id", "category", "embedding", "dominant_cluster")
    index.write_index(base, path, by_cluster=True)
    delta = src.table(spark, sf, "events").selectExpr(
        f"event_id % {2 * base.count()} as point_id", "event_type as category", "array(0f, 1f) as embedding",
        "cast(event_id % 3 as int) as dominant_cluster", "event_id as version",
    )
    index.merge_index(spark, path, delta, "version")
    return index.scan_index(spark, path, ["point_id", "category", "dominant_cluster"])


@query
def index_info(spark, sf):
    return index.index_info(src.embeddings(spark, sf), src.table(spark, sf, "documents"))


@query
def cluster_model_round_trip(spark, sf):
    path = scratch_path(spark, "model")
    models.save_cluster_model(spark, models.ClusterModel(None, src.centers(spark, sf), src.FUZZINESS), path)
    model = models.load_cluster_model(spark, path)
    centers = clusters.centers_frame(spark, model.centers)
    return centers.select("cluster_id", F.posexplode("center").alias("dim", "value")).select("cluster_id", "dim", r6("value").alias("value"))


@query
def assignments_round_trip(spark, sf):
    path = scratch_path(spark, "assignments")
    df = src.weighted(spark, sf).withColumn("doc_id", F.col("point_id").cast("string"))
    models.write_assignments(df, path)
    return _assignment_columns(models.read_assignments(spark, path))


# ------------------------------------------------------------------------------------- B. cleaning


def _posts(spark, sf):
    return clean.split_post(src.raw_posts(spark, sf))


@query
def split_post(spark, sf):
    return _posts(spark, sf).select("doc_id", "header", "body")


@query
def parse_headers(spark, sf):
    parsed = clean.parse_headers(_posts(spark, sf))
    return parsed.select("doc_id", F.explode("headers").alias("name", "value"))


@query
def clean_subject(spark, sf):
    headers = clean.parse_headers(_posts(spark, sf))
    return headers.select("doc_id", tx.clean_subject(F.try_element_at("headers", F.lit("subject"))).alias("subject"))


@query
def parse_groups(spark, sf):
    fields = _posts(spark, sf).withColumn("f", tx.header_fields(F.col("header"), ("newsgroups",)))
    groups = fields.withColumn("g", tx.parse_groups(F.col("f.newsgroups")))
    return groups.select("doc_id", joined("g").alias("all_newsgroups"), (F.size("g") > 1).alias("is_cross_post"))


@query
def quote_ratio(spark, sf):
    return _posts(spark, sf).select("doc_id", r6(tx.quote_ratio(F.col("body"))).alias("quote_ratio"))


def _body_step(name: str, step: Callable[[Column], Column]) -> None:
    def run(spark, sf):
        return _posts(spark, sf).select("doc_id", step(F.col("body")).alias("clean"))

    QUERIES[name] = run


for _step in (
    tx.strip_pgp, tx.cut_signature, tx.strip_reply_intro, tx.strip_attribution,
    tx.strip_quotes, tx.strip_emails, tx.strip_dividers, tx.collapse_blank,
):
    _body_step(_step.__name__, _step)


@query
def clean_body(spark, sf):
    return clean.clean_body(_posts(spark, sf)).select("doc_id", "clean")


@query
def compose_text(spark, sf):
    df = src.table(spark, sf, "documents")
    subject = F.when(F.col("doc_id") % 9 != 4, F.concat("lang", F.lit(" note")))
    return df.select("doc_id", tx.compose_text(subject, F.col("text")).alias("full_text"))


@query
def word_count(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("word_count"))


@query
def classify_docs(spark, sf):
    return clean.classify_docs(src.raw_posts(spark, sf)).select(
        "doc_id", r6("quote_ratio").alias("quote_ratio"), F.coalesce("drop_reason", F.lit("kept")).alias("outcome")
    )


@query
def preprocess(spark, sf):
    return _doc_columns(clean.preprocess(src.raw_posts(spark, sf)))


@query
def cleaning_report(spark, sf):
    return clean.cleaning_report(clean.classify_docs(src.raw_posts(spark, sf)))


# ------------------------------------------------------------------------------------ C. embedding


@query
def truncate_text(spark, sf):
    df = src.table(spark, sf, "documents").withColumn("cut", tx.truncate_text(F.col("text")))
    return df.select("doc_id", F.length("cut").alias("chars"), F.md5("cut").alias("digest"))


def _hash_network():
    """A stand-in for a network: word counts hashed to 64 numbers."""
    from hashlib import md5

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), 64))
        for i, t in enumerate(texts):
            for word in str(t).split():
                out[i, int(md5(word.encode()).hexdigest()[:8], 16) % 64] += 1.0
        return out

    return predict


def _vector_shape(df, key):
    return df.select(key, F.size("embedding").alias("dimensions"), F.round(vx.norm(F.col("embedding")), 3).alias("length"))


@query
def embed_texts(spark, sf):
    df = src.table(spark, sf, "documents")
    return _vector_shape(embed.embed_texts(df, embed.fit_text_model(df)), "doc_id")


@query
def embed_texts_network(spark, sf):
    df = embed.embed_texts(src.table(spark, sf, "documents"), _hash_network)
    values = df.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return values.select("doc_id", "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("point_id") % 5))
    unit = src.embeddings(spark, sf).withColumn("unit", vx.l2_normalize(scaled))
    return unit.select("point_id", F.posexplode("unit").alias("dim", "v")).select("point_id", "dim", r6("v").alias("value"))


@query
def assign_point_ids(spark, sf):
    return embed.assign_point_ids(src.raw_posts(spark, sf).select("category", "doc_id")).select("point_id", "category", "doc_id")


@query
def build_index(spark, sf):
    kept = materialize(clean.preprocess(src.raw_posts(spark, sf)), "docs")
    built = embed.build_index(kept, embed.fit_text_model(kept))
    return built.select(
        "point_id", "doc_id", "category", "word_count", F.size("embedding").alias("dimensions"),
        F.round(vx.norm(F.col("embedding")), 3).alias("length"),
    )


# --------------------------------------------------------------------------------- D. vector search


@query
def dot(spark, sf):
    a = src.embeddings(spark, sf)
    b = a.select((F.col("point_id") - 1).alias("point_id"), F.col("embedding").alias("other"))
    return a.join(b, "point_id").select(
        "point_id", r6(vx.dot(F.col("embedding"), F.col("other"))).alias("dot"), r6(vx.cosine(F.col("embedding"), F.col("other"))).alias("cosine")
    )


def _shown(hits):
    return hits.select("query_id", "rank", "point_id", "category", r6("score").alias("score"))


@query
def topk_search(spark, sf):
    points = src.embeddings(spark, sf)
    return _shown(search.topk_search(src.as_queries(points), points, 5))


@query
def topk_search_per_query_k(spark, sf):
    queries = src.as_queries(src.embeddings(spark, sf)).withColumn("top_k", (F.col("query_id") % 8).cast("int"))
    return _shown(search.topk_search(queries, src.doc_index(spark, sf)))


@query
def format_results(spark, sf):
    queries = src.as_queries(src.embeddings(spark, sf)).withColumn("top_k", (F.col("query_id") % 4).cast("int"))
    return search.format_results(queries, search.topk_search(queries, src.doc_vectors(spark, sf), payload=src.doc_payload(spark, sf)))


@query
def neighbors(spark, sf):
    points = src.embeddings(spark, sf)
    return _shown(search.neighbors(points, points, 3))


@query
def pruned_search(spark, sf):
    points = materialize(src.clustered(spark, sf), "index")
    return _shown(search.pruned_search(src.as_queries(points), points, 5))


@query
def knn_graph(spark, sf):
    graph = search.knn_graph(src.embeddings(spark, sf), 15)
    return graph.select("point_id", "neighbor_id", "rank", r6("distance").alias("distance"))


@query
def knn_graph_cells(spark, sf):
    """Recall of the graph from cells of half the table, against all pairs. The test vectors have no near
    neighbours to speak of, so most pairs have to meet: two divisions, and cells that overlap widely."""
    vectors = src.embeddings(spark, sf)
    made = graph.knn_graph_cells(vectors, 15, cell_rows=vectors.count() // 2, split=8, overlap=4, tables=2)
    exact = search.knn_graph(vectors, 15).select("point_id", "neighbor_id", F.col("distance").alias("exact"))
    both = made.join(exact, ["point_id", "neighbor_id"], "left")
    recall = F.count("exact") / F.count("*")
    return both.agg(
        F.count_distinct("point_id").alias("points"), F.count("*").alias("edges"), F.max("rank").cast("int").alias("degree"),
        F.count_if(F.col("distance") != F.col("exact")).alias("other_distances"),
        F.when(recall >= 0.9, "at least 0.9").otherwise("below 0.9").alias("recall"),
    )


# ------------------------------------------------------------------------------- E. soft clustering


def _assignment_columns(df):
    return df.select(
        "doc_id", "category", "dominant_cluster", r6("max_membership").alias("max_membership"),
        joined(F.transform("memberships", lambda u: F.call_function("format_number", u, F.lit("0.0000")))).alias("memberships"),
    )


@query
def reduce_dims(spark, sf):
    points = src.embeddings(spark, sf)
    reduced = clusters.reduce_dims(points, clusters.fit_reducer(points, 50))
    return reduced.select("point_id", F.size("reduced").alias("dimensions"))


@query
def reduce_dims_full_rank(spark, sf):
    """A projection to all dimensions is a rotation: lengths stay."""
    points = src.embeddings(spark, sf)
    width = points.select(F.size("embedding")).head()[0]
    reduced = clusters.reduce_dims(points, clusters.fit_reducer(points, width))
    return reduced.select("point_id", F.size("reduced").alias("dimensions"), r6(vx.norm(F.col("reduced"))).alias("length"))


@query
def fcm_memberships(spark, sf):
    df = src.weighted(spark, sf).select("point_id", F.posexplode("memberships").alias("cluster_id", "u"))
    return df.select("point_id", "cluster_id", r6("u").alias("membership"))


def _center_values(spark, model):
    centers = clusters.centers_frame(spark, model.centers)
    return centers.select("cluster_id", F.posexplode("center").alias("dim", "v")).select("cluster_id", "dim", r6("v").alias("value"))


@query
def fcm_fit(spark, sf):
    """Three steps, for its SQL; ``fcm_fit_converged`` is the whole fit."""
    model = clusters.fcm_fit(
        src.embeddings(spark, sf), m=src.FUZZINESS, error=0.0, max_iter=3, initial_centers=src.centers(spark, sf)
    )
    return _center_values(spark, model)


@query
def fcm_fit_converged(spark, sf):
    """The fit to its own stopping rule."""
    model = clusters.fcm_fit(src.embeddings(spark, sf), m=src.FUZZINESS, initial_centers=src.centers(spark, sf))
    return _center_values(spark, model)


@query
def fcm_fit_seeded(spark, sf):
    model = clusters.fcm_fit(src.embeddings(spark, sf), 10, m=src.FUZZINESS)
    rows = [(model.k, model.iterations, bool(np.all(np.diff(model.objective) <= 1e-9)))]
    return spark.createDataFrame(rows, "k int, iterations int, objective_falls boolean")


@query
def fuzzy_partition_coefficient(spark, sf):
    return clusters.fuzzy_partition_coefficient(src.weighted(spark, sf)).select(r6("fpc").alias("fpc"))


@query
def top_clusters(spark, sf):
    return src.clustered(spark, sf).select("point_id", joined("top_clusters").alias("top_clusters"))


@query
def dominant_cluster(spark, sf):
    df = src.weighted(spark, sf)
    u = F.col("memberships")
    return df.select("point_id", vx.dominant_cluster(u).alias("dominant_cluster"), r6(vx.max_membership(u)).alias("max_membership"))


@query
def silhouette(spark, sf):
    score = clusters.silhouette(src.embeddings(spark, sf), "label")
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


@query
def sweep_k(spark, sf):
    return clusters.sweep_k(src.embeddings(spark, sf), m=src.FUZZINESS)


@query
def membership_entropy(spark, sf):
    u = F.col("memberships")
    return src.weighted(spark, sf).select(
        "point_id", r6(vx.membership_entropy(u)).alias("entropy"), vx.is_boundary(u).alias("is_boundary")
    )


@query
def cluster_profile(spark, sf):
    df = clusters.cluster_profile(src.weighted(spark, sf))
    return df.withColumn("avg_confidence", r6("avg_confidence"))


@query
def top_categories(spark, sf):
    return clusters.top_categories(src.weighted(spark, sf)).withColumn("percent", r6("percent"))


@query
def boundary_summary(spark, sf):
    return clusters.boundary_summary(src.weighted(spark, sf)).withColumn("percent", r6("percent"))


@query
def assignments(spark, sf):
    df = src.weighted(spark, sf).withColumn("doc_id", F.col("point_id").cast("string"))
    return _assignment_columns(clusters.assignments(df))


# -------------------------------------------------------------------------------- F. semantic cache


def _entries(spark, sf):
    """All vectors stored as cache entries."""
    return src.vector_log(spark, sf).select("seq", "query", "embedding", F.col("dominant_cluster").alias("cluster_id"))


@query
def cache_lookup(spark, sf):
    queries = src.pair_inputs(spark, sf)[1].withColumnRenamed("query_id", "seq")
    entries = materialize(_entries(spark, sf).withColumn("result", F.concat(F.lit("answer to "), "query")), "entries")
    found = cache.cache_lookup(queries, entries.withColumn("embedding", F.col("embedding").cast("array<double>")), 0.8)
    return found.select("seq", "cache_hit", "matched_seq", "matched_query", "result", r6("score").alias("score"))


@query
def cache_store(spark, sf):
    log = src.vector_log(spark, sf)
    return cache.cache_store(_entries(spark, sf), log.withColumn("seq", F.col("seq") + 1_000_000)).select("seq", "query", "cluster_id")


def _decided(df):
    return df.select("seq", "cache_hit", "matched_seq", r6("similarity").alias("similarity"), "dominant_cluster")


def _replayed(spark, sf):
    return cache.cache_replay(src.vector_log(spark, sf), src.LOG_THETA)


@query
def cache_replay(spark, sf):
    return _decided(_replayed(spark, sf))


@query
def cache_replay_events(spark, sf):
    decided = cache.replay_log(src.event_log(spark, sf))
    return cache.with_matched_query(decided).select(
        "seq", "epoch", "theta", "cache_hit", "matched_seq", "matched_query", r6("similarity").alias("similarity")
    )


@query
def cache_replay_stream(spark, sf):
    """The event log as a stream of files, in order, one file per micro-batch."""
    folder = scratch_path(spark, "stream")
    stream = _in_order(spark, src.event_log(spark, sf).drop("latency"), folder)
    cache_stream.cache_replay_stream(stream, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return cache_stream.read_decisions(spark, f"{folder}/store").select(
        "seq", "epoch", "cache_hit", "matched_seq", r6("similarity").alias("similarity")
    )


#: Rows of a log up to which one task writes each micro-batch.
FILE_ROWS = 1_000_000


def _in_order(spark, log, folder):
    """A log as a stream of files, in order; every micro-batch has the same number of files, one for a short log."""
    log = materialize(log, "log")
    files = max(1, -(-log.count() // FILE_ROWS))
    cuts = [-1.0, *log.approxQuantile("seq", [0.2, 0.5, 0.7], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        part = log.where((F.col("seq") > low) & (F.col("seq") <= high))
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(f"{folder}/log")
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/log")


@query
def answer_stream(spark, sf):
    """The turns as a stream: the answers of ``answer_queries``."""
    folder = scratch_path(spark, "stream")
    log = src.turn_log(spark, sf).selectExpr("*", "false as is_flush", "cast(null as double) as set_theta")
    model = models.ClusterModel(None, src.centers(spark, sf), src.FUZZINESS)
    stream = _in_order(spark, log, folder)
    cache_stream.answer_stream(
        stream, f"{folder}/store", f"{folder}/checkpoint", src.doc_vectors(spark, sf), model, src.LOG_THETA, payload=src.doc_payload(spark, sf)
    ).awaitTermination()
    return cache_stream.read_answers(spark, f"{folder}/store").withColumn("similarity_score", r6("similarity_score"))


@query
def cache_stats(spark, sf):
    return cache.cache_stats(_replayed(spark, sf), src.LOG_THETA)


@query
def epoch_stats(spark, sf):
    return cache.epoch_stats(cache.replay_log(src.event_log(spark, sf)))


@query
def flush_report(spark, sf):
    log = src.event_log(spark, sf)
    return cache.flush_report(log, cache.replay_log(log))


@query
def threshold_as_of(spark, sf):
    return cache.control_state(src.event_log(spark, sf).select("seq", "is_flush", "set_theta")).select("seq", "epoch", "theta")


@query
def cluster_distribution(spark, sf):
    return cache.cluster_distribution(cache.entries_of(_replayed(spark, sf)))


@query
def entry_hits(spark, sf):
    return cache.entry_hits(_replayed(spark, sf))


@query
def cluster_entries(spark, sf):
    return cache.cluster_entries(_entries(spark, sf), 3).select("seq", "query", "cluster_id")


@query
def scan_cost(spark, sf):
    return cache.scan_cost(src.vector_log(spark, sf), _entries(spark, sf)).withColumn("speedup", r6("speedup"))


# ----------------------------------------------------------------------------------- G. query jobs


@query
def validate_queries(spark, sf):
    return answer.validate_queries(src.turn_log(spark, sf)).select("seq", "query", "top_k", "reject_reason")


@query
def answer_queries(spark, sf):
    model = models.ClusterModel(None, src.centers(spark, sf), src.FUZZINESS)
    answers = answer.answer_queries(src.turn_log(spark, sf), src.doc_vectors(spark, sf), model, src.LOG_THETA, payload=src.doc_payload(spark, sf))
    return answers.withColumn("similarity_score", r6("similarity_score"))


@query
def service_summary(spark, sf):
    return answer.service_summary(_entries(spark, sf))


# ------------------------------------------------------------------------------------ H. evaluation


def _ranks(spark, sf):
    """Every vector searches for its own label; the found documents' sources serve as categories."""
    queries = src.as_queries(src.embeddings(spark, sf)).withColumn(
        "expected_category", F.concat(F.lit("src"), F.col("label") % 5)
    )
    return evaluate.first_relevant_rank(queries, src.doc_index(spark, sf))


@query
def first_relevant_rank(spark, sf):
    return _ranks(spark, sf)


@query
def hit_at_k(spark, sf):
    df = evaluate.hit_at_k(_ranks(spark, sf))
    return df.select("n_queries", *[r6(f"hit_at_{k}").alias(f"hit_at_{k}") for k in (1, 3, 5)])


@query
def mean_reciprocal_rank(spark, sf):
    return evaluate.mean_reciprocal_rank(_ranks(spark, sf)).select(r6("mrr").alias("mrr"))


def _features(spark, sf):
    return evaluate.pair_features(*src.pair_inputs(spark, sf))


@query
def pair_outcomes(spark, sf):
    return evaluate.pair_outcomes(_features(spark, sf)).withColumn("raw_sim", r6("raw_sim"))


@query
def pair_rates(spark, sf):
    return evaluate.pair_rates(evaluate.pair_outcomes(_features(spark, sf))).withColumn("hit_rate", r6("hit_rate"))


def _sweep_columns(df):
    return df.select("threshold", *[r6(c).alias(c) for c in ("true_positive_rate", "false_positive_rate", "precision", "f1")])


@query
def threshold_sweep(spark, sf):
    return _sweep_columns(evaluate.threshold_sweep(_features(spark, sf)))


@query
def best_threshold(spark, sf):
    return _sweep_columns(evaluate.best_threshold(evaluate.threshold_sweep(_features(spark, sf))))


def _latencies(spark, sf):
    return src.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("latency"))


@query
def latency_by_stage(spark, sf):
    """Events as measurements of the stage that their type names."""
    log = src.table(spark, sf, "events").selectExpr("event_id as seq", "value as latency", "event_type as step")
    df = evaluate.latency_summary(log, stage="step")
    return df.select("stage", "measured", r6("avg_latency").alias("avg_latency"), r6("p95_latency").alias("p95_latency"))


@query
def latency_summary(spark, sf):
    df = evaluate.latency_summary(_latencies(spark, sf))
    return df.select("measured", r6("avg_latency").alias("avg_latency"), r6("p95_latency").alias("p95_latency"))


@query
def evaluation_report(spark, sf):
    report = evaluate.evaluation_report(_ranks(spark, sf), _features(spark, sf), _latencies(spark, sf))
    return report.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes])
