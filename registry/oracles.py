"""DuckDB SQL for the registered queries, built from shared common table expressions.

RE2, DuckDB's engine, has ASCII classes only and no lookaround, so the wide classes are spelled out and
the word edges around addresses become ``\\b``.
"""

from __future__ import annotations

from registry.inputs import FUZZINESS, LOG_THETA, RAW_POST

S = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
S_IN = S[1:-1]
NOT_S = f"[^{S_IN}]"
W_IN = r"\p{L}\p{M}\p{N}_"
LINE_S = r"[ \t\f\r\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sub(text: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {to}, 'g')"


def strip(text: str) -> str:
    return sub(text, rf"\A{S}+|{S}+\z")


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def cut_signature(text: str) -> str:
    return f"regexp_replace({text}, '(?s)\\n--{S}*?\\n.*\\z', '')"


STEPS = {
    "strip_pgp": lambda c: sub(c, r"(?s)-----BEGIN PGP.*?-----END PGP[^-]*-----"),
    "cut_signature": lambda c: cut_signature(c),
    "strip_reply_intro": lambda c: sub(c, rf"(?im)^In{S}+article{S}+[^\n]*?(?:writes?|wrote){S}*:[^\n]*$"),
    "strip_attribution": lambda c: sub(c, rf"(?im)^[{W_IN}{S_IN},.<>@\-()]+(?:wrote|writes){S}*:{S}*$"),
    "strip_quotes": lambda c: sub(c, rf"(?m)^{S}*>+[^\n]*$"),
    "strip_emails": lambda c: sub(c, rf"[{W_IN}][{W_IN}.+\-]*@[{W_IN}\-]+(?:\.[a-zA-Z]{{2,}})+\b"),
    "strip_dividers": lambda c: sub(c, rf"(?m)^[{S_IN}\-=*#~+_|]{{5,}}$"),
    "collapse_blank": lambda c: strip(sub(c, r"\n{3,}", "chr(10) || chr(10)")),
}

# ------------------------------------------------------------------------------ cleaning inputs

RAW = f"raw AS (SELECT source AS category, doc_id::VARCHAR AS doc_id, {RAW_POST} AS raw FROM documents)"
SPLIT = f"""{RAW},
post AS (SELECT category, doc_id, raw,
  CASE WHEN strpos(raw, chr(10) || chr(10)) > 0 THEN substr(raw, 1, strpos(raw, chr(10) || chr(10)) - 1) ELSE raw END AS header,
  CASE WHEN strpos(raw, chr(10) || chr(10)) > 0 THEN substr(raw, strpos(raw, chr(10) || chr(10)) + 2) ELSE '' END AS body
  FROM raw),
lines AS (SELECT doc_id, unnest(string_split(header, chr(10))) AS line FROM post),
header AS (SELECT doc_id, lower({strip("substr(line, 1, strpos(line, ':') - 1)")}) AS name,
  {strip("substr(line, strpos(line, ':') + 1)")} AS value FROM lines WHERE strpos(line, ':') > 0)"""

RATIO = (
    f"CASE WHEN {count('body', f'(?m)^{LINE_S}*{NOT_S}')} = 0 THEN 1.0::DOUBLE ELSE "
    f"{count('body', f'(?m)^{LINE_S}*>')}::DOUBLE / {count('body', f'(?m)^{LINE_S}*{NOT_S}')} END"
)
SUBJECT = "nullif({}, '')".format(
    sub(strip(sub("value", rf"(?i)\A{S}*(?:Re|Fwd|AW){S}*:{S}*")), r"\A[<>\"']+|[<>\"']+\z")
)
GROUPS = f"list_filter(list_transform(string_split(value, ','), lambda g: {strip('g')}), lambda g: g <> '')"


def body_chain() -> str:
    """One CTE per cleaning step."""
    out, prev = [], "SELECT doc_id, body AS c0 FROM post"
    for i, step in enumerate(STEPS.values(), 1):
        out.append(f"b{i} AS (SELECT doc_id, {step(f'c{i - 1}')} AS c{i} FROM ({prev}))")
        prev = f"SELECT * FROM b{i}"
    return ",\n".join(out) + f",\nbody_clean AS (SELECT doc_id, c{len(STEPS)} AS clean FROM b{len(STEPS)})"


CLEAN = f"""{SPLIT},
{body_chain()},
cleaned AS (SELECT post.category, post.doc_id, s.subject, g.groups, {RATIO} AS quote_ratio,
    CASE WHEN s.subject IS NULL THEN clean ELSE {strip("s.subject || chr(10) || chr(10) || clean")} END AS text
  FROM post JOIN body_clean USING (doc_id)
  LEFT JOIN (SELECT doc_id, {SUBJECT} AS subject FROM header WHERE name = 'subject') s USING (doc_id)
  LEFT JOIN (SELECT doc_id, {GROUPS} AS groups FROM header WHERE name = 'newsgroups') g USING (doc_id)),
counted AS (SELECT *, {count("text", f"{NOT_S}+")}::INTEGER AS word_count FROM cleaned),
classified AS (SELECT *, CASE WHEN quote_ratio > 0.70 THEN 'quoted' WHEN word_count < 20 THEN 'short' END AS drop_reason FROM counted)"""
DOC_ROWS = """SELECT doc_id, category, array_to_string(groups, ',') AS all_newsgroups, len(groups) > 1 AS is_cross_post,
  subject, text, word_count FROM classified WHERE drop_reason IS NULL"""

# ----------------------------------------------------------------------------- vectors and clusters

EMB = """emb AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS v, 'label_' || label AS category, label FROM embeddings)"""
CENTERS = """center_rows AS (SELECT label AS cluster_id, pos - 1 AS dim, avg(x) AS value
  FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) GROUP BY 1, 2),
centers AS (SELECT cluster_id, list(value ORDER BY dim) AS c FROM center_rows GROUP BY 1)"""


def weights(name: str, points: str, centers: str = "centers") -> str:
    """Membership rows (point_id, cluster_id, u) of a relation (point_id, v)."""
    return f"""{name}_d AS (SELECT p.point_id, k.cluster_id, list_distance(p.v, k.c) AS d FROM {points} p, {centers} k),
{name} AS (SELECT a.point_id, a.cluster_id, 1.0 / sum(pow(a.d / b.d, {2 / (FUZZINESS - 1)})) AS u
  FROM {name}_d a JOIN {name}_d b USING (point_id) GROUP BY 1, 2)"""


def features(name: str, w: str) -> str:
    """Per point the searched clusters and the dominant one."""
    return f"""{name} AS (SELECT point_id, list(cluster_id ORDER BY u DESC, cluster_id DESC)[1:2] AS top2,
  arg_min(cluster_id, (-u, cluster_id))::INTEGER AS dom, max(u) AS top_u FROM {w} GROUP BY 1)"""


CLUSTERED = f"{EMB},\n{CENTERS},\n{weights('w', 'emb')},\n{features('f', 'w')}"
ENTROPY = "-sum(u * ln(u + 1e-10))"
K = "(SELECT count(*) FROM centers)"
SPREAD = f"spread AS (SELECT point_id, {ENTROPY} AS entropy, {ENTROPY} > 0.7 * ln({K}::DOUBLE) AS boundary FROM w GROUP BY 1)"

DOC_INDEX_ONLY = """doc_index AS (SELECT doc_id AS point_id, source AS category, CASE WHEN doc_id % 9 = 4 THEN NULL ELSE lang || ' note ' || doc_id END AS subject,
  text, v FROM documents JOIN emb ON doc_id % (SELECT count(*) FROM emb) = emb.point_id)"""
DOC_INDEX = f"{EMB},\n{DOC_INDEX_ONLY}"


def ranked(queries: str, index: str, k: str, extra: str = "TRUE", cols: str = "i.category") -> str:
    """Hits of a relation (query_id, v, ...) in a relation (point_id, v, ...)."""
    return f"""SELECT q.query_id, i.point_id, {cols}, list_dot_product(q.v, i.v) AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.v, i.v) DESC, i.point_id)::INTEGER AS rank
  FROM {queries} q, {index} i WHERE {extra} QUALIFY rank <= {k}"""


SHOWN = "query_id, rank, point_id, category, round(score, 6) AS score"
EMB_Q = "(SELECT point_id AS query_id, * FROM emb)"
BLOCK = f"""'[' || rank || '] category=' || coalesce(category, 'unknown') || ' | score=' || printf('%.4f', score)
  || chr(10) || '    subject: ' || coalesce(subject, '') || chr(10) || '    excerpt: '
  || {strip("replace(substr(text, 1, 300), chr(10), ' ')")} || CASE WHEN length(text) > 300 THEN '...' ELSE '' END"""

# ------------------------------------------------------------------------------------------- cache

VECTOR_LOG = f"""{CLUSTERED},
log AS (SELECT point_id AS seq, 'q' || point_id AS query, {LOG_THETA}::DOUBLE AS theta, 0 AS epoch, point_id AS vec, top2, dom FROM f)"""
EVENT_LOG = f"""{CLUSTERED},
marked AS (SELECT event_id AS seq, 'q' || event_id AS query, (event_id * 37) % (SELECT count(*) FROM emb) AS vec,
  event_id % 1000 = 999 AS is_flush,
  CASE WHEN event_id % 1000 <> 999 AND event_id % 350 = 10 THEN [0.30, 0.55, 0.80][(event_id // 350) % 3 + 1]::DOUBLE END AS set_theta
  FROM events),
state AS (SELECT *, sum(is_flush::INTEGER) OVER (ORDER BY seq) AS epoch_n,
  coalesce(last_value(set_theta IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.80::DOUBLE) AS theta FROM marked),
log AS (SELECT seq, query, theta, epoch_n::BIGINT AS epoch, vec, top2, dom FROM state JOIN f ON vec = point_id
  WHERE NOT is_flush AND set_theta IS NULL)"""

# Every epoch is walked through in order, all epochs side by side; the state is the list of stored rows.
REPLAY = """near AS (SELECT a.point_id AS a, b.point_id AS b, list_dot_product(a.v, b.v) AS s FROM emb a, emb b
  WHERE list_dot_product(a.v, b.v) >= (SELECT min(theta) FROM log)),
edge AS (SELECT i.seq, j.seq AS other, s AS score, list_position(i.top2, j.dom) AS pos
  FROM log i JOIN near ON i.vec = near.a JOIN log j ON j.vec = near.b AND j.epoch = i.epoch AND j.seq < i.seq
  WHERE s >= i.theta AND list_contains(i.top2, j.dom)),
incoming AS (SELECT seq, list(other) AS others FROM edge GROUP BY 1),
walk AS (SELECT seq, epoch, row_number() OVER (PARTITION BY epoch ORDER BY seq) AS n, coalesce(others, []::BIGINT[]) AS others
  FROM log LEFT JOIN incoming USING (seq)),
steps AS (SELECT epoch, 0::BIGINT AS n, []::BIGINT[] AS stored FROM (SELECT DISTINCT epoch FROM log)
  UNION ALL
  SELECT s.epoch, w.n, CASE WHEN list_has_any(w.others, s.stored) THEN s.stored ELSE list_append(s.stored, w.seq) END
  FROM steps s JOIN walk w ON w.epoch = s.epoch AND w.n = s.n + 1),
stored AS (SELECT unnest(arg_max(stored, n)) AS seq FROM steps GROUP BY epoch),
match AS (SELECT edge.seq, other, score FROM edge JOIN stored ON stored.seq = other
  QUALIFY row_number() OVER (PARTITION BY edge.seq ORDER BY score DESC, pos, other) = 1),
decided AS (SELECT log.seq, log.query, log.epoch, log.theta, log.vec, log.dom, other IS NOT NULL AS cache_hit, other AS matched_seq,
  printf('%.4f', score)::DOUBLE AS similarity FROM log LEFT JOIN match USING (seq))"""
COUNTS = "count(*) FILTER (NOT cache_hit) AS total_entries, count(*) FILTER (cache_hit) AS hit_count, count(*) FILTER (NOT cache_hit) AS miss_count"
RATE = "printf('%.4f', count(*) FILTER (cache_hit) / count(*)::DOUBLE)::DOUBLE AS hit_rate"

TURNS = rf"""turns AS (SELECT conv_id * 1000 + turn AS seq,
    {strip("CASE WHEN conv_id % 10 = 0 THEN '  ' || chr(10) ELSE ' ' || text || chr(10) END")} AS query,
    CASE WHEN turn % 4 = 3 THEN 5 ELSE (turn % 5 + 1)::INTEGER END AS top_k FROM conversations)"""

# ------------------------------------------------------------------------------------------- pairs

PAIRS = f"""{EMB},
{CENTERS},
duo AS (SELECT a.point_id, a.v AS a, b.v AS b, 0.3::DOUBLE + 0.1::DOUBLE * (a.point_id % 8) AS s
  FROM emb a JOIN emb b ON b.point_id = a.point_id + 1),
mixed AS (SELECT point_id, list_transform(list_zip(a, b), lambda p: p[1] + s * p[2]) AS m FROM duo),
blends AS (SELECT point_id + 1000000 AS point_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM mixed),
points AS (SELECT point_id, v FROM emb UNION ALL SELECT * FROM blends),
{weights('w', 'points')},
{features('f', 'w')},
pairs AS (SELECT point_id AS pair_id, 'unrelated' AS kind, point_id AS q1, point_id + 1 AS q2 FROM duo
  UNION ALL SELECT point_id + 1000000, 'paraphrase', point_id, point_id + 1000000 FROM duo),
feature AS (SELECT pair_id, kind, list_dot_product(p1.v, p2.v) AS raw_sim, f1.dom AS stored_cluster, list_contains(f2.top2, f1.dom) AS routed
  FROM pairs JOIN points p1 ON p1.point_id = q1 JOIN points p2 ON p2.point_id = q2
  JOIN f f1 ON f1.point_id = q1 JOIN f f2 ON f2.point_id = q2)"""
SWEEP = """rates AS (SELECT threshold, avg((raw_sim >= threshold AND routed)::INTEGER) FILTER (kind = 'paraphrase') AS tpr,
    avg((raw_sim >= threshold AND routed)::INTEGER) FILTER (kind = 'unrelated') AS fpr
  FROM feature, (SELECT unnest([0.70, 0.75, 0.80, 0.85, 0.90, 0.95]::DOUBLE[]) AS threshold) GROUP BY 1),
prec AS (SELECT *, CASE WHEN tpr + fpr > 0 THEN tpr / (tpr + fpr) ELSE 1.0 END AS p FROM rates),
sweep AS (SELECT *, CASE WHEN p + tpr > 0 THEN 2.0 * p * tpr / (p + tpr) ELSE 0.0 END AS f1 FROM prec)"""
SWEEP_COLS = "threshold, round(tpr, 6) AS true_positive_rate, round(fpr, 6) AS false_positive_rate, round(p, 6) AS precision, round(f1, 6) AS f1"
OUTCOME = """outcome AS (SELECT pair_id, kind, raw_sim, stored_cluster, routed, raw_sim >= 0.8 AND routed AS hit,
  raw_sim >= 0.8 AND NOT routed AS routing_miss FROM feature)"""
RANKS = f"""labelled AS (SELECT point_id AS query_id, v, 'src' || (label % 5) AS expected_category FROM emb),
hits AS ({ranked('labelled', 'doc_index', '5', cols='i.category, q.expected_category')}),
ranks AS (SELECT query_id, l.expected_category, min(rank) AS found_at FROM labelled l LEFT JOIN
  (SELECT query_id, rank FROM hits WHERE contains(category, expected_category) OR contains(expected_category, category)) USING (query_id) GROUP BY 1, 2)"""
HIT_COLS = ", ".join(f"avg(coalesce(found_at <= {k}, FALSE)::INTEGER) AS hit_at_{k}" for k in (1, 3, 5))
LATENCY = """latency AS (SELECT value AS x FROM events QUALIFY row_number() OVER (ORDER BY event_id) > 3),
lat AS (SELECT count(*) AS measured, avg(x) AS avg_latency, quantile_cont(x, 0.95) AS p95_latency FROM latency)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def _replay(log: str, select: str) -> str:
    return with_(f"{log},\n{REPLAY}", select, recursive=True)


def _fcm_ctes(n: int) -> list[str]:
    ctes, current = [EMB, CENTERS], "centers"
    for i in range(n):
        ctes.append(weights(f"w{i}", "emb", current))
        ctes.append(
            f"c{i}_rows AS (SELECT cluster_id, dim, sum(pow(u, {FUZZINESS}) * x) / sum(pow(u, {FUZZINESS})) AS value FROM w{i} JOIN "
            f"(SELECT point_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM emb) USING (point_id) GROUP BY 1, 2),\n"
            f"c{i} AS (SELECT cluster_id, list(value ORDER BY dim) AS c FROM c{i}_rows GROUP BY 1)"
        )
        current = f"c{i}"
    return ctes


def fcm_steps(n: int) -> str:
    """Centres after ``n`` iterations from the label means: step 0 gives the first centres."""
    return with_(",\n".join(_fcm_ctes(n)), f"SELECT cluster_id, dim::INTEGER AS dim, round(value, 6) AS value FROM c{n - 1}_rows")


def fcm_converged(n: int, error: float) -> str:
    """Centres of the first iteration whose memberships move by less than ``error``; no rows after ``n`` iterations."""
    ctes = _fcm_ctes(n + 1)
    moves = [
        f"SELECT {i} AS step, sqrt(sum(pow(a.u - b.u, 2))) AS change FROM w{i} a JOIN w{i - 1} b USING (point_id, cluster_id)"
        for i in range(1, n + 1)
    ]
    ctes.append(f"stop AS (SELECT min(step) AS step FROM ({' UNION ALL '.join(moves)}) WHERE change < {error})")
    rows = " UNION ALL ".join(f"SELECT {i} AS step, * FROM c{i - 1}_rows" for i in range(1, n + 1))
    return with_(
        ",\n".join(ctes),
        f"SELECT cluster_id, dim::INTEGER AS dim, round(value, 6) AS value FROM ({rows}) WHERE step = (SELECT step FROM stop)",
    )


ASSIGNED = with_(
    CLUSTERED,
    """SELECT emb.point_id::VARCHAR AS doc_id, category, dom AS dominant_cluster, round(top_u, 6) AS max_membership, m AS memberships
FROM emb JOIN f USING (point_id)
JOIN (SELECT point_id, string_agg(printf('%.4f', u), ',' ORDER BY cluster_id) AS m FROM w GROUP BY 1) USING (point_id)""",
)
DOCS = with_(CLEAN, DOC_ROWS)

ORACLES: dict[str, str] = {
    "read_posts": with_(RAW, "SELECT 'category=' || category AS category, true AS is_file_name, md5(raw || chr(10)) AS digest, (length(raw) + 1)::INTEGER AS chars FROM raw"),
    "docs_round_trip": DOCS,
    "index_round_trip": with_(CLUSTERED, "SELECT point_id, category, dom AS dominant_cluster, round(list_max(v), 6) AS largest FROM emb JOIN f USING (point_id)"),
    "upsert_index": with_(
        f"{EMB}, delta AS (SELECT event_id % (2 * (SELECT count(*) FROM emb)) AS point_id, arg_max(event_type, event_id) AS category FROM events GROUP BY 1)",
        "SELECT point_id, coalesce(delta.category, emb.category) AS category FROM emb FULL JOIN delta USING (point_id)",
    ),
    "merge_index": with_(
        f"{CLUSTERED}, delta AS (SELECT event_id % (2 * (SELECT count(*) FROM emb)) AS point_id, arg_max(event_type, event_id) AS category,"
        " (max(event_id) % 3)::INTEGER AS cluster FROM events GROUP BY 1)",
        "SELECT point_id, coalesce(delta.category, base.category) AS category, coalesce(delta.cluster, base.dom)::INTEGER AS dominant_cluster"
        " FROM (SELECT point_id, category, dom FROM emb JOIN f USING (point_id)) AS base FULL JOIN delta USING (point_id)",
    ),
    "index_info": "SELECT p AS points_count, e AS expected, p = e AS matches FROM (SELECT count(*) AS p FROM embeddings), (SELECT count(*) AS e FROM documents)",
    "cluster_model_round_trip": with_(f"{EMB}, {CENTERS}", "SELECT cluster_id, dim::INTEGER AS dim, round(value, 6) AS value FROM center_rows"),
    "assignments_round_trip": ASSIGNED,
    "split_post": with_(SPLIT, "SELECT doc_id, header, body FROM post"),
    "parse_headers": with_(SPLIT, "SELECT doc_id, name, value FROM header"),
    "clean_subject": with_(SPLIT, f"SELECT doc_id, {SUBJECT} AS subject FROM header WHERE name = 'subject'"),
    "parse_groups": with_(
        SPLIT, f"SELECT doc_id, array_to_string(g, ',') AS all_newsgroups, len(g) > 1 AS is_cross_post FROM (SELECT doc_id, {GROUPS} AS g FROM header WHERE name = 'newsgroups')"
    ),
    "quote_ratio": with_(SPLIT, f"SELECT doc_id, round({RATIO}, 6) AS quote_ratio FROM post"),
    **{name: with_(SPLIT, f"SELECT doc_id, {step('body')} AS clean FROM post") for name, step in STEPS.items()},
    "clean_body": with_(f"{SPLIT},\n{body_chain()}", "SELECT doc_id, clean FROM body_clean"),
    "compose_text": f"SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN {strip("lang || ' note' || chr(10) || chr(10) || text")} ELSE text END AS full_text FROM documents",
    "word_count": f"SELECT doc_id, {count('text', f'{NOT_S}+')}::INTEGER AS word_count FROM documents",
    "classify_docs": with_(CLEAN, "SELECT doc_id, round(quote_ratio, 6) AS quote_ratio, coalesce(drop_reason, 'kept') AS outcome FROM classified"),
    "preprocess": DOCS,
    "cleaning_report": with_(
        CLEAN,
        """SELECT grouping(category) = 1 AS is_total, category, count(*) AS total, count(*) FILTER (drop_reason IS NULL) AS kept,
  (100 * count(*) FILTER (drop_reason IS NULL) // count(*))::BIGINT AS kept_percent, count(*) FILTER (drop_reason = 'short') AS dropped_short,
  count(*) FILTER (drop_reason = 'quoted') AS dropped_quoted, 0::BIGINT AS dropped_read_error FROM classified GROUP BY ROLLUP (category)""",
    ),
    "truncate_text": "SELECT doc_id, length(substr(text, 1, 4000))::INTEGER AS chars, md5(substr(text, 1, 4000)) AS digest FROM documents",
    "embed_texts": rf"SELECT doc_id, 384::INTEGER AS dimensions, CASE WHEN regexp_matches(text, '[{W_IN}]') THEN 1.0::DOUBLE ELSE 0.0 END AS length FROM documents",
    "embed_texts_network": f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, 4000), '{NOT_S}+')) AS word FROM documents),
counts AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM words GROUP BY 1, 2),
lengths AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM counts GROUP BY 1)
SELECT doc_id, dim::INTEGER AS dim, round(coalesce(n / len, 0.0)::FLOAT::DOUBLE, 5) AS value FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents)
LEFT JOIN counts USING (doc_id, dim) LEFT JOIN lengths USING (doc_id)""",
    "build_index": with_(
        CLEAN,
        f"""SELECT row_number() OVER (ORDER BY category, doc_id) - 1 AS point_id, doc_id, category, word_count, 384::INTEGER AS dimensions,
  1.0::DOUBLE AS length FROM ({DOC_ROWS})""",
    ),
    "reduce_dims_full_rank": with_(EMB, "SELECT point_id, len(v)::INTEGER AS dimensions, round(sqrt(list_dot_product(v, v)), 6) AS length FROM emb"),
    "l2_normalize": with_(
        f"{EMB}, scaled AS (SELECT point_id, list_transform(v, lambda x: x * (point_id % 5)) AS s FROM emb)",
        """SELECT point_id, (pos - 1)::INTEGER AS dim, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) + 0.0 AS value
FROM (SELECT point_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos, sqrt(list_dot_product(s, s)) AS n FROM scaled)""",
    ),
    "assign_point_ids": with_(RAW, "SELECT row_number() OVER (ORDER BY category, doc_id) - 1 AS point_id, category, doc_id FROM raw"),
    "dot": with_(
        EMB,
        """SELECT a.point_id, round(list_dot_product(a.v, b.v), 6) AS dot,
  round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
FROM emb a JOIN emb b ON b.point_id = a.point_id + 1""",
    ),
    "topk_search": with_(EMB, f"SELECT {SHOWN} FROM ({ranked(EMB_Q, 'emb', '5')})"),
    "topk_search_per_query_k": with_(DOC_INDEX, f"SELECT {SHOWN} FROM ({ranked(EMB_Q, 'doc_index', 'q.query_id % 8')})"),
    "format_results": with_(
        f"{DOC_INDEX},\nhits AS ({ranked(EMB_Q, 'doc_index', 'q.query_id % 4', cols='i.category, i.subject, i.text')})",
        f"""SELECT emb.point_id AS query_id, coalesce(r, 'No relevant documents found.') AS result FROM emb LEFT JOIN
(SELECT query_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS r FROM hits GROUP BY 1) h ON h.query_id = emb.point_id""",
    ),
    "neighbors": with_(EMB, f"SELECT {SHOWN} FROM ({ranked(EMB_Q, 'emb', '4')})"),
    "pruned_search": with_(
        f"{CLUSTERED}, placed AS (SELECT emb.*, dom, top2 FROM emb JOIN f USING (point_id))",
        f"SELECT {SHOWN} FROM ({ranked('(SELECT point_id AS query_id, * FROM placed)', 'placed', '5', 'list_contains(q.top2, i.dom)')})",
    ),
    "knn_graph_cells": """SELECT count(*) AS points, 15 * count(*) AS edges, 15 AS degree, CAST(0 AS BIGINT) AS other_distances,
  'at least 0.9' AS recall FROM embeddings""",
    "knn_graph": with_(
        EMB,
        f"SELECT query_id AS point_id, point_id AS neighbor_id, rank, round(1.0 - score, 6) AS distance FROM ({ranked(EMB_Q, 'emb', '15', 'q.query_id <> i.point_id')})",
    ),
    "fcm_memberships": with_(CLUSTERED, "SELECT point_id, cluster_id, round(u, 6) AS membership FROM w"),
    "fcm_fit": fcm_steps(3),
    "fcm_fit_converged": fcm_converged(20, 0.005),
    "fuzzy_partition_coefficient": with_(CLUSTERED, "SELECT round(avg(s), 6) AS fpc FROM (SELECT sum(u * u) AS s FROM w GROUP BY point_id)"),
    "top_clusters": with_(CLUSTERED, "SELECT point_id, array_to_string(top2, ',') AS top_clusters FROM f"),
    "dominant_cluster": with_(CLUSTERED, "SELECT point_id, dom AS dominant_cluster, round(top_u, 6) AS max_membership FROM f"),
    "silhouette": with_(
        f"""{EMB},
mean_d AS (SELECT a.point_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM emb a, emb b GROUP BY 1, 2, 3),
ab AS (SELECT point_id, max(total / (n - 1)) FILTER (own = other AND n > 1) AS a, min(total / n) FILTER (own <> other) AS b FROM mean_d GROUP BY 1)""",
        "SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab",
    ),
    "membership_entropy": with_(f"{CLUSTERED}, {SPREAD}", "SELECT point_id, round(entropy, 6) AS entropy, boundary AS is_boundary FROM spread"),
    "cluster_profile": with_(
        f"{CLUSTERED}, {SPREAD}",
        "SELECT dom AS cluster_id, count(*) AS docs, round(avg(top_u), 6) AS avg_confidence, count(*) FILTER (boundary) AS boundary_docs FROM f JOIN spread USING (point_id) GROUP BY 1",
    ),
    "top_categories": with_(
        f"{CLUSTERED}, counts AS (SELECT dom, category, count(*) AS n, min(point_id) AS first FROM emb JOIN f USING (point_id) GROUP BY 1, 2)",
        """SELECT dom AS cluster_id, row_number() OVER (PARTITION BY dom ORDER BY n DESC, first)::INTEGER AS rank, category, n AS docs,
  round(100.0 * n / sum(n) OVER (PARTITION BY dom), 6)::DOUBLE AS percent FROM counts QUALIFY rank <= 3""",
    ),
    "boundary_summary": with_(
        f"{CLUSTERED}, {SPREAD}",
        "SELECT count(*) FILTER (boundary) AS boundary_docs, count(*) AS docs, round(100.0::DOUBLE * count(*) FILTER (boundary) / count(*), 6) AS percent FROM spread",
    ),
    "assignments": ASSIGNED,
    "cache_lookup": with_(
        PAIRS,
        """SELECT f.point_id AS seq, hit.e IS NOT NULL AS cache_hit, hit.e AS matched_seq,
 'q' || hit.e AS matched_query, 'answer to q' || hit.e AS result, round(hit.s, 6) AS score FROM f LEFT JOIN
(SELECT q.point_id, e.point_id AS e, list_dot_product(q.v, e.v) AS s
 FROM points q JOIN f fq ON fq.point_id = q.point_id, emb e JOIN f fe ON fe.point_id = e.point_id
 WHERE list_contains(fq.top2, fe.dom) AND list_dot_product(q.v, e.v) >= 0.8
 QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY s DESC, list_position(fq.top2, fe.dom), e.point_id) = 1) hit USING (point_id)""",
    ),
    "cache_store": with_(
        CLUSTERED,
        "SELECT point_id + o AS seq, 'q' || point_id AS query, dom AS cluster_id FROM f, (SELECT unnest([0, 1000000]) AS o)",
    ),
    "cache_replay": _replay(VECTOR_LOG, "SELECT seq, cache_hit, matched_seq, similarity, dom AS dominant_cluster FROM decided"),
    "cache_replay_events": _replay(
        EVENT_LOG,
        "SELECT seq, epoch, theta, cache_hit, matched_seq, 'q' || matched_seq AS matched_query, similarity FROM decided",
    ),
    "cache_replay_stream": _replay(EVENT_LOG, "SELECT seq, epoch, cache_hit, matched_seq, similarity FROM decided"),
    "cache_stats": _replay(VECTOR_LOG, f"SELECT {COUNTS}, {RATE}, {LOG_THETA}::DOUBLE AS threshold FROM decided"),
    "epoch_stats": _replay(EVENT_LOG, f"SELECT epoch, {COUNTS}, {RATE} FROM decided GROUP BY epoch"),
    "flush_report": _replay(
        EVENT_LOG,
        """SELECT seq, (epoch_n - 1)::BIGINT AS epoch, coalesce(n, 0) AS entries_cleared FROM state LEFT JOIN
(SELECT epoch, count(*) AS n FROM decided WHERE NOT cache_hit GROUP BY 1) c ON c.epoch = epoch_n - 1 WHERE is_flush""",
    ),
    "threshold_as_of": with_(EVENT_LOG, "SELECT seq, epoch_n::BIGINT AS epoch, theta FROM state"),
    "cluster_distribution": _replay(VECTOR_LOG, "SELECT dom AS cluster_id, count(*) AS entries FROM decided WHERE NOT cache_hit GROUP BY 1"),
    "entry_hits": _replay(
        VECTOR_LOG,
        """SELECT d.seq, d.dom AS cluster_id, count(h.seq) AS hit_count FROM decided d LEFT JOIN decided h ON h.matched_seq = d.seq
WHERE NOT d.cache_hit GROUP BY 1, 2""",
    ),
    "cluster_entries": with_(CLUSTERED, "SELECT point_id AS seq, 'q' || point_id AS query, dom AS cluster_id FROM f WHERE dom = 3"),
    "scan_cost": with_(
        CLUSTERED,
        """SELECT (n * n)::BIGINT AS flat_products, p::BIGINT AS bucket_products, round((n * n)::DOUBLE / p, 6) AS speedup
FROM (SELECT count(*) AS n FROM f), (SELECT count(*) AS p FROM f a JOIN f b ON list_contains(a.top2, b.dom))""",
    ),
    "validate_queries": with_(TURNS, "SELECT seq, query, top_k, CASE WHEN query = '' THEN 'Query cannot be empty' END AS reject_reason FROM turns"),
    "answer_queries": _replay(
        f"""{CLUSTERED}, {TURNS}, {DOC_INDEX_ONLY},
log AS (SELECT seq, query, top_k, {LOG_THETA}::DOUBLE AS theta, 0 AS epoch, (seq * 7) % (SELECT count(*) FROM emb) AS vec, top2, dom
  FROM turns JOIN f ON (seq * 7) % (SELECT count(*) FROM emb) = point_id WHERE query <> '')""",
        f"""SELECT d.seq, d.query, d.cache_hit, CASE WHEN d.cache_hit THEN o.query END AS matched_query, d.similarity AS similarity_score,
  t.r AS result, d.dom AS dominant_cluster, o.top_k
FROM decided d JOIN log o ON o.seq = coalesce(d.matched_seq, d.seq)
JOIN (SELECT query_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS r FROM
  ({ranked('(SELECT decided.seq AS query_id, v, log.top_k FROM decided JOIN log USING (seq) JOIN emb ON decided.vec = emb.point_id WHERE NOT cache_hit)', 'doc_index', 'q.top_k', cols='i.category, i.subject, i.text')})
  GROUP BY 1) t ON t.query_id = o.seq""",
    ),
    "service_summary": "SELECT 'ok' AS status, count(*) AS cache_entries, 0.8::DOUBLE AS threshold FROM embeddings",
    "first_relevant_rank": with_(f"{DOC_INDEX},\n{RANKS}", "SELECT query_id, expected_category, found_at FROM ranks"),
    "hit_at_k": with_(
        f"{DOC_INDEX},\n{RANKS}, h AS (SELECT count(*) AS n_queries, {HIT_COLS} FROM ranks)",
        "SELECT n_queries, round(hit_at_1, 6) AS hit_at_1, round(hit_at_3, 6) AS hit_at_3, round(hit_at_5, 6) AS hit_at_5 FROM h",
    ),
    "mean_reciprocal_rank": with_(f"{DOC_INDEX},\n{RANKS}", "SELECT round(avg(coalesce(1.0::DOUBLE / found_at, 0)), 6) AS mrr FROM ranks"),
    "pair_outcomes": with_(f"{PAIRS},\n{OUTCOME}", "SELECT pair_id, kind, round(raw_sim, 6) AS raw_sim, routed, hit, routing_miss FROM outcome"),
    "pair_rates": with_(
        f"{PAIRS},\n{OUTCOME}",
        "SELECT kind, count(*) AS pairs, round(avg(hit::INTEGER), 6) AS hit_rate, count(*) FILTER (routing_miss) AS routing_misses FROM outcome GROUP BY 1",
    ),
    "threshold_sweep": with_(f"{PAIRS},\n{SWEEP}", f"SELECT {SWEEP_COLS} FROM sweep"),
    "best_threshold": with_(f"{PAIRS},\n{SWEEP}", f"SELECT {SWEEP_COLS} FROM sweep ORDER BY sweep.f1 DESC, threshold LIMIT 1"),
    "latency_by_stage": """SELECT event_type AS stage, count(value) AS measured, round(avg(value), 6) AS avg_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency
  FROM (SELECT * FROM events QUALIFY row_number() OVER (ORDER BY event_id) > 3) GROUP BY event_type""",
    "latency_summary": with_(LATENCY, "SELECT measured, round(avg_latency, 6) AS avg_latency, round(p95_latency, 6) AS p95_latency FROM lat"),
    "evaluation_report": with_(
        f"{PAIRS},\n{DOC_INDEX_ONLY},\n{RANKS},\n{SWEEP},\n{OUTCOME},\n{LATENCY},\n"
        f"h AS (SELECT count(*) AS n_queries, {HIT_COLS}, avg(coalesce(1.0::DOUBLE / found_at, 0)) AS mrr FROM ranks),\n"
        "c AS (SELECT avg(hit::INTEGER) FILTER (kind = 'paraphrase') AS paraphrase_hit_rate, count(*) FILTER (routing_miss AND kind = 'paraphrase') AS cluster_misses, "
        "avg(hit::INTEGER) FILTER (kind = 'unrelated') AS false_positive_rate FROM outcome),\n"
        "t AS (SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)",
        """SELECT n_queries, round(hit_at_1, 6) AS hit_at_1, round(hit_at_3, 6) AS hit_at_3, round(hit_at_5, 6) AS hit_at_5, round(mrr, 6) AS mrr,
  round(paraphrase_hit_rate, 6) AS paraphrase_hit_rate, cluster_misses, round(false_positive_rate, 6) AS false_positive_rate,
  threshold AS best_threshold, round(f1, 6) AS best_f1, measured, round(avg_latency, 6) AS avg_latency, round(p95_latency, 6) AS p95_latency
FROM h, c, t, lat""",
    ),
}
#: The stream answers the same log.
ORACLES["answer_stream"] = ORACLES["answer_queries"]
