"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
    FROM words
), members AS (
    SELECT doc_id, unnest(s) AS shingle FROM shingles
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM members AS a JOIN members AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN shingles AS a ON a.doc_id = x JOIN shingles AS b ON b.doc_id = y
    WHERE 100 * common >= 85 * (len(a.s) + len(b.s) - common)
), sides AS (
    SELECT x, y FROM links UNION SELECT y, x FROM links
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reached.x, sides.y FROM reached JOIN sides ON reached.y = sides.x
), least AS (
    SELECT x, min(y) AS component_id FROM reached GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM shingles JOIN least ON least.x = doc_id
"""

DECONTAMINATION = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest([w[i:i + least(len(w), 13) - 1] FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS words
    FROM item WHERE len(w) > 0
), lengths AS (
    SELECT DISTINCT n FROM item_window
), doc_window AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS spot, w FROM doc, lengths WHERE len(w) >= n
), found AS (
    SELECT doc_id, spot, item_window.n, item_id FROM doc_window JOIN item_window
    ON item_window.n = doc_window.n AND w[spot:spot + doc_window.n - 1] = words
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS place FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The lowest bit of a CRC-32 of the digits, bit by bit; the polynomial is 0xEDB88320.
_BIT = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
_ODD_CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(digits) + 1), lambda i: CAST(ord(digits[i]) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {_BIT})), 4294967295) & 1"""

_VALUES = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))


def _leaf(text: str) -> str:
    return f"sha256({_VALUES} || CASE WHEN text IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END)"


MERKLE = f"""
WITH RECURSIVE leaf AS (
    SELECT doc_id, source, {_leaf("text")} AS node, {_leaf("replace(text, chr(10), '')")} AS forged, CAST(doc_id AS VARCHAR) AS digits
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM leaf
), tree AS (
    SELECT source, 0 AS level, pos, node FROM placed
    UNION ALL
    SELECT source, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY source) AS nodes FROM tree) WHERE nodes > 1 GROUP BY source, level, pos // 3
), subroots AS (
    SELECT source, node AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level DESC) AS down FROM tree) WHERE down = 1
), crown AS (
    SELECT 0 AS level, place AS pos, subroot AS node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER () AS nodes FROM crown) WHERE nodes > 1 GROUP BY level, pos // 3
), top AS (
    SELECT node AS root, level AS height FROM crown ORDER BY level DESC LIMIT 1
), runs AS (
    SELECT 'rows' AS part, source, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM tree GROUP BY ALL
    UNION ALL
    SELECT 'sources', NULL, level, pos // 3, list(node ORDER BY pos) FROM crown GROUP BY ALL
), walk AS (
    SELECT doc_id, source, node AS leaf, 'rows' AS part, 0 AS level, pos, '' AS proof,
        CASE WHEN doc_id IS NOT NULL AND {_ODD_CRC} = 0 THEN coalesce(forged, node) ELSE node END AS folded, pos AS first_pos
    FROM placed
    UNION ALL
    SELECT doc_id, source, leaf, CASE WHEN up THEN part ELSE 'sources' END, CASE WHEN up THEN level + 1 ELSE 0 END,
        CASE WHEN up THEN pos // 3 ELSE place END,
        CASE WHEN up THEN proof || before || after ELSE proof END, CASE WHEN up THEN sha256(before || folded || after) ELSE folded END, first_pos
    FROM (
        SELECT walk.*, place, level < CASE WHEN walk.part = 'rows' THEN subroots.height ELSE top.height END AS up,
            coalesce(array_to_string(nodes[1:walk.pos % 3], ''), '') AS before, coalesce(array_to_string(nodes[walk.pos % 3 + 2:], ''), '') AS after
        FROM walk JOIN subroots ON subroots.source IS NOT DISTINCT FROM walk.source CROSS JOIN top
        JOIN (SELECT part AS p, source AS s, level AS l, run, nodes FROM runs) ON p = walk.part AND l = walk.level AND run = walk.pos // 3
            AND (walk.part = 'sources' OR s IS NOT DISTINCT FROM walk.source)
        WHERE NOT (walk.part = 'sources' AND walk.level = top.height)
    )
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM walk JOIN subroots ON subroots.source IS NOT DISTINCT FROM walk.source CROSS JOIN top
WHERE part = 'sources' AND level = top.height
"""

COLLOCATIONS = rf"""
WITH RECURSIVE piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), sequence AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), place AS (
    SELECT lang, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS run FROM sequence, range(1, 5) AS sizes(k) WHERE len(w) >= k
), run AS MATERIALIZED (
    SELECT lang, run, count(*) AS f FROM place GROUP BY ALL HAVING count(*) >= 30
), total AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM sequence GROUP BY lang
), split AS MATERIALIZED (
    SELECT lang, run, f AS a, k, run[:k] AS one, run[k + 1:] AS two FROM run, range(1, 4) AS ks(k) WHERE k < len(run)
), cut AS MATERIALIZED (
    SELECT split.lang, split.run, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
    FROM split JOIN run AS x ON x.lang = split.lang AND x.run = one JOIN run AS y ON y.lang = split.lang AND y.run = two
), weakest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, run ORDER BY score, k) AS low FROM cut) WHERE low = 1
), inner_run AS (
    SELECT lang, run[i:i + k - 1] AS run, max(f) AS longer FROM run, range(1, 4) AS i_(i), range(2, 4) AS k_(k)
    WHERE k < len(run) AND i + k - 1 <= len(run) GROUP BY ALL
), kept AS (
    SELECT weakest.* FROM weakest LEFT JOIN inner_run USING (lang, run) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), edge AS (
    SELECT lang, run, f, run[:3] AS tail, run[2:] AS head FROM run WHERE len(run) = 4
), way_out AS (
    SELECT lang, tail AS node, count(*) AS ways, any_value(f) AS f, any_value(run) AS run FROM edge GROUP BY ALL
), way_in AS (
    SELECT lang, head AS node, count(*) AS ways, any_value(f) AS f, any_value(run) AS run FROM edge GROUP BY ALL
), link AS (
    SELECT lang, i.run AS prior, o.run AS next FROM way_out AS o JOIN way_in AS i USING (lang, node) WHERE o.ways = 1 AND i.ways = 1 AND o.f = i.f
), walk AS (
    SELECT lang, run AS first, run AS here FROM edge WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.lang = edge.lang AND link.next = edge.run)
    UNION ALL
    SELECT lang, first, next FROM walk JOIN link USING (lang) WHERE link.prior = walk.here
), circle AS (
    SELECT lang, run AS first, run AS here FROM edge WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.lang = edge.lang AND walk.here = edge.run)
    UNION ALL
    SELECT lang, first, next FROM circle JOIN link USING (lang) WHERE link.prior = circle.here AND next <> first
), passage AS (
    SELECT lang, here AS run, count(*) OVER (PARTITION BY lang, first) + 3 AS passage_words FROM walk
    UNION ALL
    SELECT lang, first, count(*) + 3 FROM circle GROUP BY lang, first
)
SELECT lang, rank, phrase, a, l, r, n, score, passage_words FROM (
    SELECT lang, run, array_to_string(run, ' ') AS phrase, a, l, r, n, score,
        row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(run, ' ')) AS rank
    FROM kept JOIN total USING (lang)
) LEFT JOIN passage USING (lang, run) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op7_jaccard_join": NEAR_DUPLICATES,
    "op9_decontamination": DECONTAMINATION,
    "op11_collocations": COLLOCATIONS,
    "op12_merkle_manifest": MERKLE,
}
