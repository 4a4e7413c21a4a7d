"""DuckDB SQL for those registered queries whose rows SQL can give."""

from __future__ import annotations

from siftwork.llm.url_filter import LISTED_WORDS, RULES

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, w[i:i + 12] AS win FROM starts
), sizes AS (
  SELECT DISTINCT len(win) AS k FROM wins
), dw AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents
), runs AS (
  SELECT doc_id, i, k, w[i:i + k - 1] AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)
), hits AS (
  SELECT r.doc_id, r.i, r.k, v.item_id FROM runs r JOIN wins v ON r.win = v.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

OP7 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_HOST = _LOW.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")
_RULES = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in _RULES]

OP10 = f"""
WITH parts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q
  FROM pages
), urls AS (
  SELECT page_id, host, path, regexp_replace(host, '^(www|m)\\.', '') || rtrim(path, '/') ||
         CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical,
         regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)') AS spam
  FROM parts
), ruled AS (
  SELECT *, CASE {" ".join(f"{f} THEN '{r[1]}{r[2]}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS rule,
         CASE {" ".join(f"{f} THEN '{r[0]}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS ruled
  FROM urls
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host <> '' AND canonical IN (SELECT canonical FROM urls WHERE spam)
       THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
""".replace("\\\\", "\\")

OP9 = """
WITH f AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep
  FROM pages
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND keep <> page_id THEN keep END AS refers_to
FROM f
"""

OP12 = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT * FROM r WHERE vec_id % 50 = 0) a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, other, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HASH = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
# CRC-32 a bit at a time, with the reversed polynomial 0xEDB88320.
_STEP = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: list_prepend(CAST(ascii(d) AS BIGINT), [CAST(-1 AS BIGINT) FOR i IN range(8)])))"
_CRC = f"xor(list_reduce({_BITS}, lambda c, x: {_STEP}, CAST(4294967295 AS BIGINT)), 4294967295)"
_UP = "list_transform(range(0, (len(nodes) + 15) // 16), lambda k: sha256(array_to_string(nodes[k * 16 + 1:k * 16 + 16], '')))"
_SIDES = "array_to_string(nodes[n // 16 * 16 + 1:n], '') || '|' || array_to_string(nodes[n + 2:n // 16 * 16 + 16], '')"

OP13 = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, source, {_HASH.format("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_HASH.format(_LOW.format("text"))} ELSE {_HASH.format("text")} END AS seen
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS i, row_number() OVER () AS rid FROM found
), up AS (
  SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, {_UP} FROM up WHERE len(nodes) > 1
), subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM up WHERE len(nodes) = 1
), top AS (
  SELECT 100 AS level, list(subroot ORDER BY j) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, {_UP} FROM top WHERE len(nodes) > 1
), steps AS (
  SELECT rid, level, {_SIDES} AS sides
  FROM (SELECT p.rid, u.level, u.nodes, CAST(floor(p.i / pow(16, u.level)) AS BIGINT) AS n
        FROM placed p JOIN up u ON p.source IS NOT DISTINCT FROM u.source AND len(u.nodes) > 1)
  UNION ALL
  SELECT rid, level, {_SIDES}
  FROM (SELECT p.rid, t.level, t.nodes, CAST(floor(s.j / pow(16, t.level - 100)) AS BIGINT) AS n
        FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN top t ON len(t.nodes) > 1)
), paths AS (
  SELECT rid, list(sides ORDER BY level) AS sides FROM steps GROUP BY rid
), folded AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
         sha256(replace(array_to_string(coalesce(h.sides, []), ''), '|', '')) AS proof_sha256,
         list_reduce(coalesce(h.sides, []), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), p.seen) AS folded_root
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN paths h USING (rid)
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLES = {
    "op9_warc": OP9, "op5_benchmark_decontamination": OP5, "op7_exact_dedup": OP7, "op10_url_filters": OP10, "op12_hard_negatives": OP12, "op13_merkle": OP13
}
