"""Queries of siftwork.operators.stories with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import refs
from siftwork.operators import stories
from siftwork.plans.registry import query
from siftwork.sources.adapters import items, posts, table

POSTS = """posts AS (SELECT doc_id AS item_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, coalesce(text, '') AS text, lang AS region, source AS outlet,
  ['research_ip', 'oss', 'community', 'news'][doc_id // 3 % 4 + 1] AS track, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 37 % 1440 AS INTEGER)) AS occurred_at,
  n_chars % 101 AS relevance, CASE WHEN doc_id % 5 <> 0 THEN doc_id // 4 END AS story FROM documents)"""


def plain_sql(x: str) -> str:
    low = rf"regexp_replace(lower(coalesce({x}, '')), 'https?://\S+(\s\S+){{0,2}}', ' ', 'g')"
    low = rf"regexp_replace({low}, '(^|[^\p{{L}}\p{{N}}_])[@#][\p{{L}}\p{{N}}_.-]+', '\1 ', 'g')"
    return rf"trim(regexp_replace({low}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' ')"


_KEYS = f"""{POSTS}, n AS (SELECT item_id, {plain_sql("title")} AS t, {plain_sql("text")} AS b FROM posts), keys AS (
  SELECT item_id, CASE WHEN length(t) + length(b) >= 40 THEN substr(sha256(t || ' | ' || b), 1, 32) END AS text_key,
  CASE WHEN length(t) >= 30 THEN substr(sha256(t), 1, 32) END AS title_key, CASE WHEN length(b) >= 40 THEN substr(sha256(substr(b, 1, 120)), 1, 32) END AS lead_key,
  t <> '' AND starts_with(b, substr(t, 1, 60)) AS lead_title FROM n)"""


@query("dedup_keys", f"WITH {_KEYS} SELECT * FROM keys")
def _(spark, d):
    return stories.dedup_keys(posts(spark, d))


@query("duplicate_roots", f"""WITH {_KEYS}, x AS (SELECT a.item_id, min(b.item_id) FILTER (a.text_key = b.text_key) AS by_text, min(b.item_id) FILTER (a.title_key = b.title_key AND
  (a.lead_key IS NULL OR b.lead_key IS NULL OR a.lead_title OR b.lead_title OR a.lead_key = b.lead_key)) AS by_title
  FROM keys a LEFT JOIN keys b ON b.item_id < a.item_id AND (a.text_key = b.text_key OR a.title_key = b.title_key) GROUP BY a.item_id)
  SELECT item_id, coalesce(by_text, by_title) AS root, CASE WHEN by_text IS NOT NULL THEN 'text' WHEN by_title IS NOT NULL THEN 'title' END AS matched_by FROM x""")
def _(spark, d):
    return stories.duplicate_roots(stories.dedup_keys(posts(spark, d)))


_BARE = r"regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_GRAMS = "CASE WHEN c = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(c) - 2, 1) + 1), lambda i: substr(c, i, 3))) END"


@query("char_shingle_counts", f"SELECT doc_id, len({_GRAMS}) AS n FROM (SELECT doc_id, {_BARE.format('text')} AS c FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(refs.char_shingles(F.col("text"))).alias("n"))


_FAMILY = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in refs.FAMILY) + "]"
_SIGNED = f"""{POSTS}, f AS (SELECT title, min(item_id) AS item_id FROM posts WHERE title <> '' GROUP BY title), g AS (SELECT item_id, {_GRAMS} AS s FROM (SELECT item_id, {_BARE.format('title')} AS c FROM f)),
  h AS (SELECT item_id, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % {refs.PRIME}) AS x FROM g WHERE len(s) > 0),
  signed AS (SELECT item_id, list_transform({_FAMILY}, lambda f: list_min(list_transform(x, lambda v: (v * f.a + f.b) % {refs.PRIME}))) AS sig FROM h)"""


@query("minhash_signatures", f"WITH {_SIGNED} SELECT item_id, md5(array_to_string(sig, ',')) AS digest FROM signed")
def _(spark, d):
    signed = stories.signed_titles(posts(spark, d))
    return signed.select("item_id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("digest"))


_ALIKE = f"""{_SIGNED}, bands AS (SELECT item_id, sig, i || ':' || array_to_string(sig[i * 4 + 1 : i * 4 + 4], ',') AS band FROM signed, (SELECT unnest(range(0, 16)) AS i)),
  near AS (SELECT DISTINCT b.item_id, l.item_id AS leader, len(list_filter(range(1, 65), lambda i: b.sig[i] = l.sig[i])) / 64.0 AS similarity FROM bands b JOIN bands l ON b.band = l.band AND l.item_id < b.item_id),
  alike AS (SELECT * FROM near WHERE similarity >= 0.45 UNION ALL SELECT p.item_id, f.item_id, 1.0 FROM posts p JOIN f USING (title) WHERE f.item_id < p.item_id)"""


@query("alike_titles", f"WITH {_ALIKE} SELECT * FROM alike")
def _(spark, d):
    return stories.alike_titles(posts(spark, d))


@query("story_clusters", f"""WITH RECURSIVE {_ALIKE}, e AS (SELECT item_id AS a, leader AS b FROM alike UNION SELECT leader, item_id FROM alike),
  reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a) SELECT node AS item_id, min(seen) AS story FROM reach GROUP BY node""")
def _(spark, d):
    return stories.story_clusters(stories.alike_titles(posts(spark, d)))


def _cited(spark, d):
    """Parts with a line that cites identifiers made of their columns."""
    k = F.col("p_partkey")
    number = lambda n, width: F.lpad((k % n).cast("string"), width, "0")
    line = F.concat(
        F.lit("see arXiv: 24"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("."), number(500, 5), F.lit(" and CVE-2024-"), number(300, 4), F.lit(" in https://github.com/"),
        F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit(".git, doi 10.48550/arXiv.2401."), number(70, 5), F.lit(". TS38."), number(900, 3), F.lit(", US 2024/"), number(10_000, 7), F.lit(" A1"),
    )
    return table(spark, d, "part").select("p_partkey", refs.references(line).alias("refs"))


_CITED = """cited AS (SELECT p_partkey, list_sort(list_distinct(['arxiv:24' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey % 500 AS VARCHAR), 5, '0'),
  'cve:CVE-2024-' || lpad(CAST(p_partkey % 300 AS VARCHAR), 4, '0'), 'github:' || lower(replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '-')),
  'arxiv:2401.' || lpad(CAST(p_partkey % 70 AS VARCHAR), 5, '0'), '3gpp:TS 38.' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0'), 'patent:US2024/' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 7, '0')])) AS refs FROM part)"""


@query("cited_references", f"WITH {_CITED} SELECT p_partkey, array_to_string(refs, ' ') AS refs FROM cited")
def _(spark, d):
    return _cited(spark, d).select("p_partkey", F.array_join("refs", " ").alias("refs"))


@query("identifier_partners", f"WITH {_CITED}, e AS (SELECT p_partkey, unnest(refs) AS ref FROM cited) SELECT ref, count(*) AS n, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM e GROUP BY ref HAVING count(*) > 1")
def _(spark, d):
    held = _cited(spark, d).select("p_partkey", F.explode("refs").alias("ref"))
    return held.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id")).where("n > 1")


@query("reference_groups")
def _(spark, d):
    """Parts that any of their identifiers hold together; without a twin, as a closure over all parts is too slow in SQL (see tests/test_graph.py)."""
    return stories.reference_groups(_cited(spark, d), "p_partkey", "refs")


_FOLDS = f"""{POSTS}, folds AS (SELECT coalesce(story, -item_id) AS fold, count(*) AS posts, count(DISTINCT outlet) AS outlets, count(DISTINCT track) AS tracks, min(occurred_at) AS first_at, max(occurred_at) AS last_at,
  last(item_id ORDER BY coalesce(relevance, -1), occurred_at, item_id) AS representative FROM posts GROUP BY 1)"""


@query("story_folds", f"WITH {_FOLDS} SELECT * FROM folds")
def _(spark, d):
    return stories.story_folds(posts(spark, d))


@query("story_list", f"WITH {_FOLDS} SELECT fold, outlets, posts, last_at FROM folds WHERE tracks >= 2 ORDER BY outlets DESC, posts DESC, last_at DESC, fold LIMIT 50")
def _(spark, d):
    own = stories.story_folds(posts(spark, d)).where("tracks >= 2")
    return own.orderBy(F.desc("outlets"), F.desc("posts"), F.desc("last_at"), "fold").limit(50).select("fold", "outlets", "posts", "last_at")


@query("continuing_stories_top", f"""WITH {_FOLDS} SELECT fold, CAST(last_at AS DATE) - CAST(first_at AS DATE) + 1 AS days, outlets FROM folds WHERE fold >= 0 AND CAST(last_at AS DATE) - CAST(first_at AS DATE) + 1 >= 2
  ORDER BY days DESC, outlets DESC, fold LIMIT 5""")
def _(spark, d):
    own = stories.story_folds(posts(spark, d)).where("fold >= 0")
    own = own.select("fold", (F.date_diff(F.to_date("last_at"), F.to_date("first_at")) + 1).cast("long").alias("days"), "outlets").where("days >= 2")
    return own.orderBy(F.desc("days"), F.desc("outlets"), "fold").limit(5)


@query("others_in_story", f"WITH {POSTS} SELECT a.item_id, count(b.item_id) AS others FROM posts a LEFT JOIN posts b ON a.story = b.story AND a.outlet <> b.outlet WHERE a.story IS NOT NULL GROUP BY a.item_id")
def _(spark, d):
    return stories.others_in_story(posts(spark, d))


@query("errors_then_views", """SELECT e.event_id, count(*) AS n, first(v.event_id ORDER BY v.ts, v.event_id) AS first_id FROM events e JOIN events v ON e.user_id = v.user_id AND v.ts >= e.ts AND v.ts <= e.ts + INTERVAL 2 DAY
  WHERE e.event_type = 'error' AND v.event_type = 'view' GROUP BY e.event_id""")
def _(spark, d):
    own = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stories.within(own.where("event_type = 'error'"), own.where("event_type = 'view'"), "user_id", 2, "event_id", "event_id", "ts")


_ALIASES = "aliases AS (SELECT w AS alias, min(w) OVER (PARTITION BY substr(w, 1, 1)) AS canonical FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part))"


@query("canonical_keywords", f"""WITH {_ALIASES}, e AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
  f AS (SELECT p_partkey, coalesce(canonical, w) AS key, min(i) AS i FROM e LEFT JOIN aliases ON w = alias GROUP BY 1, 2) SELECT p_partkey, string_agg(key, ' ' ORDER BY i) AS keys FROM f GROUP BY p_partkey""")
def _(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    words = own.select(F.explode("words").alias("alias")).distinct()
    least = words.groupBy(F.substring("alias", 1, 1).alias("head")).agg(F.min("alias").alias("canonical"))
    aliases = words.join(least, F.substring("alias", 1, 1) == F.col("head")).select("alias", "canonical")
    return stories.canonical_words(own, "words", aliases, "p_partkey").select("p_partkey", F.array_join("keys", " ").alias("keys"))


_PARTIES = "SELECT DISTINCT p_name || [' Inc', ' Corp.', ' (EU)', '', ' Holdings Ltd'][p_partkey % 5 + 1] AS name FROM part"
_WORDS = r"""list_filter(string_split_regex(regexp_replace(lower(name), '\s*[(\[][^)\]]*[)\]]', ' ', 'g'), '[\s,.''’`"&!?/:;·_-]+'), lambda w: w <> '')"""


@query("party_spellings", f"""WITH n AS ({_PARTIES}), w AS (SELECT name, list_filter({_WORDS}, lambda w: NOT list_contains([{", ".join(f"'{f}'" for f in refs.FORMS)}], w)) AS w FROM n),
  f AS (SELECT name, w, array_to_string(w, '') AS f FROM w)
  SELECT x.name AS a, y.name AS b FROM f x JOIN f y ON x.name < y.name AND substr(x.f, 1, 3) = substr(y.f, 1, 3)
  WHERE x.f = y.f OR (len(x.w) <= len(y.w) AND length(x.f) >= 4 AND y.w[1:len(x.w)] = x.w) OR (len(y.w) <= len(x.w) AND length(y.f) >= 4 AND x.w[1:len(y.w)] = y.w)""")
def _(spark, d):
    ends = F.element_at(F.array(*map(F.lit, (" Inc", " Corp.", " (EU)", "", " Holdings Ltd"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return stories.party_pairs(table(spark, d, "part").select(F.concat("p_name", ends).alias("name")))


_ITEMS = """items AS (SELECT event_id AS item_id, event_type AS track, k % 5 AS field, list_distinct([k % 10, k % 7 + 10, k % 13 + 20]) AS keywords FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


@query("keyword_and_field_counts", f"WITH {_ITEMS}, e AS (SELECT item_id, unnest(keywords) AS keyword, field FROM items) SELECT keyword, f AS field, count(DISTINCT item_id) AS n FROM (SELECT item_id, keyword, unnest([field, field + 100]) AS f FROM e) GROUP BY 1, 2")
def _(spark, d):
    own = items(spark, d).select("item_id", F.explode("keywords").alias("keyword"), F.array("field", F.col("field") + 100).alias("fields"))
    return own.select("item_id", "keyword", F.explode("fields").alias("field")).groupBy("keyword", "field").agg(F.countDistinct("item_id").alias("n"))


@query("normalized_urls", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':\d+$', ''), '^www[.]', ''), '^m[.]', '') AS host,
  rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
  lambda x: regexp_matches(x, '=.') AND NOT regexp_matches(lower(x), '^(utm_|fbclid=|gclid=|mc_|ref=|ref_src=|source=|cmpid=|ito=|at_)'))) AS q FROM pages)
  SELECT page_id, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM p""")
def _(spark, d):
    from siftwork.functions import text

    return table(spark, d, "pages").select("page_id", text.normalized_url(F.col("url")).alias("u"))


@query("model_names", r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(n, ' '), '\([^)]*\)', ' ', 'g')), '[\s_./]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), '-(20\d{6}|\d{4}-\d{2}-\d{2})$', '') AS model
  FROM (SELECT p_partkey, p_name || ' ' || p_brand || '.' || p_size || ' (' || p_type || ')' || CASE WHEN p_partkey % 2 = 0 THEN ' 20240105' ELSE '' END AS n FROM part)""")
def _(spark, d):
    date = F.when(F.col("p_partkey") % 2 == 0, " 20240105").otherwise("")
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit("."), F.col("p_size").cast("string"), F.lit(" ("), "p_type", F.lit(")"), date)
    return table(spark, d, "part").select("p_partkey", refs.model_name(name).alias("model"))


@query("log_signatures", r"""WITH m AS (SELECT conv_id, trim(regexp_replace(regexp_replace(regexp_replace(split_part(trim(coalesce(text, ''), ' '), chr(10), 1), 'https?://\S+', '<url>', 'g'), '\b[0-9a-f]{8,}\b', '<hex>', 'g'), '\d+', '<n>', 'g'), ' ') AS s FROM conversations)
  SELECT substr(s, 1, 180) AS signature, count(*) AS n FROM m GROUP BY 1""")
def _(spark, d):
    own = table(spark, d, "conversations").select(refs.log_signature(F.coalesce("text", F.lit(""))).alias("signature"))
    return own.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


@query("work_keys", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'arxiv:24' || p_partkey ELSE 'doi:10.1000/' || lower(p_name) END AS work FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    doi = F.when(k % 2 == 0, F.concat(F.lit(" 10.48550/arXiv.24"), k.cast("string"), F.lit("v"), (k % 3 + 1).cast("string"))).otherwise(F.concat(F.lit("10.1000/"), F.upper("p_name"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", refs.work_key(doi).alias("work"))
