"""Queries of siftwork.operators.clusters with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import refs
from siftwork.operators import clusters
from siftwork.plans.registry import query
from siftwork.plans.stories import _BARE, _FAMILY, _GRAMS
from siftwork.sources.adapters import table


def reports(spark, d):
    """Documents as reports: seen over a fortnight, some told earlier, the links of a title in three forms, keywords from the title's long words."""
    doc, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    title = F.substring(F.substring_index(text, "\n", 1), 1, 80)
    seen = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 7919 % 20160 as int))")
    page = F.concat(F.lit("site.org/p/"), F.substring(F.md5(title), 1, 12))
    url = F.when(doc % 4 == 0, F.concat(F.lit("https://www."), page, F.lit("?utm_source=x"))).when(doc % 4 == 1, F.concat(F.lit("http://m."), page, F.lit("?amp=1"))).when(doc % 4 == 2, F.concat(F.lit("https://"), page, F.lit("/amp")))
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 8)), 1, 4)
    return table(spark, d, "documents").select(
        doc.alias("item_id"), seen.alias("seen_at"), F.when(doc % 7 != 0, seen - F.make_dt_interval(hours=(doc % 50).cast("int"))).alias("told_at"), "source",
        F.concat(F.lit("pub"), F.substring("source", -1, 1)).alias("publisher"), F.when(title != "", url).alias("url"), F.md5(text).alias("content_hash"), title.alias("title"), words.alias("keywords"),
    )


_R = f"""raw AS (SELECT doc_id AS id, source, 'pub' || right(source, 1) AS publisher, coalesce(text, '') AS text, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, doc_id * 7919 % 20160 AS minute FROM documents),
  g AS (SELECT *, {_GRAMS} AS s FROM (SELECT *, {_BARE.format('title')} AS c FROM raw)),
  h AS (SELECT *, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT % {refs.PRIME}) AS x FROM g),
  r AS (SELECT id, source, publisher, minute * 60 AS t, minute // 60 AS hour, CAST(floor((minute * 60 - CASE WHEN id % 7 <> 0 THEN id % 50 * 3600 ELSE 0 END) / 3600.0) AS BIGINT) AS told, CASE WHEN title <> '' AND id % 4 <> 3 THEN md5(title) END AS url,
    md5(text) AS content, lower(title) AS title, CASE WHEN length(trim(title, ' ')) >= 30 THEN lower(title) END AS long_title,
    CASE WHEN len(s) > 0 THEN list_transform({_FAMILY}, lambda f: list_min(list_transform(x, lambda v: (v * f.a + f.b) % {refs.PRIME}))) ELSE [] END AS sig,
    list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 8) AS long_words FROM h),
  pairs AS (SELECT a.id, b.id AS other, b.t AS bt, a.url = b.url AND (a.source <> b.source OR a.title = b.title) AS link, a.content = b.content AS content, a.long_title = b.long_title AS headline,
    abs(a.told - b.told) <= 48 AS close, a.sig AS sa, b.sig AS sb FROM r a JOIN r b ON (b.t < a.t OR b.t = a.t AND b.id < a.id) AND b.hour >= a.hour - 72),
  e AS (SELECT id, coalesce(arg_min(other, bt * 1000000 + other) FILTER (link), arg_min(other, bt * 1000000 + other) FILTER (content), arg_min(other, bt * 1000000 + other) FILTER (headline)) AS parent FROM pairs GROUP BY id),
  exact AS (SELECT id, parent FROM e WHERE parent IS NOT NULL),
  open AS (SELECT id, other, bt, close, sa, sb, len(list_filter(range(1, 65), lambda i: sa[i] = sb[i])) / 64.0 AS score FROM pairs WHERE id NOT IN (SELECT id FROM exact) AND len(sa) > 0 AND len(sb) > 0),
  near AS (SELECT id, other AS parent, score FROM open WHERE score >= 0.45 AND len(list_filter(range(0, 16), lambda k: sa[k * 4 + 1:k * 4 + 4] = sb[k * 4 + 1:k * 4 + 4])) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, bt, other) = 1),
  words AS (SELECT id, t, unnest(list_distinct(list_transform(range(1, len(long_words) + 1), lambda i: CASE WHEN len(list_distinct(long_words[1:i])) <= 4 THEN long_words[i] END))) AS word FROM r),
  ranked AS (SELECT id, word, row_number() OVER (PARTITION BY word ORDER BY t, id) AS rk FROM words WHERE word IS NOT NULL AND id IN (SELECT id FROM r WHERE len(sig) > 0)),
  event AS (SELECT o.id, other AS parent, score FROM open o WHERE score >= 0.35 AND close AND id NOT IN (SELECT id FROM near) AND EXISTS (SELECT 1 FROM ranked x JOIN ranked y ON x.word = y.word WHERE x.id = o.id AND y.id = o.other AND x.rk - y.rk BETWEEN 1 AND 300)
    QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY score DESC, bt, other) = 1),
  chosen AS (SELECT r.id, coalesce(x.parent, n.parent, v.parent) AS parent, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN n.id IS NOT NULL THEN 'near' WHEN v.id IS NOT NULL THEN 'event' ELSE 'seed' END AS relation,
    CASE WHEN x.id IS NOT NULL THEN 1.0 ELSE coalesce(n.score, v.score) END AS similarity FROM r LEFT JOIN exact x ON r.id = x.id LEFT JOIN near n ON r.id = n.id LEFT JOIN event v ON r.id = v.id)"""


@query("report_stories", f"""WITH RECURSIVE {_R}, tree AS (SELECT id, id AS story FROM chosen WHERE parent IS NULL UNION ALL SELECT c.id, tree.story FROM tree JOIN chosen c ON c.parent = tree.id)
  SELECT id AS item_id, story, relation, similarity FROM chosen JOIN tree USING (id)""")
def _(spark, d):
    return clusters.stories(reports(spark, d))
