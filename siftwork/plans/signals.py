"""Queries of the radar's rules beyond the plain series, and of dates and texts, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import dates, stats, text
from siftwork.operators import archive, radar
from siftwork.plans.registry import END, ITEMS, query
from siftwork.plans.stories import POSTS
from siftwork.sources.adapters import items, posts, table

_PACED = "CAST(floor(date_diff('day', CAST(occurred_at AS DATE), DATE '2024-01-30') / 3.0) AS INTEGER)"


@query("paced_counts", f"""WITH {ITEMS}, w AS (SELECT theme AS key, {_PACED} AS back FROM items
  WHERE datesub('second', TIMESTAMP '2024-01-31' - INTERVAL 24 DAY, occurred_at) % (3 * 86400) < datesub('second', TIMESTAMP '2024-01-28', TIMESTAMP '2024-01-29 12:00:00'))
  SELECT key, {" || ',' || ".join(f"count(*) FILTER (back = {i})" for i in range(7, -1, -1))} AS counts FROM w WHERE back BETWEEN 0 AND 7 GROUP BY key""")
def _(spark, d):
    own = radar.paced_counts(items(spark, d), "theme", END, "2024-01-29 12:00:00", 3, 8)
    return own.select("key", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("debut_and_returning", f"""WITH {ITEMS}, g AS (SELECT story AS key, count(*) FILTER (occurred_at >= '2024-01-25' AND occurred_at < '2024-01-31') AS n, min(occurred_at) AS first_ever,
  count(*) FILTER (occurred_at < '2024-01-25' AND occurred_at >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAY) AS b FROM items GROUP BY 1)
  SELECT key, n, first_ever, first_ever >= '2024-01-25' AS debut, first_ever < '2024-01-25' AND b = 0 AS returning FROM g WHERE n > 0""")
def _(spark, d):
    return radar.history_of(items(spark, d), "story", "2024-01-25", "2024-01-31", 14)


@query("engagement_by_theme", f"""WITH {ITEMS}, g AS (SELECT theme, source, last(value ORDER BY occurred_at, item_id) FILTER (occurred_at >= '2024-01-20') AS now,
  coalesce(last(value ORDER BY occurred_at, item_id) FILTER (occurred_at < '2024-01-20'), first(value ORDER BY occurred_at, item_id) FILTER (occurred_at >= '2024-01-20')) AS was
  FROM items WHERE occurred_at < '2024-01-30' GROUP BY 1, 2) SELECT theme, count(*) AS items, round(sum(ln(1 + now - was)), 2) AS score FROM g WHERE now > was GROUP BY theme""")
def _(spark, d):
    return radar.gains(items(spark, d), "source", "theme", "2024-01-20", "2024-01-30")


#: Patterns that are planted in the items, for each rule to find: topics that are new, come back, are led by research or are all talk.
PLANTED = """NOT (k % 20 = 9 AND back > 0) AND NOT (k % 20 = 19 AND back BETWEEN 1 AND 7) AND NOT (k % 20 = 5 AND back > 0 AND item_id % 2 = 0 AND track NOT IN ('signup', 'purchase'))
  AND NOT (k % 20 = 3 AND back > 0 AND item_id % 2 = 0) AND NOT (k % 20 = 3 AND back = 0 AND item_id % 3 <> 0 AND track NOT IN ('signup', 'purchase'))"""
_TOPICS = f"""{ITEMS}, w AS (SELECT * FROM (SELECT *, date_diff('day', CAST(occurred_at AS DATE), DATE '2024-01-30') // 3 AS back FROM items) WHERE {PLANTED}), b AS (SELECT k AS key, max(back) AS oldest FROM w GROUP BY k), c AS (SELECT k AS key, {", ".join(f"count(*) FILTER (back = {i}) AS c{i}" for i in range(8))},
  count(DISTINCT source) FILTER (back = 0) AS sources, count(*) FILTER (back = 0 AND source % 20 = 0) AS home, count(*) FILTER (back = 0 AND track IN ('signup', 'purchase')) AS research,
  count(*) FILTER (back > 0 AND track IN ('signup', 'purchase')) AS base_research FROM w WHERE back BETWEEN 0 AND 7 GROUP BY 1),
  e AS (SELECT key, power(sum(n), 2) / sum(n * n) AS effective FROM (SELECT k AS key, source, count(*) AS n FROM w WHERE back = 0 GROUP BY 1, 2) GROUP BY key),
  m AS (SELECT c.*, coalesce(effective, 0) AS effective, (c1+c2+c3+c4+c5+c6+c7) / 7.0 AS mean, ({"+".join(f"(c{i}-c{i + 1})*(c{i}-c{i + 1})" for i in range(1, 7))}) / 12.0 AS noise FROM c LEFT JOIN e USING (key)),
  z AS (SELECT *, c0 AS now, c1+c2+c3+c4+c5+c6+c7 AS base_all, (c0 - mean) / sqrt(greatest(noise, mean, 1.0)) AS z FROM m), topics AS (SELECT z.*, oldest = 0 AS debut, oldest > 0 AND base_all = 0 AND now > 0 AS "returning", CASE WHEN c0 >= 3 AND mean = 0 THEN CASE WHEN sources >= 2 THEN 'new' ELSE 'steady' END
  WHEN c0 >= 3 AND round(z, 2) >= 2 AND c0 >= 1.5 * mean AND sources >= 2 THEN 'surging' WHEN c0 >= 3 AND round(z, 2) >= 1 THEN 'rising' WHEN mean >= 3 AND round(z, 2) <= -1 THEN 'falling' WHEN c0 >= 3 THEN 'steady' END AS state FROM z JOIN b USING (key))"""


def _topics(spark, d):
    every = items(spark, d).withColumn("back", F.floor(F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("occurred_at")) / 3)).where(PLANTED)
    own = every.where("back BETWEEN 0 AND 7")
    now, research = F.col("back") == 0, F.col("track").isin("signup", "purchase")
    counts = [F.count_if(F.col("back") == i).alias(f"c{i}") for i in range(8)]
    found = own.groupBy(F.col("k").alias("key")).agg(
        *counts, F.countDistinct(F.when(now, F.col("source"))).alias("sources"), F.count_if(now & (F.col("source") % 20 == 0)).alias("home"),
        F.count_if(now & research).alias("research"), F.count_if(~now & research).alias("base_research"),
    )
    by_source = own.where(now).groupBy(F.col("k").alias("key"), "source").agg(F.count(F.lit(1)).alias("n"))
    effective = by_source.groupBy("key").agg((F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("effective"))
    history = F.array(*[F.col(f"c{i}").cast("double") for i in range(7, 0, -1)])
    z = stats.count_z(F.col("c0"), F.col("history"))
    oldest = every.groupBy(F.col("k").alias("key")).agg(F.max("back").alias("oldest"))
    found = found.join(effective, "key", "left").join(oldest, "key").withColumn("history", history).withColumns({"z": z, "mean": stats.mean_of(F.col("history")), "effective": F.coalesce("effective", F.lit(0.0))})
    base = sum([F.col(f"c{i}") for i in range(2, 8)], F.col("c1"))
    state = stats.lifecycle(F.col("c0"), F.col("history"), F.round("z", 2), F.col("sources"))
    return found.withColumns({"state": state, "now": F.col("c0"), "all_now": F.col("c0"), "base_all": base, "windows": F.lit(7), "debut": F.col("oldest") == 0, "returning": (F.col("oldest") > 0) & (base == 0) & (F.col("c0") > 0)})


@query("signal_candidates", f"""WITH {_TOPICS}, t AS (SELECT *, (SELECT sum(home) / sum(now) FROM topics) AS rate, (SELECT sum(research) / sum(now) FROM topics) AS research_rate, (base_research + research) / (base_all + now) AS pooled FROM topics),
  u AS (SELECT *, CASE WHEN base_all > 0 AND now > 0 AND pooled > 0 AND pooled < 1 THEN (base_research / base_all - research / now) / sqrt(pooled * (1 - pooled) * (1 / base_all + 1 / now)) ELSE 0 END AS drop_z, base_research / nullif(base_all, 0) - research / nullif(now, 0) AS dropped, now - research AS chatter, (base_all - base_research) / 7.0 AS usual, base_research / 7.0 AS usual_research FROM t)
  SELECT 'surge' AS tone, key, round(z, 4) AS score FROM u WHERE state = 'surging' UNION ALL SELECT 'cool', key, round(-z, 4) FROM u WHERE state = 'falling'
  UNION ALL SELECT 'thin', key, round(z, 4) FROM u WHERE state IN ('surging', 'rising') AND effective < 2.5
  UNION ALL SELECT 'new', key, CAST(now AS DOUBLE) FROM u WHERE NOT "returning" AND sources >= 2 AND (state = 'new' OR (debut AND coalesce(state, '') <> 'falling'))
  UNION ALL SELECT 'back', key, CAST(now AS DOUBLE) FROM u WHERE "returning"
  UNION ALL SELECT 'early', key, round(z * (research + 10 * research_rate) / (now + 10), 4) FROM u WHERE now >= 5 AND z >= 1 AND research / now >= 0.5
  UNION ALL SELECT 'hype', key, round((chatter - usual) / sqrt(greatest(usual, 1.0)), 4) FROM u WHERE chatter >= 5 AND usual > 0 AND chatter >= 1.5 * usual AND (chatter - usual) / sqrt(greatest(usual, 1.0)) >= 2 AND (research - usual_research) / sqrt(greatest(usual_research, 1.0)) < 1
  UNION ALL SELECT 'gap', key, CAST(now AS DOUBLE) FROM u WHERE coalesce(state, '') <> 'falling' AND sources >= 2 AND home = 0 AND power(1 - least(greatest(rate, 0), 1), now) <= 0.05
  UNION ALL SELECT 'shift', key, round(drop_z, 4) FROM u WHERE now >= 5 AND base_all > 0 AND dropped >= 0.2 AND drop_z >= 2""")
def _(spark, d):
    return radar.signal_candidates(_topics(spark, d))


@query("keyword_pick", f"""WITH {_TOPICS} SELECT * FROM (SELECT key, 'live' AS why FROM topics WHERE now > 0 AND coalesce(state, '') <> 'falling' ORDER BY now DESC, key LIMIT 90)
  UNION ALL SELECT * FROM (SELECT key, 'falling' FROM topics WHERE state = 'falling' ORDER BY mean DESC, key LIMIT 12)""")
def _(spark, d):
    return radar.keyword_pick(_topics(spark, d))


@query("day_field_calendar", f"""WITH {ITEMS}, c AS (SELECT CAST(occurred_at AS DATE) AS day, field AS key, count(*) AS n FROM items GROUP BY 1, 2), days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT day, key, coalesce(n, 0) AS n FROM days CROSS JOIN (SELECT DISTINCT key FROM c) LEFT JOIN c USING (day, key)""")
def _(spark, d):
    return radar.calendar(items(spark, d), "field", "2024-01-01", "2024-01-31")


@query("theme_entries", f"WITH {ITEMS} SELECT theme, source AS actor, count(*) FILTER (occurred_at >= '2024-01-25') AS n FROM items GROUP BY 1, 2 HAVING min(occurred_at) >= '2024-01-25'")
def _(spark, d):
    return radar.entries(items(spark, d), "source", "theme", "2024-01-25")


@query("theme_leaders", f"""WITH {ITEMS}, c AS (SELECT theme, source AS actor, count(*) AS n FROM items GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, actor) AS place, sum(n) OVER (PARTITION BY theme) AS total FROM c)
  SELECT theme, actor, n, round(n / total, 4) AS share, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def _(spark, d):
    return radar.leaders(items(spark, d), "source", "theme")


@query("spike_keywords", f"""WITH {ITEMS}, e AS (SELECT CAST(occurred_at AS DATE) AS day, unnest(keywords) AS key FROM items WHERE CAST(occurred_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-29'),
  g AS (SELECT key, count(*) FILTER (day = DATE '2024-01-29') AS n, count(*) FILTER (day < DATE '2024-01-29') AS b FROM e GROUP BY key) SELECT key, n, round(n - b / 28, 4) AS lift FROM g WHERE n >= 3 ORDER BY lift DESC, key LIMIT 3""")
def _(spark, d):
    return radar.spikes(items(spark, d), "keywords", "2024-01-29")


@query("first_report_by_region", f"WITH {POSTS} SELECT story, min(occurred_at) FILTER (region = 'en') AS first_en, min(occurred_at) FILTER (region <> 'en') AS first_abroad, count(*) AS n FROM posts WHERE story IS NOT NULL GROUP BY story")
def _(spark, d):
    at = lambda c: F.min(F.when(c, F.col("occurred_at")))
    return posts(spark, d).where("story IS NOT NULL").groupBy("story").agg(at(F.col("region") == "en").alias("first_en"), at(F.col("region") != "en").alias("first_abroad"), F.count(F.lit(1)).alias("n"))


@query("plausible_dates", """WITH x AS (SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 45 % 2880 AS INTEGER)) AS p, TIMESTAMP '2024-01-01 12:00:00' AS seen, CASE WHEN lang = 'en' THEN 0 ELSE 540 END AS shift FROM documents)
  SELECT doc_id, CASE WHEN p <= seen + INTERVAL 15 MINUTE THEN p WHEN (p + to_minutes(shift) = date_trunc('day', p + to_minutes(shift)) OR p = date_trunc('day', p)) AND p <= seen + INTERVAL 1 DAY THEN p WHEN shift > 0 AND p - to_minutes(shift) <= seen + INTERVAL 15 MINUTE THEN p - to_minutes(shift) END AS at FROM x""")
def _(spark, d):
    told = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 45 % 2880 as int))")
    shift = F.when(F.col("lang") == "en", 0).otherwise(540)
    return table(spark, d, "documents").select("doc_id", dates.plausible(told, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), shift).alias("at"))


@query("parsed_dates", """SELECT o_orderkey, o_orderdate AS at FROM orders""")
def _(spark, d):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    told = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(t, "dd MMM yyyy HH:mm:ss")).when(k == 2, F.date_format(t, "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.unix_millis(t.cast("timestamp")).cast("string"))
    )
    return table(spark, d, "orders").select("o_orderkey", dates.parsed(told).alias("at"))


@query("title_grams", f"""WITH {POSTS}, w AS (SELECT item_id, string_split(lower(title), ' ') AS w FROM posts WHERE title <> ''), g AS (SELECT item_id, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w)
  SELECT item_id, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS digest FROM g""")
def _(spark, d):
    own = posts(spark, d).where("title <> ''").select("item_id", text.word_grams(F.split(F.lower("title"), " "), 3).alias("g"))
    return own.select("item_id", F.size("g").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"))


@query("titles_without_site", r"SELECT page_id, trim(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '\s+[|–—-]\s+[^|–—-]{1,40}$', ''), ' ') AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.without_site(text.page_title(F.col("html"))).alias("title"))


_TAILED = r"^(.+?)\s+(?:\||-|–|—|:|::|·)\s+([^|:–—·-]{2,40})$"


@query("titles_without_shared_tails", rf"""WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') || CASE page_id % 4 WHEN 0 THEN ' | Daily ' || page_id % 5 WHEN 1 THEN ' - Part ' || page_id WHEN 2 THEN ' : Daily ' || page_id % 5 ELSE '' END AS title FROM pages),
  t AS (SELECT *, CASE WHEN regexp_matches(title, '{_TAILED}') THEN regexp_extract(title, '{_TAILED}', 2) END AS tail FROM p), n AS (SELECT tail, count(*) AS n FROM t WHERE tail IS NOT NULL GROUP BY 1)
  SELECT page_id, CASE WHEN n > 1 THEN trim(regexp_extract(title, '{_TAILED}', 1), ' ') ELSE title END AS title FROM t LEFT JOIN n USING (tail)""")
def _(spark, d):
    """Titles with a site's name after them, or with a part's number, which is nobody else's."""
    k = F.col("page_id")
    end = F.when(k % 4 == 0, F.concat(F.lit(" | Daily "), (k % 5).cast("string"))).when(k % 4 == 1, F.concat(F.lit(" - Part "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit(" : Daily "), (k % 5).cast("string"))).otherwise("")
    return archive.without_shared_tails(table(spark, d, "pages").select("page_id", F.concat(text.page_title(F.col("html")), end).alias("title")), "title")


@query("placeholder_texts", r"SELECT doc_id, coalesce(regexp_matches(trim(text, ' '), '^[\p{P}\p{S}\s]*$') OR regexp_matches(trim(text, ' '), '^[A-Za-z0-9_.-]+$') OR regexp_matches(trim(text, ' '), '^(#[^\s#]+\s*)+$'), true) AS placeholder FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.placeholder(F.col("text")).alias("placeholder"))


@query("plain_page_texts", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ')) AS digest FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.plain_text(F.col("html"))).alias("digest"))


@query("paper_scores", "SELECT p_partkey, round(10 * (p_size % 4) + p_size + 5 * ln(1 + greatest(p_size * 3 % 17 - p_size % 11, 0)), 3) AS score FROM part")
def _(spark, d):
    growth = F.greatest(F.col("p_size") * 3 % 17 - F.col("p_size") % 11, F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.round(10 * (F.col("p_size") % 4) + F.col("p_size") + 5 * F.log1p(growth.cast("double")), 3).alias("score"))


@query("stable_keys", "SELECT page_id, CASE WHEN length(url || repeat('x', CAST(page_id % 3 * 300 AS INTEGER))) > 500 THEN 'sha256:' || sha256(url || repeat('x', CAST(page_id % 3 * 300 AS INTEGER))) ELSE url || repeat('x', CAST(page_id % 3 * 300 AS INTEGER)) END AS key FROM pages")
def _(spark, d):
    long = F.concat("url", F.repeat(F.lit("x"), (F.col("page_id") % 3 * 300).cast("int")))
    return table(spark, d, "pages").select("page_id", text.stable_key(long).alias("key"))
