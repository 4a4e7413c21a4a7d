"""All registered queries of the package, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import stats, text
from siftwork.operators import catalog, feed, radar
from siftwork.sources.adapters import deals, items, nodes, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The adapters in SQL.
ITEMS = """items AS (SELECT event_id AS item_id, ts AS occurred_at, user_id AS source, event_type AS track, value, k, k % 5 AS field, k % 20 AS theme,
  user_id * 100 + k AS story, list_distinct([k % 10, k % 7 + 10, k % 13 + 20]) AS keywords
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""
DEALS = """deals AS (SELECT o_orderkey AS deal_id, o_custkey AS actor, n_name AS nation, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
NODES = """nodes AS (SELECT c_custkey AS leaf, ['r' || n_regionkey, 'n' || c_nationkey, 'c' || c_custkey] AS path, 3 AS depth
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
END, START = "2024-01-31", "2024-01-08"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["feed_one_per_story"](spark, sf_dir)


_RANKED = "row_number() OVER (PARTITION BY story ORDER BY value DESC NULLS LAST, occurred_at DESC, item_id DESC)"


@query("feed_one_per_story", f"WITH {ITEMS} SELECT item_id, source, track, value, story, members FROM (SELECT *, {_RANKED} AS p, count(*) OVER (PARTITION BY story) AS members FROM items WHERE occurred_at < '{END}' AND occurred_at >= '{START}') WHERE p = 1")
def _(spark, d):
    return feed.one_row_per_story(items(spark, d).where(feed.in_window(START, END))).select("item_id", "source", "track", "value", "story", "members")


@query("feed_page", f"WITH {ITEMS} SELECT item_id, story, value FROM items ORDER BY value DESC NULLS LAST, item_id LIMIT 20 OFFSET 40")
def _(spark, d):
    return items(spark, d).orderBy(F.desc_nulls_last("value"), "item_id").offset(40).limit(20).select("item_id", "story", "value")


@query("facets_skip_own_axis", f"""WITH {ITEMS} SELECT 'field' AS axis, CAST(field AS VARCHAR) AS value, count(*) AS n FROM items WHERE track IN ('view', 'click') GROUP BY field
  UNION ALL SELECT 'track', track, count(*) FROM items WHERE field IN (1, 2) GROUP BY track
  UNION ALL SELECT 'theme', CAST(theme AS VARCHAR), count(*) FROM items WHERE field IN (1, 2) AND track IN ('view', 'click') GROUP BY theme""")
def _(spark, d):
    return feed.facets(items(spark, d), {"field": [1, 2], "track": ["view", "click"], "theme": None})


@query("insights_grouping_sets", f"""WITH {ITEMS} SELECT CASE WHEN grouping(field) = 0 THEN 'field' WHEN grouping(track) = 0 THEN 'track' ELSE 'all' END AS axis,
  CASE WHEN grouping(field) = 0 THEN CAST(field AS VARCHAR) WHEN grouping(track) = 0 THEN track END AS value, count(*) AS n
  FROM items GROUP BY GROUPING SETS ((field), (track), ())""")
def _(spark, d):
    return feed.insights(items(spark, d), ["field", "track"])


@query("keyword_counts", f"WITH {ITEMS} SELECT e AS element, count(*) AS n FROM (SELECT unnest(keywords) AS e FROM items) GROUP BY e")
def _(spark, d):
    return feed.element_counts(items(spark, d), "keywords")


@query("search_contains", "SELECT doc_id, lang FROM documents WHERE contains(lower(coalesce(text, '')), 'apache license') OR contains(lower(coalesce(source, '')), 'apache license')")
def _(spark, d):
    return feed.search(table(spark, d, "documents"), "Apache License", ["text", "source"]).select("doc_id", "lang")


@query("kpis_by_day", f"WITH {ITEMS} SELECT CAST(occurred_at + INTERVAL 9 HOUR AS DATE) AS bucket, count(*) AS items, count(DISTINCT story) AS stories, count(DISTINCT source) AS sources FROM items GROUP BY 1")
def _(spark, d):
    return feed.kpis(items(spark, d), F.to_date(F.col("occurred_at") + F.expr("INTERVAL 9 HOURS")))


@query("latest_per_item", f"WITH {ITEMS} SELECT source, item_id, value FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY occurred_at DESC, item_id DESC) AS p FROM items) WHERE p = 1")
def _(spark, d):
    return feed.latest_per_key(items(spark, d), "source", "occurred_at", "item_id").select("source", "item_id", "value")


@query("top_of_track_and_field", f"WITH {ITEMS} SELECT track, field, item_id, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY track, field ORDER BY value DESC NULLS LAST, item_id) AS p FROM items) WHERE p <= 12")
def _(spark, d):
    return feed.top_of_each(items(spark, d), ["track", "field"], [F.desc_nulls_last("value"), F.col("item_id")], 12).select("track", "field", "item_id", "place")


@query("explore_exploit_queue", f"""WITH {ITEMS}, best AS (SELECT item_id FROM items ORDER BY value DESC NULLS LAST, item_id LIMIT 90),
  fresh AS (SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM best) ORDER BY occurred_at DESC, item_id DESC LIMIT 10)
  SELECT item_id, 'score' AS why FROM best UNION ALL SELECT item_id, 'new' FROM fresh""")
def _(spark, d):
    return feed.explore_exploit(items(spark, d), 100)


@query("hash_sample", f"WITH {ITEMS} SELECT item_id, track FROM items ORDER BY md5('review' || item_id) LIMIT 50")
def _(spark, d):
    return feed.hash_sample(items(spark, d), "review", 50).select("item_id", "track")


_N = 8
_BACK = f"date_diff('day', CAST(occurred_at AS DATE), DATE '{END}' - INTERVAL 1 DAY) // 3"
_SERIES = f"""WITH {ITEMS}, w AS (SELECT *, {_BACK} AS w FROM items), c AS (
  SELECT theme AS key, {", ".join(f"count(*) FILTER (w = {i}) AS c{i}" for i in range(_N))}, count(DISTINCT source) FILTER (w = 0) AS sources
  FROM w WHERE w BETWEEN 0 AND 7 GROUP BY theme), s AS (
  SELECT *, ({"+".join(f"c{i}" for i in range(1, _N))}) / 7.0 AS mean, ({"+".join(f"(c{i}-c{i + 1})*(c{i}-c{i + 1})" for i in range(1, _N - 1))}) / 12.0 AS noise FROM c), z AS (
  SELECT *, (c0 - mean) / sqrt(greatest(noise, mean, 1.0)) AS z FROM s)
"""


@query("topic_series", _SERIES + """SELECT key, c0 AS now, c1 AS previous, sources, round(z, 4) AS z,
  CASE WHEN c0 >= 3 AND mean = 0 THEN CASE WHEN sources >= 2 THEN 'new' ELSE 'steady' END WHEN c0 >= 3 AND round(z, 2) >= 2 AND c0 >= 1.5 * mean AND sources >= 2 THEN 'surging'
  WHEN c0 >= 3 AND round(z, 2) >= 1 THEN 'rising' WHEN mean >= 3 AND round(z, 2) <= -1 THEN 'falling' WHEN c0 >= 3 THEN 'steady' END AS state, CASE WHEN c1 > 0 THEN round((c0 - c1) * 100.0 / c1, 1) END AS change FROM z""")
def _(spark, d):
    return radar.series(items(spark, d), "theme", END)


@query("effective_sources", f"WITH {ITEMS} SELECT key, round(power(sum(c), 2) / sum(c * c), 4) AS effective FROM (SELECT theme AS key, source, count(*) AS c FROM items GROUP BY 1, 2) GROUP BY key")
def _(spark, d):
    return radar.effective_sources(items(spark, d), "theme")


@query("normalised_share", f"""WITH {ITEMS}, c AS (SELECT track, theme AS key, least(count(*), 3) AS c FROM items GROUP BY track, theme, source, CAST(occurred_at AS DATE)),
  t AS (SELECT track, key, sum(c) AS c FROM c GROUP BY 1, 2), n AS (SELECT track, sum(c) AS total FROM t GROUP BY 1)
  SELECT key, round(sum(100.0 * c / total) / (SELECT count(*) FROM n), 4) AS share FROM t JOIN n USING (track) GROUP BY key""")
def _(spark, d):
    return radar.normalised_share(items(spark, d), "theme")


@query("keyword_lift", f"""WITH {ITEMS}, e AS (SELECT item_id, unnest(keywords) AS e FROM items), s AS (SELECT e, count(*) AS c FROM e GROUP BY e),
  p AS (SELECT x.e AS a, y.e AS b, count(*) AS together FROM e x JOIN e y ON x.item_id = y.item_id AND x.e < y.e GROUP BY 1, 2)
  SELECT a, b, together, round(together * (SELECT count(*) FROM items) / (sa.c * sb.c), 4) AS lift FROM p JOIN s sa ON a = sa.e JOIN s sb ON b = sb.e""")
def _(spark, d):
    return radar.lift(items(spark, d), "keywords")


@query("field_links", f"""WITH {ITEMS}, o AS (SELECT DISTINCT source, field FROM items)
  SELECT x.field AS a, y.field AS b, count(*) AS chains FROM o x JOIN o y ON x.source = y.source AND x.field < y.field GROUP BY 1, 2""")
def _(spark, d):
    return radar.category_links(items(spark, d), "source", "field")


@query("track_flows", f"""WITH {ITEMS}, f AS (SELECT story, track, min(occurred_at) AS t FROM items GROUP BY 1, 2), s AS (
  SELECT track, lead(track) OVER w AS nxt, t, lead(t) OVER w AS nt FROM f WINDOW w AS (PARTITION BY story ORDER BY t, track))
  SELECT track AS from_track, nxt AS to_track, count(*) AS steps, round(quantile_cont(datesub('second', t, nt), 0.5) / 3600.0, 1) AS lag_hours FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return radar.flows(items(spark, d))


@query("day_anomalies", f"""WITH {ITEMS}, c AS (SELECT CASE WHEN CAST(occurred_at AS DATE) = '2024-01-30' AND k % 3 = 0 THEN 0 ELSE theme END AS key, CAST(occurred_at AS DATE) AS day, count(*) AS n FROM items GROUP BY 1, 2),
  days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM c),
  f AS (SELECT k.key, days.day, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT key FROM c) k CROSS JOIN days LEFT JOIN c ON c.key = k.key AND c.day = days.day),
  l AS (SELECT *, list_filter([lag(n, 7) OVER w, lag(n, 14) OVER w, lag(n, 21) OVER w, lag(n, 28) OVER w], lambda x: x IS NOT NULL) AS h FROM f WINDOW w AS (PARTITION BY key ORDER BY day)),
  m AS (SELECT *, list_avg(h) AS mean FROM l WHERE len(h) = 4), z AS (SELECT *, (n - mean) / sqrt(greatest(mean, 1.0)) AS z FROM m)
  SELECT key, day, n, round(mean, 4) AS mean, round(z, 4) AS z FROM z WHERE z >= 3 AND n >= 2.5 * mean AND n >= 8 ORDER BY z.z DESC, key, day LIMIT 8""")
def _(spark, d):
    # One busy day: a third of what comes then is about theme 0.
    busy = (F.to_date("occurred_at") == F.lit("2024-01-30").cast("date")) & (F.col("k") % 3 == 0)
    return radar.day_anomalies(items(spark, d).withColumn("theme", F.when(busy, 0).otherwise(F.col("theme"))), "theme")


@query("metric_movers", f"""WITH {ITEMS}, o AS (SELECT source, last(value ORDER BY occurred_at, item_id) AS latest, last(value ORDER BY occurred_at, item_id) FILTER (occurred_at <= '2024-01-20') AS base,
  first(value ORDER BY occurred_at, item_id) AS f, count(*) AS n FROM items GROUP BY source)
  SELECT source, coalesce(base, f) AS baseline, latest, round(latest - coalesce(base, f), 4) AS delta FROM o WHERE n >= 2 ORDER BY delta DESC, source LIMIT 20""")
def _(spark, d):
    return radar.movers(items(spark, d), "2024-01-20", 20)


@query("first_reports", f"WITH {ITEMS} SELECT story AS key, min(occurred_at) AS debut FROM items GROUP BY 1 HAVING min(occurred_at) >= '2024-01-20'")
def _(spark, d):
    return radar.first_ever(items(spark, d), "story", "2024-01-20")


@query("share_z_by_theme", f"""WITH {ITEMS}, c AS (SELECT theme, count(*) FILTER (occurred_at >= '2024-01-16') AS x1, count(*) FILTER (occurred_at < '2024-01-16') AS x2 FROM items GROUP BY 1),
  t AS (SELECT *, sum(x1) OVER () AS n1, sum(x2) OVER () AS n2 FROM c)
  SELECT theme, CASE WHEN x1 + x2 > 0 THEN round((x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 4) ELSE 0 END AS z,
  round((x1 + 10.0 * 0.05) / (n1 + 10), 6) AS shrunk, round(power(1 - least(greatest(x2 / n2, 0), 1), 40), 6) AS zero_chance FROM t""")
def _(spark, d):
    late = F.col("occurred_at") >= F.lit("2024-01-16").cast("timestamp_ntz")
    own = items(spark, d).groupBy("theme").agg(F.count_if(late).alias("x1"), F.count_if(~late).alias("x2"))
    own = own.crossJoin(F.broadcast(own.agg(F.sum("x1").alias("n1"), F.sum("x2").alias("n2"))))  # one row
    x1, n1, x2, n2 = (F.col(c) for c in ("x1", "n1", "x2", "n2"))
    return own.select("theme", F.round(stats.two_proportion_z(x1, n1, x2, n2), 4).alias("z"), F.round(stats.shrunk_share(x1, n1, F.lit(0.05)), 6).alias("shrunk"), F.round(stats.zero_chance(F.lit(40), x2 / n2), 6).alias("zero_chance"))


@query("distribution_at_depth", f"WITH {NODES} SELECT path[least(2, depth)] AS node, count(*) AS n, round(sum(c_acctbal), 2) AS weight FROM nodes JOIN customer ON leaf = c_custkey GROUP BY 1")
def _(spark, d):
    tree = nodes(spark, d).join(table(spark, d, "customer"), F.col("leaf") == F.col("c_custkey"))
    return catalog.distribution(tree, F.col("c_acctbal"), 2)


@query("node_own_and_total", f"WITH {NODES}, e AS (SELECT unnest(path) AS node, path[-1] AS last FROM nodes) SELECT node, count(*) FILTER (node = last) AS own, count(*) AS total FROM e GROUP BY node")
def _(spark, d):
    return catalog.own_and_total(nodes(spark, d))


@query("subtree_leaves", f"WITH {NODES} SELECT leaf FROM nodes WHERE list_has_any(path, ['r1', 'n3'])")
def _(spark, d):
    return catalog.subtree(nodes(spark, d), ["r1", "n3"]).select("leaf")


@query("star_join_by_region", """SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(spark, d):
    places = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    own = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return table(spark, d, "orders").join(own, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("unlabelled_documents", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("items_of_active_sources", f"WITH {ITEMS} SELECT item_id FROM items WHERE source IN (SELECT source FROM items WHERE track = 'purchase' AND value > 100)")
def _(spark, d):
    own = items(spark, d)
    return own.join(own.where("track = 'purchase' AND value > 100").select("source"), "source", "left_semi").select("item_id")


@query("daily_cube", f"""WITH {DEALS}, e AS (SELECT day, deal_id, amount > 200000 AS flag, unnest([{{'dim': 'total', 'key': ''}}, {{'dim': 'kind', 'key': kind}}, {{'dim': 'nation', 'key': nation}}]) AS x FROM deals)
  SELECT day, x.dim AS dim, x.key AS key, count(DISTINCT deal_id) AS n, count(DISTINCT deal_id) FILTER (flag) AS n_flagged FROM e GROUP BY 1, 2, 3""")
def _(spark, d):
    return catalog.daily_cube(deals(spark, d), "day", ["kind", "nation"], "deal_id", F.col("amount") > 200000)


@query("top_and_rest_series", f"""WITH {DEALS}, c AS (SELECT nation AS key, year(day) AS bucket, count(*) AS n FROM deals GROUP BY 1, 2),
  t AS (SELECT key FROM c GROUP BY key ORDER BY sum(n) DESC, key LIMIT 8)
  SELECT CASE WHEN key IN (SELECT key FROM t) THEN key ELSE 'rest' END AS name, bucket, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2""")
def _(spark, d):
    return catalog.top_and_rest(deals(spark, d).withColumn("year", F.year("day").cast("long")), "nation", "year", 8)


_FLAGS = [f"c{i}" for i in range(1, 8)]


@query("window_flags", f"""WITH {ITEMS}, c AS (SELECT theme AS key, {", ".join(f"CAST(count(*) FILTER (b = {i}) AS DOUBLE) AS c{i}" for i in range(8))} FROM (SELECT *, {_BACK} AS b FROM items) WHERE b BETWEEN 0 AND 7 GROUP BY theme),
  m AS (SELECT *, ({"+".join(_FLAGS)}) / 7 AS mean FROM c), z AS (SELECT *, round((c0 - mean) / greatest(sqrt(({"+".join(f"power({c} - mean, 2)" for c in _FLAGS)}) / 7), sqrt(mean), 1.0), 2) AS z FROM m)
  SELECT key, CAST(c0 AS BIGINT) AS now, z, CASE WHEN z >= 2 AND c0 >= 3 THEN 'rise' WHEN z <= -2 AND mean >= 3 THEN 'fall' END AS flag FROM z""")
def _(spark, d):
    back = items(spark, d).withColumn("back", radar.window_of("occurred_at", END, 3, 8)).where("back IS NOT NULL")
    return catalog.window_flags(back.groupBy(F.col("theme").alias("key"), "back").agg(F.count(F.lit(1)).alias("n")))


@query("deal_stats", f"WITH {DEALS} SELECT kind, count(*) AS n, round(quantile_cont(amount, 0.5) FILTER (amount < 400000), 2) AS median, round(avg(amount) FILTER (amount < 400000), 2) AS mean, max(amount) FILTER (amount < 400000) AS largest FROM deals GROUP BY kind")
def _(spark, d):
    return catalog.deal_stats(deals(spark, d), ["kind"], 400000)


@query("weekly_deals", f"""WITH {DEALS}, w AS (SELECT CAST(unnest(generate_series(DATE '1994-12-26', DATE '1998-12-28', INTERVAL 7 DAY)) AS DATE) AS week),
  o AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, round(sum(amount), 2) AS amount FROM deals GROUP BY 1)
  SELECT week, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount FROM w LEFT JOIN o USING (week)""")
def _(spark, d):
    return catalog.weekly_spine(deals(spark, d), "1994-12-26", "1998-12-28")


_BOARD = "SELECT p_brand, p_type, p_partkey, {} AS score FROM lineitem JOIN part ON l_partkey = p_partkey {} GROUP BY ALL"


@query("leaderboard", f"""WITH s AS ({_BOARD.format("round(sum(l_quantity), 2)", "")}), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, p_partkey) AS o FROM s)
  SELECT p_brand, p_type, p_partkey, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INTEGER) AS place FROM b WHERE o = 1""")
def _(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return catalog.ranking(sold.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey"), "p_brand", "p_type", "score", "p_partkey")


def _places(spark: SparkSession, d: str) -> DataFrame:
    own = items(spark, d).withColumn("snapshot", F.weekofyear("occurred_at")).groupBy("snapshot", "track", "theme").agg(F.count(F.lit(1)).alias("score"))
    return catalog.ranking(own.withColumn("board", F.concat_ws("/", "snapshot", "track")), "board", "theme", "score", "theme")


_PLACES = f"""{ITEMS}, s AS (SELECT weekofyear(occurred_at) AS snapshot, track, theme, count(*) AS score FROM items GROUP BY 1, 2, 3),
  p AS (SELECT *, row_number() OVER (PARTITION BY snapshot, track ORDER BY score DESC, theme) AS place FROM s)"""


@query("leaderboard_changes", f"""WITH {_PLACES} SELECT n.track, n.theme, CAST(n.place AS INTEGER) AS place, CAST(b.place AS INTEGER) AS was,
  CASE WHEN b.place IS NULL THEN 'new' WHEN n.place < b.place THEN 'up' WHEN n.place > b.place THEN 'down' ELSE 'same' END AS moved
  FROM p n LEFT JOIN p b ON n.track = b.track AND n.theme = b.theme AND b.snapshot = 3 WHERE n.snapshot = 4 AND n.place <= 10""")
def _(spark, d):
    places = _places(spark, d)
    return catalog.rank_changes(places.where("snapshot = 4"), places.where("snapshot = 3"), ["track", "theme"], 10)


@query("leaderboard_holders", f"""WITH {_PLACES}, a AS (SELECT * FROM p WHERE track = 'view') SELECT theme, count(DISTINCT snapshot) AS held, CAST(max(place) AS INTEGER) AS worst FROM a
  WHERE place <= 18 GROUP BY theme HAVING count(DISTINCT snapshot) = (SELECT count(DISTINCT snapshot) FROM a)""")
def _(spark, d):
    return catalog.holders(_places(spark, d).where("track = 'view'"), "theme", "snapshot", 18)


@query("review_confusion", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp,
  count(*) FILTER (quality <> 1 AND toxic = 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels)
  SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM c""")
def _(spark, d):
    return catalog.confusion(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((F.col("n_chars") % 1000 / 1000.0).alias("score"), F.col("quality").alias("label"))


_SCORED = "s AS (SELECT n_chars % 1000 / 1000.0 AS score, quality AS label FROM labels JOIN documents USING (doc_id))"


@query("threshold_sweep", f"""WITH {_SCORED}, c AS (SELECT cut, count(*) FILTER (score >= cut AND label = 1) AS tp, count(*) FILTER (score >= cut) AS said, count(*) FILTER (label = 1) AS n
  FROM s, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS cut) GROUP BY cut)
  SELECT cut, CASE WHEN said > 0 THEN round(tp / said, 4) END AS precision, CASE WHEN n > 0 THEN round(tp / n, 4) END AS recall, CASE WHEN tp > 0 THEN round(2 * (tp / said) * (tp / n) / (tp / said + tp / n), 4) END AS f1 FROM c""")
def _(spark, d):
    return catalog.threshold_sweep(_scored(spark, d), [k / 10 for k in range(10)])


@query("auc", f"""WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s),
  t AS (SELECT sum(r) FILTER (label = 1) AS w, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM r) SELECT round((w - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM t""")
def _(spark, d):
    return catalog.auc(_scored(spark, d))


@query("source_prior", """WITH j AS (SELECT source, toxic FROM labels JOIN documents USING (doc_id)), b AS (SELECT avg(toxic) AS base FROM j)
  SELECT source, count(*) AS n, round((sum(toxic) + 5.0 * (SELECT base FROM b)) / (count(*) + 5), 4) AS prior FROM j GROUP BY source""")
def _(spark, d):
    return catalog.smoothed_prior(table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("source", "toxic"), "source", "toxic")


_COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) * list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"


@query("node_misfits", f"""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS a FROM e GROUP BY 1, 2),
  c AS (SELECT label, list(a ORDER BY i) AS centre FROM m GROUP BY label), s AS (SELECT label, vec_id, round({_COS.format("embedding", "centre")}, 5) AS similarity FROM embeddings JOIN c USING (label))
  SELECT label, vec_id, similarity, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity, vec_id) AS p FROM s) WHERE p <= 5""")
def _(spark, d):
    return catalog.misfits(table(spark, d, "embeddings"), "label", 5)


@query("nearest_vectors", f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id, round({_COS.format("embedding", "query")}, 5) AS similarity FROM embeddings JOIN q ON vec_id <> query_id)
  SELECT query_id, vec_id, similarity, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS p FROM s) WHERE p <= 10""")
def _(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return catalog.nearest(table(spark, d, "embeddings"), asked, 10)


@query("nearest_vectors_every_20th", f"""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id, round({_COS.format("embedding", "query")}, 5) AS similarity FROM embeddings JOIN q ON vec_id <> query_id)
  SELECT query_id, vec_id, similarity, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS p FROM s) WHERE p <= 5""")
def _(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return catalog.nearest(table(spark, d, "embeddings"), asked, 5)


@query("arrival_ledger", f"""WITH {ITEMS}, l AS (SELECT *, k % 3 AS c, lag(k % 3) OVER w AS was, row_number() OVER w AS nth FROM items WINDOW w AS (PARTITION BY source ORDER BY occurred_at, item_id)),
  m AS (SELECT *, CASE WHEN nth = 1 THEN 'new' WHEN c = was THEN 'unchanged' ELSE 'updated' END AS state FROM l)
  SELECT source, item_id, state, CAST(sum(CASE WHEN state = 'unchanged' THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY occurred_at, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM m""")
def _(spark, d):
    return catalog.ledger(items(spark, d), "source", "occurred_at", "item_id", F.col("k") % 3)


@query("downsample_snapshots", f"""WITH {ITEMS}, m AS (SELECT *, CASE WHEN a > 20 THEN CAST(date_trunc('week', occurred_at) AS DATE) WHEN a > 7 THEN CAST(occurred_at AS DATE) END AS slot
  FROM (SELECT *, date_diff('day', CAST(occurred_at AS DATE), DATE '{END}') AS a FROM items)), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, slot ORDER BY occurred_at DESC, item_id DESC) AS l, row_number() OVER (PARTITION BY source ORDER BY occurred_at, item_id) AS f FROM m)
  SELECT source, item_id FROM r WHERE slot IS NULL OR l = 1 OR f = 1""")
def _(spark, d):
    return catalog.downsample(items(spark, d), END, 7, 20)


@query("story_sizes", f"""WITH {ITEMS} SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' WHEN n <= 50 THEN '11-50' ELSE '51+' END AS size, count(*) AS groups
  FROM (SELECT story, count(*) AS n FROM items GROUP BY story) GROUP BY 1""")
def _(spark, d):
    return catalog.size_histogram(items(spark, d).groupBy("story").agg(F.count(F.lit(1)).alias("n")))


@query("quiet_sources", f"""WITH {ITEMS}, g AS (SELECT source, count(*) FILTER (k >= 3) AS empty_runs, max(CAST(occurred_at AS DATE)) FILTER (k < 3) AS last_day FROM items GROUP BY source)
  SELECT * FROM g WHERE empty_runs >= 10 AND coalesce(date_diff('day', last_day, DATE '{END}'), 99999) >= 7""")
def _(spark, d):
    return catalog.quiet_sources(items(spark, d), F.col("k") >= 3, END, 10, 7)


@query("share_of_total", f"WITH {ITEMS} SELECT track, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM items GROUP BY track")
def _(spark, d):
    own = items(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("total")))).select("track", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))  # one row


@query("value_percentiles", f"WITH {ITEMS} SELECT track, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM items GROUP BY track")
def _(spark, d):
    counted = items(spark, d).groupBy("track", "value").agg(F.count(F.lit(1)).alias("n"))  # so that a track's task holds distinct values only
    return counted.groupBy("track").agg(F.round(F.expr("percentile(value, 0.5, n)"), 4).alias("p50"), F.round(F.expr("percentile(value, 0.95, n)"), 4).alias("p95"))


@query("most_frequent_field", f"""WITH {ITEMS} SELECT theme, track, n FROM (SELECT theme, track, count(*) AS n, row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, track) AS p FROM items GROUP BY 1, 2) WHERE p = 1""")
def _(spark, d):
    own = items(spark, d).groupBy("theme", "track").agg(F.count(F.lit(1)).alias("n"))
    return feed.top_of_each(own, ["theme"], [F.desc("n"), F.col("track")], 1).select("theme", "track", "n")


@query("duplicate_groups", "SELECT md5(text) AS digest, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark, d):
    own = table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return own.where("n > 1")


@query("cross_track_chains", f"WITH {ITEMS} SELECT story, count(DISTINCT track) AS tracks, count(*) AS n FROM items GROUP BY story HAVING count(DISTINCT track) >= 2")
def _(spark, d):
    return items(spark, d).groupBy("story").agg(F.countDistinct("track").alias("tracks"), F.count(F.lit(1)).alias("n")).where("tracks >= 2")


@query("continuing_stories", f"WITH {ITEMS} SELECT theme, source, count(DISTINCT CAST(occurred_at AS DATE)) AS days FROM items WHERE occurred_at >= '2024-01-24' GROUP BY 1, 2 HAVING count(DISTINCT CAST(occurred_at AS DATE)) >= 2 ORDER BY days DESC, theme, source LIMIT 5")
def _(spark, d):
    own = items(spark, d).where(feed.in_window("2024-01-24", "2100-01-01"))
    return own.groupBy("theme", "source").agg(F.countDistinct(F.to_date("occurred_at")).alias("days")).where("days >= 2").orderBy(F.desc("days"), "theme", "source").limit(5)


@query("platform_z", f"""WITH {ITEMS}, v AS (SELECT item_id, track, ln(1 + greatest(value, 0) / greatest(datesub('second', occurred_at, TIMESTAMP '{END}') / 3600.0, 2)) AS v, track || theme AS platform FROM items WHERE value IS NOT NULL),
  s AS (SELECT platform, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM v GROUP BY platform), a AS (SELECT avg(v) AS am, stddev_pop(v) AS asd FROM v)
  SELECT item_id, round(CASE WHEN n >= 30 THEN CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END WHEN asd > 0 THEN (v - am) / asd ELSE 0 END, 4) AS z FROM v JOIN s USING (platform), a""")
def _(spark, d):
    return radar.platform_z(items(spark, d).where("value IS NOT NULL").withColumn("platform", F.concat("track", F.col("theme").cast("string"))), "platform", END)


@query("dotted_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.a.b[0]') AS missing FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.a.b[0]").alias("missing"))


@query("page_titles", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("truncated_texts", "SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 79), ' ') || '…' ELSE text END AS short FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 80).alias("short"))


_CANONICAL = f"""p AS (SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{text.TRACKING}'))) AS q FROM pages),
  c AS (SELECT page_id, scheme, CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS host, CASE WHEN path = '' THEN '/' ELSE path END AS path, q FROM p)"""


@query("dedup_urls", f"""WITH {_CANONICAL}, e AS (SELECT page_id, regexp_replace(regexp_replace(host, '^(m|mobile|amp)[.]', ''), '^www[.]', '') AS host, rtrim(regexp_replace(regexp_replace(path, '/amp/?$', ''), '^/amp/', '/'), '/') AS path,
  list_filter(q, lambda x: NOT regexp_matches(lower(x), '{text.AMP}')) AS q FROM c)
  SELECT page_id, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM e""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.dedup_url(F.col("url")).alias("u"))


@query("canonical_urls", f"WITH {_CANONICAL} SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u FROM c")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("u"))


@query("content_hashes", "SELECT doc_id, sha256(coalesce(text, '') || chr(31) || coalesce(lang, '')) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text"), F.col("lang")).alias("h"))


@query("normal_texts", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', ' ', 'g'), '[@#]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normal_text(F.col("text"))).alias("h"))


@query("keyword_keys", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: regexp_replace(regexp_replace(lower(trim(w)), '^#+', ''), '[ _·-]', '', 'g')), ' ') AS keys FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.split("p_name", " "), text.keyword_key), " ").alias("keys"))


@query("cited_identifiers", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(text, '([a-z0-9.]+@[a-z0-9]+\.[a-z0-9.]*[a-z])', 1), lambda x: 'email:' || x), list_transform(regexp_extract_all(text, '([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)', 1), lambda x: 'ip:' || x)))), ',') AS ids FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.identifiers(F.col("text")), ",").alias("ids"))


@query("period_keys", f"WITH {ITEMS} SELECT item_id, isoyear(t) || '-W' || lpad(CAST(weekofyear(t) AS VARCHAR), 2, '0') AS week, strftime(t, '%Y-%m') AS month, year(t) || '-Q' || quarter(t) AS quarter FROM (SELECT item_id, occurred_at + INTERVAL 9 HOUR AS t FROM items)")
def _(spark, d):
    t = F.col("t")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), t), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    own = items(spark, d).select("item_id", (F.col("occurred_at") + F.expr("INTERVAL 9 HOURS")).alias("t"))
    return own.select("item_id", week.alias("week"), F.date_format(t, "yyyy-MM").alias("month"), F.concat(F.year(t), F.lit("-Q"), F.quarter(t)).alias("quarter"))


# The other modules of queries add themselves.
from siftwork.plans import archive, clusters, deals as _deals, digests, models, refresh, sections, signals, states, stories, taxonomy  # noqa: E402, F401
