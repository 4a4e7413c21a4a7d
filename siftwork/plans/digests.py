"""Queries of siftwork.operators.digest with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import digest
from siftwork.plans.registry import DEALS, ITEMS, query
from siftwork.plans.stories import POSTS
from siftwork.sources.adapters import deals, items, posts, table

_LABELLED = f"{POSTS}, labelled AS (SELECT posts.*, quality, toxic FROM posts LEFT JOIN labels ON item_id = doc_id)"


def _labelled(spark, d):
    return posts(spark, d).join(table(spark, d, "labels"), F.col("item_id") == F.col("doc_id"), "left").drop("doc_id")


@query("publishable_items", f"WITH {_LABELLED} SELECT item_id FROM labelled WHERE trim(title) <> '' AND trim(text) <> '' AND outlet IS NOT NULL AND coalesce(toxic, 0) = 0")
def _(spark, d):
    own = _labelled(spark, d)
    return own.where(digest.publishable(own)).select("item_id")


@query("scoped_fresh_items", f"""WITH {_LABELLED} SELECT item_id, track FROM labelled WHERE (quality = 1 OR quality IS NULL) AND region IN ('en', 'fr')
  AND (occurred_at IS NULL OR occurred_at >= TIMESTAMP '2024-01-01' + to_days(CAST(item_id % 60 AS INTEGER)) - INTERVAL 30 DAY)""")
def _(spark, d):
    seen = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(item_id % 60 as int))")
    own = _labelled(spark, d).where("(quality = 1 OR quality IS NULL) AND region IN ('en', 'fr')")
    return own.where(digest.fresh(F.col("occurred_at"), seen, 30)).select("item_id", "track")


_STATE = "CASE WHEN trim(title) = '' THEN 'empty' WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'excluded' WHEN relevance < 20 THEN 'minor' ELSE 'ready' END"


@query("item_states", f"WITH {_LABELLED} SELECT {_STATE} AS state, count(*) AS n FROM labelled GROUP BY 1")
def _(spark, d):
    state = digest.state_of(F.col("title"), F.col("quality"), F.col("toxic"), F.col("relevance"))
    return _labelled(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("progress_by_day", f"""WITH {_LABELLED}, days AS (SELECT CAST(unnest(generate_series(min(CAST(occurred_at AS DATE)), max(CAST(occurred_at AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM labelled),
  c AS (SELECT CAST(occurred_at AS DATE) AS day, count(*) FILTER (s = 'ready') AS ready, count(*) FILTER (s = 'rejected') AS rejected, count(*) AS n FROM (SELECT *, {_STATE} AS s FROM labelled) GROUP BY 1)
  SELECT day, coalesce(ready, 0) AS ready, coalesce(rejected, 0) AS rejected, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (day)""")
def _(spark, d):
    own = _labelled(spark, d).withColumn("day", F.to_date("occurred_at"))
    state = digest.state_of(F.col("title"), F.col("quality"), F.col("toxic"), F.col("relevance"))
    counts = own.groupBy("day").agg(F.count_if(state == "ready").alias("ready"), F.count_if(state == "rejected").alias("rejected"), F.count(F.lit(1)).alias("n"))
    days = own.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(counts, "day", "left").fillna(0, ["ready", "rejected", "n"])


_EVIDENCE = f"""{POSTS}, n AS (SELECT story, count(DISTINCT outlet) AS story_outlets FROM posts WHERE story IS NOT NULL GROUP BY story), evidence AS (SELECT item_id % 40 AS claim, outlet, track, region,
  ends_with(outlet, '1') AS vendor, coalesce(story_outlets, 1) AS story_outlets FROM posts LEFT JOIN n USING (story))"""


@query("evidence_strength", f"""WITH {_EVIDENCE}, g AS (SELECT claim, greatest(count(DISTINCT outlet), max(story_outlets)) AS outlets, count(DISTINCT track) AS tracks, count(DISTINCT region) AS regions, round(avg(CAST(vendor AS INTEGER)), 2) AS vendor_share FROM evidence GROUP BY claim)
  SELECT *, CASE WHEN outlets <= 2 OR vendor_share = 1 THEN 'weak' WHEN outlets >= 5 AND (tracks >= 2 OR regions >= 2) AND vendor_share < 0.5 THEN 'strong' ELSE 'medium' END AS grade FROM g""")
def _(spark, d):
    own = posts(spark, d)
    width = own.where("story IS NOT NULL").groupBy("story").agg(F.countDistinct("outlet").alias("story_outlets"))
    evidence = own.join(width, "story", "left").withColumns({"claim": F.col("item_id") % 40, "vendor": F.col("outlet").endswith("1"), "story_outlets": F.coalesce("story_outlets", F.lit(1))})
    return digest.strength(evidence, "claim")


@query("publication_gates", f"""WITH {_LABELLED}, m AS (SELECT CAST(count(*) AS DOUBLE) AS items, CAST(count(DISTINCT outlet) AS DOUBLE) AS outlets, CAST(count(DISTINCT track) AS DOUBLE) AS tracks, avg(CASE WHEN region <> 'en' THEN 1.0 ELSE 0.0 END) AS abroad FROM labelled WHERE quality = 1)
  SELECT g.gate AS gate, round(g.value, 4) AS value, g.least AS least, g.value >= g.least AS passed FROM (SELECT unnest([{{'gate': 'items', 'value': items, 'least': 50.0::DOUBLE}}, {{'gate': 'outlets', 'value': outlets, 'least': 5.0::DOUBLE}}, {{'gate': 'tracks', 'value': tracks, 'least': 4.0::DOUBLE}}, {{'gate': 'abroad', 'value': abroad, 'least': 0.15::DOUBLE}}]) AS g FROM m)""")
def _(spark, d):
    abroad = F.avg(F.when(F.col("region") != "en", 1.0).otherwise(0.0))
    return digest.gates(_labelled(spark, d).where("quality = 1"), {"items": (F.count(F.lit(1)), 50), "outlets": (F.countDistinct("outlet"), 5), "tracks": (F.countDistinct("track"), 4), "abroad": (abroad, 0.15)})


_PICK = f"""{POSTS}, r AS (SELECT *, CAST(date_trunc('week', occurred_at) AS DATE) AS week, row_number() OVER (PARTITION BY date_trunc('week', occurred_at) ORDER BY relevance DESC NULLS LAST, item_id) AS p FROM posts)"""


@query("weekly_quota_pick", f"WITH {_PICK} SELECT item_id, week, CASE WHEN p <= 4 THEN 'week' ELSE 'rest' END AS pick FROM r ORDER BY CASE WHEN p <= 4 THEN 0 ELSE 1 END, relevance DESC NULLS LAST, item_id LIMIT 110")
def _(spark, d):
    return digest.weekly_pick(posts(spark, d), "relevance", "occurred_at", "item_id", 4, 110).select("item_id", "week", "pick")


@query("sustained_stories", f"""WITH {POSTS}, g AS (SELECT story, count(DISTINCT CAST(occurred_at AS DATE)) AS days, count(DISTINCT outlet) AS outlets, count(*) FILTER (track = 'community') AS community FROM posts
  WHERE story IS NOT NULL AND occurred_at < '2024-02-01' AND occurred_at >= TIMESTAMP '2024-02-01' - INTERVAL 21 DAY GROUP BY story) SELECT *, outlets * 100 + community * 10 + days * 20 AS score FROM g WHERE days >= 2""")
def _(spark, d):
    return digest.sustained(posts(spark, d), "2024-02-01", 21, 2)


@query("mention_counts", f"WITH {POSTS} SELECT a.item_id, count(b.item_id) AS mentions FROM posts a LEFT JOIN posts b ON b.track = 'community' AND (a.story = b.story OR (a.title = b.title AND a.title <> '')) WHERE a.track <> 'community' GROUP BY a.item_id")
def _(spark, d):
    return digest.mentions(posts(spark, d))


@query("evidence_scores", f"""WITH {POSTS}, n AS (SELECT story, count(DISTINCT outlet) AS covered FROM posts WHERE story IS NOT NULL GROUP BY story)
  SELECT item_id, round(0.15 * least(item_id % 5, 3) / 3 + 0.15 * least(log10(greatest(coalesce(covered, 1), 1)) / log10(20), 1) + 0.1 * relevance / 100, 6) AS score FROM posts LEFT JOIN n USING (story)""")
def _(spark, d):
    own = posts(spark, d)
    width = own.where("story IS NOT NULL").groupBy("story").agg(F.countDistinct("outlet").alias("covered"))
    words = F.least(F.col("item_id") % 5, F.lit(3))
    covered = F.least(F.log10(F.greatest(F.coalesce("covered", F.lit(1)), F.lit(1)).cast("double")) / F.log10(F.lit(20.0)), F.lit(1.0))
    return own.join(width, "story", "left").select("item_id", F.round(0.15 * words / 3 + 0.15 * covered + 0.1 * F.col("relevance") / 100, 6).alias("score"))


@query("relevance_scores", f"""WITH {POSTS}, n AS (SELECT story, count(DISTINCT outlet) AS covered FROM posts WHERE story IS NOT NULL GROUP BY story)
  SELECT item_id, round(coalesce(relevance, 50) + 12 * log2(1 + coalesce(covered, 1)) + CASE WHEN outlet = 'src1' THEN 5 ELSE 0 END, 6) AS score FROM posts LEFT JOIN n USING (story)""")
def _(spark, d):
    own = posts(spark, d)
    width = own.where("story IS NOT NULL").groupBy("story").agg(F.countDistinct("outlet").alias("covered"))
    score = F.coalesce("relevance", F.lit(50)) + 12 * F.log2(1.0 + F.coalesce("covered", F.lit(1))) + F.when(F.col("outlet") == "src1", 5).otherwise(0)
    return own.join(width, "story", "left").select("item_id", F.round(score, 6).alias("score"))


@query("source_quality", f"""WITH {_LABELLED} SELECT outlet, count(*) AS items, count(quality) AS classified, count(*) FILTER (quality = 1) AS relevant, count(*) FILTER (toxic = 1) AS failed,
  CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (quality = 1) / count(quality), 4) END AS relevant_share FROM labelled GROUP BY outlet""")
def _(spark, d):
    relevant, classified = F.count_if(F.col("quality") == 1), F.count("quality")
    return _labelled(spark, d).groupBy("outlet").agg(
        F.count(F.lit(1)).alias("items"), classified.alias("classified"), relevant.alias("relevant"), F.count_if(F.col("toxic") == 1).alias("failed"),
        F.round(F.try_divide(relevant, classified), 4).alias("relevant_share"),
    )


@query("nearest_rank_p95", f"WITH {ITEMS}, r AS (SELECT track, value, row_number() OVER (PARTITION BY track ORDER BY value) AS p, count(*) OVER (PARTITION BY track) AS n FROM items WHERE value IS NOT NULL) SELECT track, n, value FROM r WHERE p = CAST(ceil(n * 0.95) AS BIGINT)")
def _(spark, d):
    return digest.nearest_rank(items(spark, d), "track", "value", 0.95)


@query("label_of_key", "WITH c AS (SELECT substr(p_name, 1, 3) AS key, p_name AS label, count(*) AS n FROM part GROUP BY 1, 2) SELECT key, label, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS p FROM c) WHERE p = 1")
def _(spark, d):
    return digest.most_common(table(spark, d, "part"), F.substring("p_name", 1, 3), "p_name")


@query("unknown_name_candidates", f"""WITH {ITEMS} SELECT track || '-' || theme AS name, count(*) AS n, count(DISTINCT source) AS sources FROM items GROUP BY 1
  HAVING count(*) >= 3 AND count(DISTINCT source) >= 2 AND name NOT IN (SELECT track || '-' || theme FROM items WHERE theme < 10)""")
def _(spark, d):
    own = items(spark, d).withColumn("name", F.concat_ws("-", "track", "theme"))
    return digest.unknown_names(own, "name", own.where("theme < 10").select("name").distinct(), 3, 2)


@query("watch_hits", f"""WITH {ITEMS}, e AS (SELECT item_id, 'k' || unnest(list_filter(keywords, lambda x: x IN (3, 12, 25))) AS word FROM items), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY item_id DESC) AS p, count(*) OVER (PARTITION BY word) AS n FROM e)
  SELECT word, max(n) AS n, string_agg(item_id, ',' ORDER BY item_id DESC) FILTER (p <= 3) AS ids FROM r GROUP BY word""")
def _(spark, d):
    own = items(spark, d).withColumn("words", F.transform("keywords", lambda k: F.concat(F.lit("k"), k.cast("string"))))
    return digest.watch_hits(own, "words", ["k3", "k12", "k25"], "item_id")


@query("changed_days", f"""WITH {ITEMS} SELECT DATE '2024-01-30' - CAST(i AS INTEGER) AS day FROM range(3) t(i) UNION SELECT CAST(occurred_at AS DATE) FROM items WHERE item_id % 7 = 0 AND occurred_at >= '2024-01-20'""")
def _(spark, d):
    own = items(spark, d).where("item_id % 7 = 0").withColumn("changed", F.col("occurred_at"))
    return digest.changed_days(own, "occurred_at", "changed", "2024-01-20", "2024-01-30")


@query("weighted_category_mean", """WITH m AS (SELECT p_brand AS model, p_type AS category, avg(p_retailprice) AS mean FROM part GROUP BY 1, 2), w AS (SELECT DISTINCT p_type AS category, length(p_type) AS weight FROM part WHERE p_type <> 'ECONOMY')
  SELECT model, round(sum(mean * weight) / sum(weight), 4) AS overall, round(sum(weight) / (SELECT sum(weight) FROM w), 4) AS coverage FROM m JOIN w USING (category) GROUP BY model""")
def _(spark, d):
    part = table(spark, d, "part")
    weights = part.where("p_type <> 'ECONOMY'").select(F.col("p_type").alias("category")).distinct().withColumn("weight", F.length("category"))
    return digest.weighted_mean(part.select(F.col("p_brand").alias("model"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("score")), weights)


@query("folded_turns", "WITH s AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS event FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)) SELECT conv_id, CAST(event AS BIGINT) AS event, count(*) AS lines, min(turn) AS first FROM s GROUP BY 1, 2")
def _(spark, d):
    return digest.folded_lines(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query("poll_intervals", f"""WITH {ITEMS}, g AS (SELECT source, count(*) AS n, count(*) FILTER (k < 3) AS fresh FROM items GROUP BY source)
  SELECT source, round(least(greatest(CASE WHEN fresh >= 5 THEN 300.0 WHEN fresh = 0 THEN n * 60 * 1.5 ELSE n * 60 / 1.5 END, 300), 7200), 4) AS seconds FROM g""")
def _(spark, d):
    own = items(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < 3).alias("fresh"))
    return own.select("source", F.round(digest.next_interval(F.col("n") * 60.0, F.col("fresh") == 0, F.col("fresh"), 300.0, 7200.0), 4).alias("seconds"))


@query("alert_changes", f"""WITH {ITEMS}, a AS (SELECT DISTINCT source FROM items WHERE track = 'error' AND value > 60 AND occurred_at >= '2024-01-20'), b AS (SELECT DISTINCT source FROM items WHERE track = 'error' AND value > 60 AND occurred_at < '2024-01-20')
  SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'opened' WHEN a.source IS NULL THEN 'closed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.source = b.source""")
def _(spark, d):
    own = items(spark, d).where("track = 'error' AND value > 60")
    late = F.col("occurred_at") >= F.lit("2024-01-20").cast("timestamp_ntz")
    return digest.alert_changes(own.where(late).select("source").distinct(), own.where(~late).select("source").distinct(), "source")


_TREE = """e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


@query("tree_paths", f"WITH RECURSIVE {_TREE}, p AS (SELECT node, [node] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.node, list_append(p.path, e.node) FROM e JOIN p ON e.parent = p.node) SELECT node, array_to_string(path, '/') AS path, len(path) AS depth FROM p")
def _(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, d, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    edges = edges.union(table(spark, d, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    edges = edges.union(table(spark, d, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))
    return digest.paths_of(edges).select("node", F.array_join("path", "/").alias("path"), "depth")


@query("board_counts", f"""WITH {_LABELLED}, x AS (SELECT *, CASE WHEN toxic = 1 THEN 'risk' WHEN quality = 1 THEN 'opportunity' ELSE 'watch' END AS impact FROM labelled), r AS (SELECT *, row_number() OVER (PARTITION BY track, impact ORDER BY relevance DESC, item_id) AS p FROM x)
  SELECT track, impact, count(*) AS n, string_agg(item_id, ',' ORDER BY relevance DESC, item_id) FILTER (p <= 2) AS evidence FROM r GROUP BY 1, 2""")
def _(spark, d):
    impact = F.when(F.col("toxic") == 1, "risk").when(F.col("quality") == 1, "opportunity").otherwise("watch")
    own = _labelled(spark, d).withColumn("impact", impact)
    best = digest.top_rows(own, ["track", "impact"], [F.desc("relevance"), F.col("item_id")], 2).groupBy("track", "impact").agg(F.array_sort(F.collect_list(F.struct("place", "item_id"))).alias("best"))
    best = best.select("track", "impact", F.array_join(F.transform("best", lambda x: x["item_id"].cast("string")), ",").alias("evidence"))
    return own.groupBy("track", "impact").agg(F.count(F.lit(1)).alias("n")).join(best, ["track", "impact"])


@query("maturity_index", f"""WITH {DEALS} SELECT nation, count(*) AS cards, round(avg(stage), 4) AS maturity, count(*) FILTER (stage = 4) AS top_stage FROM (SELECT nation, CASE kind WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 1 END AS stage FROM deals) WHERE stage IS NOT NULL GROUP BY nation HAVING count(*) >= 8""")
def _(spark, d):
    stages = F.create_map(*[F.lit(x) for pair in {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1, "5-LOW": 1}.items() for x in pair])
    own = deals(spark, d).withColumn("stage", stages[F.col("kind")]).where("stage IS NOT NULL")
    return own.groupBy("nation").agg(F.count(F.lit(1)).alias("cards"), F.round(F.avg("stage"), 4).alias("maturity"), F.count_if(F.col("stage") == 4).alias("top_stage")).where("cards >= 8")


@query("review_buckets", f"""WITH {_LABELLED} SELECT outlet, count(*) AS reviewed, count(*) FILTER (quality = 1) AS relevant, count(*) FILTER (quality = 0) AS irrelevant FROM labelled WHERE quality IS NOT NULL GROUP BY outlet ORDER BY irrelevant DESC, outlet LIMIT 10""")
def _(spark, d):
    own = _labelled(spark, d).where("quality IS NOT NULL").groupBy("outlet").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("quality") == 1).alias("relevant"), F.count_if(F.col("quality") == 0).alias("irrelevant"))
    return own.orderBy(F.desc("irrelevant"), "outlet").limit(10)


@query("access_usage", f"""WITH {ITEMS} SELECT source, count(*) FILTER (track = 'view') AS views, count(*) FILTER (track = 'click') AS clicks, count(*) FILTER (track = 'signup') AS logins, count(DISTINCT k) AS addresses, last(k ORDER BY occurred_at, item_id) AS last_address FROM items GROUP BY source""")
def _(spark, d):
    kind = lambda t: F.count_if(F.col("track") == t)
    return items(spark, d).groupBy("source").agg(kind("view").alias("views"), kind("click").alias("clicks"), kind("signup").alias("logins"), F.countDistinct("k").alias("addresses"), F.max_by("k", F.struct("occurred_at", "item_id")).alias("last_address"))


@query("portfolio_gaps", f"""WITH {POSTS}, g AS (SELECT track, count(*) AS n, count(*) FILTER (region <> 'en') AS abroad FROM posts GROUP BY track)
  SELECT track, n, greatest(300 - n, 0) AS missing, round(abroad / n, 4) AS abroad, abroad / n < 0.4 AS below FROM g""")
def _(spark, d):
    own = posts(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("region") != "en").alias("a"))
    share = F.col("a") / F.col("n")
    return own.select("track", "n", F.greatest(300 - F.col("n"), F.lit(0)).alias("missing"), F.round(share, 4).alias("abroad"), (share < 0.4).alias("below"))


@query("topic_candidates", f"""WITH {POSTS}, w AS (SELECT DISTINCT item_id, outlet, lower(t[i] || ' ' || t[i + 1]) AS phrase FROM (SELECT item_id, outlet, string_split(title, ' ') AS t, unnest(range(1, len(string_split(title, ' ')))) AS i FROM posts) WHERE i < len(t) AND length(t[i]) > 0 AND length(t[i + 1]) > 0)
  SELECT phrase, count(*) AS n, count(DISTINCT outlet) AS outlets FROM w GROUP BY phrase HAVING count(*) >= 2""")
def _(spark, d):
    own = posts(spark, d).select("item_id", "outlet", F.split("title", " ").alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.when((F.coalesce(F.get("t", i - 1), F.lit("")) != "") & (F.coalesce(F.get("t", i), F.lit("")) != ""), F.lower(F.concat(F.get("t", i - 1), F.lit(" "), F.get("t", i)))))
    found = own.select("item_id", "outlet", F.explode(pairs).alias("phrase")).where("phrase IS NOT NULL").distinct()
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("outlet").alias("outlets")).where("n >= 2")


@query("expired_bodies", f"WITH {POSTS} SELECT item_id, CASE WHEN occurred_at + INTERVAL 30 DAY <= TIMESTAMP '2024-02-15' THEN NULL ELSE length(text) END AS kept_chars, CASE WHEN region = 'en' THEN least(length(text), 500) ELSE 0 END AS excerpt_chars FROM posts")
def _(spark, d):
    gone = F.col("occurred_at") + F.expr("INTERVAL 30 DAYS") <= F.lit("2024-02-15").cast("timestamp_ntz")
    return posts(spark, d).select("item_id", F.when(~gone, F.length("text")).alias("kept_chars"), F.when(F.col("region") == "en", F.least(F.length("text"), F.lit(500))).otherwise(0).alias("excerpt_chars"))
