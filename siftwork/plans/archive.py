"""Queries of siftwork.operators.archive with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import archive, catalog, digest
from siftwork.plans.registry import ITEMS, NODES, query
from siftwork.plans.stories import POSTS
from siftwork.sources.adapters import items, nodes, posts, table


@query("latest_versions", "SELECT l_partkey, last(l_orderkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS l_orderkey, count(*) AS versions FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("version"))
    return archive.latest_versions(rows, "l_partkey", "version").select("l_partkey", "l_orderkey", "versions")


@query("text_of_positions", f"WITH {POSTS} SELECT item_id, array_to_string(string_split(title, ' '), ' ') AS text FROM posts WHERE title <> ''")
def _(spark, d):
    words = posts(spark, d).where("title <> ''").select("item_id", F.posexplode(F.split("title", " ")).alias("pos", "word"))
    inverted = words.groupBy("item_id", "word").agg(F.collect_list("pos").alias("positions"))
    return archive.text_of_positions(inverted, "item_id")


@query("card_donors", f"""WITH {POSTS}, g AS (SELECT story, min(item_id) FILTER (relevance >= 50) AS donor FROM posts WHERE story IS NOT NULL GROUP BY story) SELECT item_id, donor FROM posts JOIN g USING (story) WHERE relevance < 50 AND donor IS NOT NULL""")
def _(spark, d):
    return archive.donors(posts(spark, d).where("story IS NOT NULL"), "story", "item_id", F.col("relevance") >= 50)


_BRANCHES = f"""{POSTS}, b AS (SELECT item_id, region AS label, 0 AS branch FROM posts WHERE relevance > 70 UNION ALL SELECT item_id, track, 1 FROM posts WHERE relevance > 30 UNION ALL SELECT item_id, region, 2 FROM posts UNION ALL SELECT item_id, outlet, 3 FROM posts WHERE item_id % 2 = 0)"""


def _branches(spark, d):
    own = posts(spark, d)
    label = lambda df, c: df.select("item_id", F.col(c).alias("label"))
    return [label(own.where("relevance > 70"), "region"), label(own.where("relevance > 30"), "track"), label(own, "region"), label(own.where("item_id % 2 = 0"), "outlet")]


@query("relabelled_items", f"WITH {_BRANCHES} SELECT item_id, label, min(branch) AS branch FROM b GROUP BY 1, 2")
def _(spark, d):
    return archive.relabelled(_branches(spark, d), "item_id")


@query("implied_labels", f"WITH {NODES} SELECT DISTINCT c_custkey, unnest(path) AS label FROM customer JOIN nodes ON leaf = c_custkey WHERE c_acctbal > 0")
def _(spark, d):
    own = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("label"))
    paths = nodes(spark, d).select(F.element_at("path", -1).alias("node"), "path")
    return archive.implied(own, paths, "c_custkey")


@query("remapped_themes", f"""WITH {ITEMS} SELECT item_id, array_to_string(CASE WHEN theme < 8 THEN [theme + 100] ELSE list_sort(keywords)[1:2] END, ',') AS labels FROM items""")
def _(spark, d):
    own = items(spark, d)
    mapping = own.where("theme < 8").select(F.col("theme").alias("old_label"), (F.col("theme") + 100).alias("new_label")).distinct()
    return archive.remapped(own, "theme", mapping, F.array_sort("keywords")).select("item_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("due_items", f"""WITH {POSTS}, x AS (SELECT *, CASE WHEN item_id % 3 <> 0 THEN occurred_at + INTERVAL 1 DAY END AS asked FROM posts)
  SELECT item_id FROM x WHERE coalesce(asked IS NULL OR (relevance > 80 AND asked < TIMESTAMP '2024-02-20') OR asked < TIMESTAMP '2024-01-15' OR (region = 'de' AND asked < TIMESTAMP '2024-02-01'), false) ORDER BY asked NULLS FIRST, item_id LIMIT 100""")
def _(spark, d):
    own = posts(spark, d).withColumn("asked", F.when(F.col("item_id") % 3 != 0, F.col("occurred_at") + F.expr("INTERVAL 1 DAY")))
    before = lambda t: F.col("asked") < F.lit(t).cast("timestamp_ntz")
    rules = [F.col("asked").isNull(), (F.col("relevance") > 80) & before("2024-02-20"), before("2024-01-15"), (F.col("region") == "de") & before("2024-02-01")]
    return archive.due(own, "asked", "2024-03-01", rules, 100).select("item_id")


@query("steady_coverage", f"""WITH {POSTS}, s AS (SELECT track, CAST(date_diff('day', CAST(occurred_at AS DATE), DATE '2024-02-29') // 15 AS INTEGER) AS w, avg(CASE WHEN relevance > 20 THEN 1.0 ELSE 0.0 END) AS share FROM posts GROUP BY 1, 2)
  SELECT track, coalesce(min(share) FILTER (w > 0) >= 0.8 * max(share) FILTER (w = 0), false) AS steady FROM s GROUP BY track""")
def _(spark, d):
    own = posts(spark, d).withColumn("w", F.floor(F.date_diff(F.lit("2024-02-29").cast("date"), F.to_date("occurred_at")) / 15).cast("int"))
    return archive.covered(own, "track", "w", F.col("relevance") > 20)


@query("steps_with_shared_words", f"""WITH {ITEMS}, l AS (SELECT *, lag(item_id) OVER w AS before, lag(occurred_at) OVER w AS t, lag(keywords) OVER w AS their FROM items WINDOW w AS (PARTITION BY source ORDER BY occurred_at, item_id))
  SELECT item_id, before, len(list_intersect(keywords, their)) AS shared FROM l WHERE t IS NOT NULL AND occurred_at <= t + INTERVAL 2 DAY AND len(list_intersect(keywords, their)) > 0""")
def _(spark, d):
    return archive.steps_with_shared_words(items(spark, d), "source", "occurred_at", "keywords", 2)


@query("modal_shifts", f"""WITH {ITEMS}, c AS (SELECT source, hour(occurred_at) AS shift, count(*) AS n FROM items GROUP BY 1, 2) SELECT source, CAST(shift AS INTEGER) AS shift, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, shift) AS p FROM c) WHERE p = 1""")
def _(spark, d):
    return archive.modal_shift(items(spark, d), "source", F.hour("occurred_at"))


@query("claim_support", f"""WITH {POSTS}, c AS (SELECT o_orderkey % 300 AS claim, o_custkey AS item_id FROM orders) SELECT claim, count(*) AS cited, count(outlet) AS known, count(DISTINCT outlet) AS sources, count(outlet) = count(*) AND count(DISTINCT outlet) >= 2 AS kept FROM c LEFT JOIN posts USING (item_id) GROUP BY claim""")
def _(spark, d):
    claims = table(spark, d, "orders").select((F.col("o_orderkey") % 300).alias("claim"), F.col("o_custkey").alias("item_id"))
    return archive.supported(claims, posts(spark, d), 2)


@query("linked_institutions", """WITH r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(n_name) WHEN c_custkey % 3 = 1 THEN n_name || '.' ELSE 'Institute of ' || n_name END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey),
  c AS (SELECT raw, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'), ' ') AS fold, count(*) AS n FROM r GROUP BY 1, 2) SELECT raw, n, n_name AS name FROM c LEFT JOIN nation ON trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g'), ' ') = fold""")
def _(spark, d):
    nation = table(spark, d, "nation")
    own = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat("n_name", F.lit("."))).otherwise(F.concat(F.lit("Institute of "), "n_name"))
    names = nation.select(F.trim(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", " ")).alias("alias"), F.col("n_name").alias("name"))
    return archive.linked_names(own.select(raw.alias("raw")), "raw", names)


@query("unmatched_models", """WITH s AS (SELECT *, max(l_shipdate) OVER (PARTITION BY l_returnflag) AS latest FROM lineitem) SELECT l_partkey, count(*) AS n FROM s LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_shipdate >= latest - INTERVAL 30 DAY AND p_partkey IS NULL GROUP BY l_partkey""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_shipdate").cast("timestamp_ntz").alias("at"))
    latest = rows.groupBy("l_returnflag").agg(F.max("at").alias("latest"))
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    recent = rows.join(F.broadcast(latest), "l_returnflag").where(F.col("at") >= F.col("latest") - F.expr("INTERVAL 30 DAYS"))  # one row a flag
    return recent.join(known, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("throttled_readings", f"""WITH RECURSIVE {ITEMS}, o AS (SELECT source, occurred_at AS t, k % 4 AS v, row_number() OVER (PARTITION BY source ORDER BY occurred_at, k % 4) AS i FROM items),
  r AS (SELECT source, i, t, v, t AS lt, v AS lv, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.source, o.i, o.t, o.v, CASE WHEN o.v <> r.lv AND o.t >= r.lt + INTERVAL 12 HOUR THEN o.t ELSE r.lt END,
  CASE WHEN o.v <> r.lv AND o.t >= r.lt + INTERVAL 12 HOUR THEN o.v ELSE r.lv END, o.v <> r.lv AND o.t >= r.lt + INTERVAL 12 HOUR FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
  SELECT source, t AS occurred_at, v FROM r WHERE kept""")
def _(spark, d):
    own = items(spark, d).select("source", "occurred_at", (F.col("k") % 4).alias("v"))
    return archive.throttled(own, "source", "occurred_at", "v", 12 * 3600)


@query("misfit_context", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS a FROM e GROUP BY 1, 2), c AS (SELECT label, list(a ORDER BY i) AS centre FROM m GROUP BY label),
  s AS (SELECT label, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), centre) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(centre, centre)) AS c FROM embeddings JOIN c USING (label))
  SELECT label, count(*) AS members, round(avg(c), 4) AS mean_similarity, round(min(c), 4) AS lowest FROM s GROUP BY label""")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    centre = catalog.centroids(vectors, "label").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("centre"))
    own = vectors.join(centre, "label").select("label", catalog.cosine(F.col("embedding"), F.col("centre")).alias("c"))
    return own.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("c"), 4).alias("mean_similarity"), F.round(F.min("c"), 4).alias("lowest"))


@query("guarded_integers", """SELECT event_id, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '-?[0-9]{1,9}') THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, json_type(props, '$') = 'OBJECT' AS is_object FROM events""")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", F.when(k.rlike("^-?[0-9]{1,9}$"), k.try_cast("int")).alias("k"), F.ltrim("props").startswith("{").alias("is_object"))


@query("star_join_with_gaps", f"""WITH {POSTS}, n AS (SELECT story, count(*) AS members FROM posts WHERE story IS NOT NULL GROUP BY story) SELECT item_id, coalesce(members, 1) AS members, quality, toxic FROM posts LEFT JOIN n USING (story) LEFT JOIN labels ON item_id = doc_id WHERE region = 'en'""")
def _(spark, d):
    own = posts(spark, d)
    size = own.where("story IS NOT NULL").groupBy("story").agg(F.count(F.lit(1)).alias("members"))
    rows = own.where("region = 'en'").join(size, "story", "left").join(table(spark, d, "labels"), F.col("item_id") == F.col("doc_id"), "left")
    return rows.select("item_id", F.coalesce("members", F.lit(1)).alias("members"), "quality", "toxic")


@query("junk_by_url", r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/(tag|category|login|search)(/|$)') THEN 'listing' WHEN regexp_matches(url, '[?&]page=') THEN 'paged' WHEN regexp_matches(url, '(?i)\.(pdf|jpg|zip)($|[?#])') THEN 'file' END AS junk FROM pages")
def _(spark, d):
    url = F.col("url")
    junk = F.when(url.rlike(r"(?i)/(tag|category|login|search)(/|$)"), "listing").when(url.rlike("[?&]page="), "paged").when(url.rlike(r"(?i)\.(pdf|jpg|zip)($|[?#])"), "file")
    return table(spark, d, "pages").select("page_id", junk.alias("junk"))


@query("source_overview", f"""WITH {ITEMS} SELECT source, count(*) AS items, count(*) FILTER (track = 'error') AS errors, max(occurred_at) AS last_at, count(DISTINCT CAST(occurred_at AS DATE)) AS days, round(count(*) FILTER (track = 'error') / count(*), 4) > 0.2 AS finding FROM items GROUP BY source""")
def _(spark, d):
    errors = F.count_if(F.col("track") == "error")
    return items(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("items"), errors.alias("errors"), F.max("occurred_at").alias("last_at"), F.countDistinct(F.to_date("occurred_at")).alias("days"), (F.round(errors / F.count(F.lit(1)), 4) > 0.2).alias("finding"))


@query("company_moves", f"""WITH {ITEMS} SELECT source, count(*) AS n, count(DISTINCT theme) AS themes FROM items WHERE occurred_at >= '2024-01-29' AND source NOT IN (SELECT source FROM items WHERE theme = 0 AND track = 'error') GROUP BY source ORDER BY n DESC, source LIMIT 8""")
def _(spark, d):
    own = items(spark, d)
    recent = own.where(F.col("occurred_at") >= F.lit("2024-01-29").cast("timestamp_ntz")).join(own.where("theme = 0 AND track = 'error'").select("source").distinct(), "source", "left_anti")
    return recent.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("theme").alias("themes")).orderBy(F.desc("n"), "source").limit(8)


@query("best_card_of_each_story", f"""WITH {POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(story, -item_id) ORDER BY relevance DESC, occurred_at DESC, item_id DESC) AS p FROM posts WHERE region IN ('en', 'de')) SELECT item_id, track, relevance FROM r WHERE p = 1""")
def _(spark, d):
    own = posts(spark, d).where("region IN ('en', 'de')").withColumn("fold", F.coalesce("story", -F.col("item_id")))
    order = [F.desc("relevance"), F.desc("occurred_at"), F.desc("item_id")]
    return digest.top_rows(own, ["fold"], order, 1).select("item_id", "track", "relevance")
