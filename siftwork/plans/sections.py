"""The query of siftwork.operators.sections with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import sections
from siftwork.plans.registry import query
from siftwork.plans.stories import POSTS
from siftwork.sources.adapters import posts

_KEY = "outlet || '/' || region"


@query("digest_sections", f"""WITH {POSTS}, r AS (SELECT track AS section, {_KEY} AS key, item_id % 3 AS priority, relevance AS score, occurred_at FROM posts WHERE occurred_at < '2024-02-20' AND occurred_at >= TIMESTAMP '2024-02-20' - INTERVAL 7 DAY),
  k AS (SELECT section, key, count(DISTINCT CAST(occurred_at AS DATE)) AS days, count(*) FILTER (occurred_at >= TIMESTAMP '2024-02-20' - INTERVAL 1 DAY) AS n_now, count(*) AS n FROM r WHERE section IS NOT NULL AND key IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT k.section, k.key, CASE WHEN n_now > 0 THEN 'now' ELSE 'sustained' END AS grp, days, CASE WHEN n_now > 0 THEN n_now ELSE n END AS reports, r.priority, r.score FROM k JOIN r ON r.section = k.section AND r.key = k.key AND (n_now = 0 OR r.occurred_at >= TIMESTAMP '2024-02-20' - INTERVAL 1 DAY)
    WHERE n_now > 0 OR days >= 3 QUALIFY row_number() OVER (PARTITION BY k.section, k.key ORDER BY r.priority, r.score DESC) = 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY section, grp ORDER BY priority, score DESC, key) AS place, count(*) FILTER (grp = 'now') OVER (PARTITION BY section) AS n, count(*) FILTER (grp <> 'now') OVER (PARTITION BY section) AS s FROM e)
  SELECT section, key, grp, priority, score, days, reports, CAST(place AS INTEGER) AS place FROM p WHERE place <= CASE WHEN grp = 'now' THEN least(n, 15 - least(s, 5)) ELSE least(s, 15 - least(n, 15 - least(s, 5))) END""")
def _(spark, d):
    own = posts(spark, d).select(F.col("track").alias("section"), F.concat("outlet", F.lit("/"), "region").alias("key"), (F.col("item_id") % 3).alias("priority"), F.col("relevance").alias("score"), "occurred_at")
    return sections.picked(sections.entries(own, "2024-02-20"))
