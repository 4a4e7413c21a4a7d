"""Queries of siftwork.operators.models, selection and neighbours. Fitted weights and greedy choices have no DuckDB twin; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import matching, models, neighbours, selection
from siftwork.plans.registry import query
from siftwork.sources.adapters import posts, table


def judged_vectors(spark, d):
    """Embeddings as items: wanted where the sum of their first components and a share of their sources' says so."""
    v, k = F.col("embedding"), F.col("vec_id")
    lean = sum((F.get(v, F.lit(i)).cast("double") for i in range(1, 8)), F.get(v, F.lit(0)).cast("double"))
    wanted = (lean + (k % 20 - 10) / 60.0 + (k * 7919 % 101 - 50) / 250.0 > 0).cast("int")
    return table(spark, d, "embeddings").select(k.alias("id"), v.alias("x"), wanted.alias("y"), (k % 20).alias("source"), (k * 104_729 % 99_991).alias("at"))


@query("ridge_triage")
def _(spark, d):
    model, scored = models.train(judged_vectors(spark, d))
    return scored.select("id", "held_out", F.round("s", 9).alias("score"), F.round(models.probability(F.col("s"), model), 9).alias("probability"))


@query("shortlist")
def _(spark, d):
    own = posts(spark, d)
    score = F.col("relevance") + 12 * F.log2(1 + F.col("item_id") % 9)
    return selection.shortlist(own.select(
        "item_id", "track", F.col("outlet").alias("domain"), score.alias("score"), "story", (F.col("region") == "de").alias("local"), (F.col("item_id") % 4 == 0).alias("official"), (F.col("item_id") % 3 == 0).alias("independent")
    ))


@query("semantic_neighbours")
def _(spark, d):
    return neighbours.nearest_elsewhere(neighbours.title_vectors(posts(spark, d).where("story IS NOT NULL")))


@query("leader_clusters")
def _(spark, d):
    return neighbours.leader_clusters(neighbours.title_vectors(posts(spark, d)).select("item_id", "v", F.length("title").alias("weight")))


@query("titles_of_one_work")
def _(spark, d):
    """Each two posts of a story (four at most) whose titles are of one work."""
    own = matching.keyed(posts(spark, d).where("story IS NOT NULL").select("item_id", "story", "title"), "title", "a")
    other = own.select(F.col("item_id").alias("other"), "story", F.col("a").alias("b"))
    pairs = own.join(other, "story").where("item_id < other").select("item_id", "other", "a", "b")
    return matching.matched(pairs).select("item_id", "other", F.round("ratio", 6).alias("ratio"))
