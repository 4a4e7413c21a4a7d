"""What a digest is made of: which posts count, how strong their evidence is, quotas, sustained stories, queues and measures of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.sources.shared import spill

#: Outlets of strong and of weak evidence, and the vendors' share from which it leans on them. Fixed values.
STRONG, WEAK, VENDOR_HEAVY = 5, 2, 0.5


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int, place: str = "place") -> DataFrame:
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= most)


def publishable(posts: DataFrame) -> Column:
    """Has a title and text, a known outlet, and isn't marked as toxic."""
    return (F.trim("title") != "") & (F.trim("text") != "") & F.col("outlet").isNotNull() & (F.coalesce("toxic", F.lit(0)) == 0)


def fresh(at: Column, seen: Column, days: int) -> Column:
    """Not older than `days` days when it was first seen; without a date it passes."""
    return at.isNull() | (at >= seen - F.expr(f"INTERVAL {days} DAYS"))


def state_of(title: Column, quality: Column, toxic: Column, relevance: Column) -> Column:
    """The first that holds: empty, unlabelled, rejected, excluded, minor, ready."""
    return (
        F.when(F.trim(title) == "", "empty").when(quality.isNull(), "unlabelled").when(toxic == 1, "rejected")
        .when(quality == 0, "excluded").when(relevance < 20, "minor").otherwise("ready")
    )


def strength(evidence: DataFrame, key: str) -> DataFrame:
    """evidence(key, outlet, track, region, vendor, story_outlets) -> outlets, tracks, regions, vendor_share and the grade of each key."""
    found = evidence.groupBy(key).agg(
        F.greatest(F.countDistinct("outlet"), F.max("story_outlets")).alias("outlets"), F.countDistinct("track").alias("tracks"),
        F.countDistinct("region").alias("regions"), F.round(F.avg(F.col("vendor").cast("int")), 2).alias("vendor_share"),
    )
    share, outlets = F.col("vendor_share"), F.col("outlets")
    wide = (F.col("tracks") >= 2) | (F.col("regions") >= 2)
    grade = F.when((outlets <= WEAK) | (share == 1), "weak").when((outlets >= STRONG) & wide & (share < VENDOR_HEAVY), "strong").otherwise("medium")
    return found.withColumn("grade", grade)


def gates(chosen: DataFrame, limits: dict[str, tuple[Column, float]]) -> DataFrame:
    """(gate, value, least, passed): each measure of the chosen rows against what it must reach; one aggregate."""
    measured = chosen.agg(*[value.cast("double").alias(name) for name, (value, _) in limits.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(float(least)).alias("least")) for n, (_, least) in limits.items()])
    return measured.select(F.explode(rows).alias("g")).select("g.gate", F.round("g.value", 4).alias("value"), "g.least", (F.col("g.value") >= F.col("g.least")).alias("passed"))


def weekly_pick(cards: DataFrame, score: str, at: str, id_col: str, per_week: int, total: int) -> DataFrame:
    """Up to `per_week` best rows of each week from Monday, then the best of the rest, `total` in all; `pick` says which.

    A row beyond the first `total` of its week can't be chosen, so that only those few are ordered at last.
    """
    order = [F.desc_nulls_last(score), F.col(id_col)]
    rows = top_rows(cards.withColumn("week", F.to_date(F.date_trunc("week", at))), ["week"], order, total)
    rows = rows.withColumn("pick", F.when(F.col("place") <= per_week, "week").otherwise("rest"))
    return rows.orderBy(F.when(F.col("pick") == "week", 0).otherwise(1), *order).limit(total)


def sustained(posts: DataFrame, end: str, days: int = 7, least: int = 3) -> DataFrame:
    """Stories with posts on `least` or more of the last `days` days: 100 for each outlet, 10 for each community post, 20 for each day."""
    last = F.lit(end).cast("timestamp_ntz")
    recent = posts.where(F.col("story").isNotNull() & (F.col("occurred_at") < last) & (F.col("occurred_at") >= last - F.expr(f"INTERVAL {days} DAYS")))
    found = recent.groupBy("story").agg(F.countDistinct(F.to_date("occurred_at")).alias("days"), F.countDistinct("outlet").alias("outlets"), F.count_if(F.col("track") == "community").alias("community"))
    return found.where(F.col("days") >= least).withColumn("score", F.col("outlets") * 100 + F.col("community") * 10 + F.col("days") * 20)


def mentions(posts: DataFrame) -> DataFrame:
    """For each post outside the community how many community posts are in its story or have its title, each once.

    Both are counts by key; posts that meet both ways are counted by the pair of keys and taken off.
    """
    own = posts.where("track <> 'community'").select("item_id", "story", "title")
    said = posts.where("track = 'community'").select("story", "title")
    by_story = said.where("story IS NOT NULL").groupBy("story").agg(F.count(F.lit(1)).alias("in_story"))
    by_title = said.where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("in_title"))
    by_both = said.where("story IS NOT NULL AND title <> ''").groupBy("story", "title").agg(F.count(F.lit(1)).alias("in_both"))
    found = own.join(by_story, "story", "left").join(by_title, "title", "left").join(by_both, ["story", "title"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.select("item_id", (zero("in_story") + zero("in_title") - zero("in_both")).alias("mentions"))


def nearest_rank(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, n, value): the value at rank ceil(share * n). Equal values are counted first, so that a key's distinct values are ranked."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy(key))})
    return ranked.where(F.col("upto") >= F.ceil(F.col("n") * share)).groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias(value))


def most_common(rows: DataFrame, key: Column, spelling: str) -> DataFrame:
    """(key, label, n): the most frequent spelling of each key, the least of equally frequent ones."""
    counts = rows.groupBy(key.alias("key"), F.col(spelling).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("key").agg(F.max_by(F.struct("label", "n"), F.col("n")).alias("b"), F.max("n").alias("most"))
    tied = counts.join(best.select("key", "most"), "key").where("n = most").groupBy("key").agg(F.min("label").alias("label"), F.max("n").alias("n"))
    return tied


def unknown_names(rows: DataFrame, name: str, known: DataFrame, least_rows: int, least_sources: int) -> DataFrame:
    """Names that are no alias yet, with `least_rows` rows and `least_sources` sources or more."""
    found = rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    return found.where((F.col("n") >= least_rows) & (F.col("sources") >= least_sources)).join(known, "name", "left_anti")


def watch_hits(rows: DataFrame, words: str, watched: list[str], id_col: str, most: int = 3) -> DataFrame:
    """(word, n, ids): how many rows hold each watched word, and its `most` highest ids."""
    held = rows.select(id_col, F.explode(F.array_intersect(words, F.array(*map(F.lit, watched)))).alias("word"))
    best = top_rows(held, ["word"], [F.desc(id_col)], most).groupBy("word").agg(F.array_join(F.sort_array(F.collect_list(id_col), False).cast("array<string>"), ",").alias("ids"))
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(best, "word")


def changed_days(rows: DataFrame, day: str, changed: str, since: str, today: str, recent: int = 3) -> DataFrame:
    """Days to compute again: the last `recent` ones, and those of rows that changed since a time."""
    last = rows.sparkSession.range(recent).select(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))
    return last.union(rows.where(F.col(changed) >= F.lit(since).cast("timestamp_ntz")).select(F.to_date(day).alias("day"))).distinct()


def weighted_mean(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """scores(model, category, score), weights(category, weight) -> overall, the weighted mean of each category's mean, and the share of weight covered."""
    means = scores.groupBy("model", "category").agg(F.avg("score").alias("mean")).join(weights, "category")
    total = weights.agg(F.sum("weight").alias("total"))
    found = means.groupBy("model").agg(F.sum(F.col("mean") * F.col("weight")).alias("s"), F.sum("weight").alias("w")).crossJoin(F.broadcast(total))  # one row
    return found.where("w > 0").select("model", F.round(F.col("s") / F.col("w"), 4).alias("overall"), F.round(F.col("w") / F.col("total"), 4).alias("coverage"))


def folded_lines(lines: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """(key, event, lines, first): lines that don't start an event belong to the one before; a key's first line always starts one."""
    by_key = Window.partitionBy(key).orderBy(order)
    begun = F.sum(F.when(starts | (F.row_number().over(by_key) == 1), 1).otherwise(0)).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("event", begun.cast("long")).groupBy(key, "event").agg(F.count(F.lit(1)).alias("lines"), F.min(order).alias("first"))


def next_interval(current: Column, idle: Column, new_items: Column, floor: float, ceiling: float, burst: int = 5) -> Column:
    """Seconds until the next poll: half as long again when idle, a third less after news, the floor after a burst; within both bounds."""
    wanted = F.when(new_items >= burst, F.lit(floor)).when(idle, current * 1.5).when(new_items > 0, current / 1.5).otherwise(current)
    return F.least(F.greatest(wanted, F.lit(floor)), F.lit(ceiling))


def alert_changes(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, change): opened, kept or closed between two sets of findings."""
    both = now.select(F.col(key), F.lit(True).alias("is")).join(before.select(F.col(key), F.lit(True).alias("was")), key, "full")
    return both.select(key, F.when(F.col("was").isNull(), "opened").when(F.col("is").isNull(), "closed").otherwise("kept").alias("change"))


def paths_of(edges: DataFrame) -> DataFrame:
    """edges(node, parent), parent null at a root -> (node, path, depth): ancestors and itself. Nodes that no root leads to (cycles) have no path.

    One join a level with the nodes of the level above, written so that no level is made twice; there are as many as the tree is deep.
    """
    edges = spill(edges.select("node", "parent"), "edges")  # each level reads them: what they are made of runs once
    level = spill(edges.where("parent IS NULL").select("node", F.array("node").alias("path")), "paths")
    out = level
    while True:
        level = edges.join(level.select(F.col("node").alias("parent"), "path"), "parent").where(~F.array_contains("path", F.col("node")))
        level = spill(level.select("node", F.concat("path", F.array("node")).alias("path")), "paths")
        if not level.head(1):
            break
        out = out.union(level)
    return out.select("node", "path", F.size("path").alias("depth"))
