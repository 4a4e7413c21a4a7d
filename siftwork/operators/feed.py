"""Feeds, facets and counts over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(start: str | None, end: str, at: str = "occurred_at") -> Column:
    """Half-open: before `end`, and from `start` on if there is one."""
    before = F.col(at) < F.lit(end).cast("timestamp_ntz")
    return before if start is None else before & (F.col(at) >= F.lit(start).cast("timestamp_ntz"))


def one_row_per_story(items: DataFrame, score: str = "value") -> DataFrame:
    """The row of each story with the highest score, then newest, then highest id; with the story's size as `members`."""
    best = F.struct(F.col(score).isNotNull(), score, "occurred_at", "item_id")
    found = items.groupBy("story").agg(F.max_by(F.struct(*items.columns), best).alias("row"), F.count(F.lit(1)).alias("members"))
    return found.select("row.*", "members")


def facets(items: DataFrame, axes: dict[str, list | None]) -> DataFrame:
    """(axis, value, n): counts of each axis in one pass; each leaves out its own choice and applies the others'."""
    def chosen(axis: str) -> Column:
        return F.lit(True) if axes[axis] is None else F.col(axis).isin(axes[axis])

    rows = []
    for axis in axes:
        others = F.lit(True)
        for other in axes:
            if other != axis:
                others = others & chosen(other)
        rows.append(F.struct(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("value"), others.alias("counts")))
    return items.select(F.explode(F.array(*rows)).alias("f")).where("f.counts").groupBy("f.axis", "f.value").agg(F.count(F.lit(1)).alias("n"))


def insights(items: DataFrame, axes: list[str]) -> DataFrame:
    """Counts by each axis alone and in all, by grouping sets: axis names the set, `value` its value (null in all)."""
    sets = [[F.col(a)] for a in axes] + [[]]
    grouped = items.groupingSets(sets, *axes).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    names, values = F.lit("all"), F.lit(None).cast("string")
    for i, a in enumerate(axes):
        own = (1 << len(axes)) - 1 - (1 << (len(axes) - 1 - i))
        names, values = F.when(F.col("gid") == own, a).otherwise(names), F.when(F.col("gid") == own, F.col(a).cast("string")).otherwise(values)
    return grouped.select(names.alias("axis"), values.alias("value"), "n")


def element_counts(items: DataFrame, array: str) -> DataFrame:
    """Items that hold each array element (arrays have distinct elements, so rows are counted)."""
    return items.select(F.explode(array).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))


def search(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which a column contains the needle, letter case aside; `%` and `_` stand for themselves."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())
    return rows.where(hit)


def kpis(items: DataFrame, bucket: Column) -> DataFrame:
    """Items, stories and sources in each bucket, all exact."""
    return items.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("story").alias("stories"), F.countDistinct("source").alias("sources")
    )


def latest_per_key(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the highest `tie`."""
    newest = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place")


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key in `order`, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def explore_exploit(rows: DataFrame, total: int, share: float = 0.9) -> DataFrame:
    """A queue: most of it by score, the rest the newest of what the score left out."""
    best = rows.orderBy(F.desc_nulls_last("value"), "item_id").limit(round(total * share)).select("item_id", F.lit("score").alias("why"))
    rest = rows.join(best, "item_id", "left_anti").orderBy(F.desc("occurred_at"), F.desc("item_id")).limit(total - round(total * share))
    return best.union(rest.select("item_id", F.lit("new").alias("why")))


def hash_sample(rows: DataFrame, seed: str, size: int) -> DataFrame:
    """The rows first by the MD5 of seed and id: the same ones each time."""
    return rows.withColumn("rank_key", F.md5(F.concat(F.lit(seed), F.col("item_id").cast("string")))).orderBy("rank_key").limit(size)
