"""Results that are kept up to date: days rebuilt alone behind a versioned pointer, and duplicate roots recomputed only where keys changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators import stories
from siftwork.sources.shared import small_side, spill

KEYS = ("text_key", "title_key")


def _version(spark: SparkSession, folder: str) -> int:
    """The newest version whose pointer was committed (Spark writes _SUCCESS last); 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath() for s in fs.listStatus(path)]
    return max((int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=0)


def pointers(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """(day, run) of a version, the newest if none is named: the run that wrote each day's rows last. None before the first."""
    version = _version(spark, folder) if version is None else version
    return spark.read.schema("day date, run string").parquet(f"{folder}/versions/{version:08d}") if version else None


def current(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version: those of each day that its run wrote. A reader that began before a refresh goes on with the version that it found."""
    held = pointers(spark, folder, version)
    if held is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, run string").parquet(f"{folder}/data")
    return rows.join(small_side(held), ["day", "run"], "left_semi").drop("run")


def refresh_days(folder: str, days: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
    """Rebuilds days(day) and points a new version at them; returns the version.

    `build` gives the rows, with a column day, of the days that it is handed (it should filter by them before it aggregates). They are written as a run of their own, in a folder for
    each day; then a pointer table is written whose last file commits it. A refresh that fails leaves the version before, and its files are
    not read by anyone; one that is run again gives the same rows. A day that has no rows any more has none in the new version. Two refreshes at once can't both
    commit one version: the second fails and is to be run again.
    """
    spark, run = days.sparkSession, uuid.uuid4().hex
    changed = spill(days.select(F.col("day").cast("date").alias("day")).where("day IS NOT NULL").distinct(), "days")
    build(changed).withColumn("day", F.col("day").cast("date")).withColumn("run", F.lit(run)).hint("rebalance", "day").write.partitionBy("run", "day").mode("append").parquet(f"{folder}/data")
    before, version = pointers(spark, folder), _version(spark, folder)
    after = changed.select("day", F.lit(run).alias("run"))
    if before is not None:
        after = before.join(small_side(changed), "day", "left_anti").union(after)
    after.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/versions/{version + 1:08d}")
    return version + 1


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item_id): items whose duplicate root may be another after a change of keys: those that share a key, old or new, with an item that changed."""
    both = old.select("item_id", *[F.col(k).alias(f"old_{k}") for k in KEYS], F.struct("text_key", "title_key", "lead_key", "lead_title").alias("was"))
    both = both.join(new.select("item_id", *KEYS, F.struct("text_key", "title_key", "lead_key", "lead_title").alias("is")), "item_id", "full")
    changed = spill(both.where("NOT (was <=> is)"), "changed")
    out = changed.select("item_id")
    for key in KEYS:
        moved = changed.select(F.explode(F.array(key, f"old_{key}")).alias(key)).where(f"{key} IS NOT NULL").distinct()
        out = out.union(new.join(small_side(moved), key, "left_semi").select("item_id"))
    return out.distinct()


def refreshed_roots(before: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(item_id, root, matched_by) for the keys `new`, from the roots `before` of the keys `old`: what stories.duplicate_roots gives, without comparing anew what can't have changed.

    Items that were touched lose their roots. Their candidates, all that share a key with them, are looked through again; all others keep what they had, items that
    are gone go.
    """
    old, new = spill(old, "keys"), spill(new, "keys")  # keys are made of whole texts: once
    again = small_side(spill(touched(old, new), "touched"))
    asked = new.join(again, "item_id", "left_semi")
    near = None
    for key in KEYS:
        keys = asked.select(key).where(f"{key} IS NOT NULL").distinct()
        found = new.join(small_side(spill(keys, "keys")), key, "left_semi")
        near = found if near is None else near.unionByName(found)
    rest = asked.where(" AND ".join(f"{k} IS NULL" for k in KEYS))
    redone = stories.duplicate_roots(spill(near.unionByName(rest).dropDuplicates(["item_id"]), "near")).join(again, "item_id", "left_semi")
    kept = before.join(again, "item_id", "left_anti").join(new.select("item_id"), "item_id", "left_semi")
    return kept.select("item_id", "root", "matched_by").union(redone)


def refreshed_keys(old: DataFrame, posts: DataFrame, edited: DataFrame) -> DataFrame:
    """What stories.dedup_keys gives for `posts`, from the keys `old` of the posts before: those of edited(item_id), new ones among them, are made anew, of the others kept."""
    kept = old.join(edited.select("item_id"), "item_id", "left_anti")
    return kept.unionByName(stories.dedup_keys(posts.join(edited.select("item_id").distinct(), "item_id", "left_semi")))


def dependents(roots: DataFrame, changed: DataFrame) -> DataFrame:
    """(item_id): the changed items and all whose chain of roots leads through one of them; a join for each step of the longest chain."""
    reached = spill(changed.select("item_id").distinct(), "reached")
    level = reached
    while True:
        level = spill(roots.join(level.select(F.col("item_id").alias("root")), "root").select("item_id").join(reached, "item_id", "left_anti"), "reached")
        if not level.head(1):
            return reached
        reached = reached.union(level)
