"""Sections of a digest: what happened in a day and what goes on for days, by quotas that lend each other places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a section's two groups, before they lend; days that are looked at, and active days from which a key is sustained. Fixed values.
NOW, SUSTAINED, WINDOW_DAYS, LEAST_DAYS = 10, 5, 7, 3


def entries(reports: DataFrame, end: str) -> DataFrame:
    """reports(section, key, priority, score, occurred_at) -> (section, key, grp, priority, score, days, reports): `now` for keys of the last 24 hours before `end`, `sustained` for those
    that were active on LEAST_DAYS or more of the last WINDOW_DAYS days but not in these hours.

    priority is the least of a key's reports (its best pool), score the greatest of that pool; each in one aggregate. Reports without a section or key take no part.
    """
    last = F.lit(end).cast("timestamp_ntz")
    recent = F.col("occurred_at") >= last - F.expr("INTERVAL 24 HOURS")
    own = reports.where((F.col("occurred_at") < last) & (F.col("occurred_at") >= last - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS"))).where("section IS NOT NULL AND key IS NOT NULL")
    best = lambda hit: F.min(F.when(hit, F.struct("priority", (-F.col("score")).alias("less"))))
    found = own.groupBy("section", "key").agg(
        F.countDistinct(F.to_date("occurred_at")).alias("days"), F.count_if(recent).alias("n_now"), F.count(F.lit(1)).alias("n"), best(recent).alias("a"), best(F.lit(True)).alias("b")
    )
    now = F.col("n_now") > 0
    picked = F.when(now, F.col("a")).otherwise(F.col("b"))
    rows = found.where(now | (F.col("days") >= LEAST_DAYS)).withColumn("x", picked)
    return rows.select("section", "key", F.when(now, "now").otherwise("sustained").alias("grp"), "x.priority", (-F.col("x.less")).alias("score"), "days", F.when(now, F.col("n_now")).otherwise(F.col("n")).alias("reports"))


def picked(found: DataFrame, now: int = NOW, sustained: int = SUSTAINED) -> DataFrame:
    """`found` with `place`: of each section the first `now` entries of one group and `sustained` of the other; a short group lends its places.

    Better pools (a smaller priority) come first, so that others only fill what they leave; then higher scores, then keys in order. Null priorities and scores come last. As a group
    can't have more than all places, only its first ones are ranked, with partial limits, and counted.
    """
    total = now + sustained
    order = [F.asc_nulls_last("priority"), F.desc_nulls_last("score"), F.asc("key")]
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("section", "grp").orderBy(*order))).where(F.col("place") <= total)
    counts = ranked.groupBy("section").agg(F.count_if(F.col("grp") == "now").alias("n"), F.count_if(F.col("grp") != "now").alias("s"))
    keep = F.least("n", F.lit(total) - F.least("s", F.lit(sustained)))
    counts = counts.select("section", keep.alias("keep_now"), F.least("s", F.lit(total) - keep).alias("keep_sustained"))
    kept = ranked.join(counts, "section").where(F.col("place") <= F.when(F.col("grp") == "now", F.col("keep_now")).otherwise(F.col("keep_sustained")))
    return kept.drop("keep_now", "keep_sustained")
