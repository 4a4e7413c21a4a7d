"""Places of all rows in one order, and values at given places, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.sources.shared import spill

#: Values that a search for places ends with at most, and even bins that it counts in between.
FEW, BINS = 10_000, 4096


def ranked(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`rows` with `name`: the place of each in the order, from 1.

    A range sort gives each task a stretch of the order; the places of its rows go on from the sum of the stretches before, of which there is one
    row a task, added up in blocks of a thousand. Rows are written once, so that their places stay.
    """
    keys = [f"k{i}" for i in range(len(order))]
    own = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys, strict=True)])
    placed = spill(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("mark", F.monotonically_increasing_id()), "ranked")
    part, before = F.shiftright("mark", 33), (Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("first")).withColumn("block", F.shiftright("part", 10))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("all"))
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(*before)), F.lit(0)).alias("earlier"))
    starts = parts.join(blocks, "block").select("part", "first", (F.col("earlier") + F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(*before)), F.lit(0))).alias("start"))
    return placed.withColumn("part", part).join(starts, "part").withColumn(name, F.col("start") + F.col("mark") - F.col("first") + 1).drop("part", "first", "start", "mark")


def values_at(numbers: DataFrame, places: list[int]) -> list[float]:
    """The numbers at some places (from 0) of the sorted column `x`, without nulls: counts in even bins narrow the range down to FEW values."""
    own = numbers.select(F.col("x").cast("double").alias("x")).where("x IS NOT NULL")
    out = []
    for place in places:
        low, high = own.agg(F.min("x"), F.max("x")).first()
        if low is None:
            return []
        rest, inside, left = own, own.count(), place
        while inside > FEW and low < high:
            width = (high - low) / BINS
            at = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1))
            counted = sorted(tuple(r) for r in rest.groupBy(at.alias("bin")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect())  # BINS rows at most
            for _, n, least, most in counted:
                if left < n:
                    inside, low, high = n, least, most
                    break
                left -= n
            rest = own.where((F.col("x") >= low) & (F.col("x") <= high))
        out.append(low if low == high else sorted(r.x for r in rest.collect())[left])
    return out


def quantile(numbers: DataFrame, share: float) -> float | None:
    """The quantile of the column `x`, between two neighbours in proportion; null if there are no numbers."""
    n = numbers.where("x IS NOT NULL").count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = values_at(numbers, [int(at), min(int(at) + 1, n - 1)])
    return low + (high - low) * (at - int(at))
