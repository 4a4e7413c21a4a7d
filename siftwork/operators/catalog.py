"""Taxonomy trees, daily cubes, deals, leaderboards, review figures, vectors and incremental tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a block of the neighbour search holds, about.
BLOCK_VECTORS = 512
#: Bins of scores that are cumulated apart.
BINS = 1024
#: Rows that a task of it holds before it merges them.
HELD_ROWS = 400_000


def distribution(tree: DataFrame, weight: Column, depth: int) -> DataFrame:
    """Leaves and their weight under the ancestor of each at `depth` (or itself, where it is higher up)."""
    node = F.element_at("path", F.least(F.lit(depth), F.col("depth")))
    return tree.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(weight), 2).alias("weight"))


def own_and_total(tree: DataFrame) -> DataFrame:
    """For each node the leaves directly on it and all below or on it."""
    return tree.select("leaf", F.explode("path").alias("node"), F.element_at("path", -1).alias("last")).groupBy("node").agg(
        F.count_if(F.col("node") == F.col("last")).alias("own"), F.count(F.lit(1)).alias("total")
    )


def subtree(tree: DataFrame, wanted: list[str]) -> DataFrame:
    """Leaves under any of the wanted nodes."""
    return tree.where(F.arrays_overlap("path", F.array(*map(F.lit, wanted))))


def daily_cube(rows: DataFrame, day: str, dims: list[str], document: str, flag: Column) -> DataFrame:
    """(day, dim, key, n, n_flagged): distinct documents of each day and value of each dimension, and in total."""
    spread = [F.struct(F.lit("total").alias("dim"), F.lit("").alias("key"))] + [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims]
    long = rows.select(F.col(day).alias("day"), F.col(document).alias("doc"), flag.alias("flag"), F.explode(F.array(*spread)).alias("x"))
    once = long.groupBy("day", "x.dim", "x.key", "doc").agg(F.max("flag").alias("flag"))
    return once.groupBy("day", "dim", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("n_flagged"))


def top_and_rest(rows: DataFrame, key: str, bucket: str, most: int) -> DataFrame:
    """A series for each of the keys with the largest totals, and one named `rest` for the others."""
    counts = rows.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"))
    best = F.broadcast(totals.orderBy(F.desc("total"), "key").limit(most).select("key", F.lit(True).alias("top")))  # `most` rows
    named = counts.join(best, "key", "left").withColumn("name", F.when(F.col("top"), F.col("key").cast("string")).otherwise("rest"))
    return named.groupBy("name", "bucket").agg(F.sum("n").alias("n"))


def window_flags(counts: DataFrame, windows: int = 8) -> DataFrame:
    """counts(key, back, n) -> z of window 0 against the earlier ones (population deviation), and rise or fall."""
    found = counts.groupBy("key").agg(*[F.sum(F.when(F.col("back") == i, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(windows)])
    history = [F.col(f"c{i}") for i in range(1, windows)]
    mean = sum(history[1:], history[0]) / (windows - 1)
    spread = F.sqrt(sum([F.pow(h - mean, F.lit(2)) for h in history[1:]], F.pow(history[0] - mean, F.lit(2))) / (windows - 1))
    z = F.round((F.col("c0") - mean) / F.greatest(spread, F.sqrt(mean), F.lit(1.0)), 2)
    flag = F.when((z >= 2) & (F.col("c0") >= 3), "rise").when((z <= -2) & (mean >= 3), "fall")
    return found.select("key", F.col("c0").cast("long").alias("now"), z.alias("z"), flag.alias("flag"))


def deal_stats(deals: DataFrame, keys: list[str], outlier: float) -> DataFrame:
    """Count, median, mean and largest amount of each group; amounts of `outlier` or more are counted, not averaged."""
    own = F.when(F.col("amount") < outlier, F.col("amount"))
    return deals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.expr(f"percentile(CASE WHEN amount < {outlier} THEN amount END, 0.5)"), 2).alias("median"), F.round(F.avg(own), 2).alias("mean"), F.max(own).alias("largest")
    )


def weekly_spine(deals: DataFrame, start: str, end: str) -> DataFrame:
    """Deals and their sum in each week from Monday `start` on, empty weeks with zeros."""
    weeks = deals.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    own = deals.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    return weeks.join(own, "week", "left").select("week", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


def ranking(scores: DataFrame, board: str, group: str, value: str, tie: str) -> DataFrame:
    """Places on each board of the best row of each group; equal values go by `tie`."""
    best = Window.partitionBy(board, group).orderBy(F.desc(value), tie)
    rows = scores.withColumn("own", F.row_number().over(best)).where("own = 1").drop("own")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(board).orderBy(F.desc(value), tie)))


def rank_changes(now: DataFrame, before: DataFrame, keys: list[str], top: int) -> DataFrame:
    """now(keys, place) against before: new, up, down or same within the first `top` places."""
    was = before.select(*keys, F.col("place").alias("was"))
    moved = F.when(F.col("was").isNull(), "new").when(F.col("place") < F.col("was"), "up").when(F.col("place") > F.col("was"), "down").otherwise("same")
    return now.where(F.col("place") <= top).join(was, keys, "left").select(*keys, "place", "was", moved.alias("moved"))


def holders(places: DataFrame, key: str, snapshot: str, top: int) -> DataFrame:
    """Keys among the first `top` in every snapshot."""
    total = places.agg(F.countDistinct(snapshot).alias("total"))
    held = places.where(F.col("place") <= top).groupBy(key).agg(F.countDistinct(snapshot).alias("held"), F.max("place").alias("worst"))
    return held.join(F.broadcast(total), F.col("held") == F.col("total")).select(key, "held", "worst")  # one row


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: the four counts, precision, recall and accuracy (null where undefined)."""
    found = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    share = lambda x, n: F.when(n > 0, F.round(x / n, 4))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return found.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def threshold_sweep(scored: DataFrame, cuts: list[float]) -> DataFrame:
    """Precision, recall and F1 of score >= cut for each cut; the cuts are exploded within each row's aggregate."""
    found = scored.select("score", "label", F.explode(F.array(*map(F.lit, cuts))).alias("cut")).groupBy("cut").agg(
        F.count_if((F.col("score") >= F.col("cut")) & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("score") >= F.col("cut")).alias("said"), F.count_if(F.col("label") == 1).alias("all")
    )
    p, r = F.col("tp") / F.col("said"), F.col("tp") / F.col("all")
    return found.select("cut", F.when(F.col("said") > 0, F.round(p, 4)).alias("precision"), F.when(F.col("all") > 0, F.round(r, 4)).alias("recall"), F.when(F.col("tp") > 0, F.round(2 * p * r / (p + r), 4)).alias("f1"))


def auc(scored: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve, as the mean rank of positives (ties share their mean rank); 0.5 if a class is missing.

    Scores are counted first, then cumulated within BINS even bins of their range and over the bins' totals, so that no
    task sorts all distinct scores. Null scores are left out.
    """
    scored = scored.where(F.col("score").isNotNull())
    by_score = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    span = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    share = F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo"))
    binned = by_score.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)))  # one row
    others = F.col("n") - F.col("p")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy("bin").agg(F.sum(others).alias("q")).withColumn("base", before(F.col("q"), Window.orderBy("bin"))).select("bin", "base")
    inside = binned.withColumn("below", before(others, Window.partitionBy("bin").orderBy("score")))
    won = F.col("p") * (F.col("base") + F.col("below") + others / 2)
    total = inside.join(F.broadcast(bins), "bin").agg(F.sum(won).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))  # BINS rows
    return total.select(F.round(F.coalesce(F.try_divide(F.col("w"), F.col("p") * (F.col("n") - F.col("p"))), F.lit(0.5)), 6).alias("auc"))


def smoothed_prior(rows: DataFrame, key: str, label: str, weight: float = 5.0) -> DataFrame:
    """Each key's share of positives, drawn to the overall share with the weight of `weight` rows."""
    base = rows.agg(F.avg(label).alias("base"))
    own = rows.groupBy(key).agg(F.sum(label).alias("d"), F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(base)).select(key, "n", F.round((F.col("d") + weight * F.col("base")) / (F.col("n") + weight), 4).alias("prior"))  # one row


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, i, mean): the mean vector of each key, in long form."""
    return vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def misfits(vectors: DataFrame, key: str, most: int) -> DataFrame:
    """The members of each key whose cosine to its centroid is lowest."""
    mean = centroids(vectors, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("centre"))
    scored = vectors.join(mean, key).select(key, "vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 5).alias("similarity"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("similarity", "vec_id"))).where(F.col("place") <= most)


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows with a vector in lists of about BLOCK_VECTORS."""
    rows = rows.where(F.col(vector).isNotNull())
    slot = F.pmod(F.xxhash64(key, vector), F.lit(max(1, -(-rows.count() // BLOCK_VECTORS))))
    return rows.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("vector"))).alias("block")).select("block")


def nearest(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The vectors nearest to each of queries(query_id, query), however many, exact, best first; equal ones go by vec_id.

    Blocks of queries meet blocks of vectors as matrices; the best of each pair of blocks are merged for each query.
    Null and zero vectors, and those of another length than the query's, are near to nothing.
    """
    ids = [f"{n} {df.schema[n].dataType.simpleString()}" for n, df in (("query_id", queries), ("vec_id", vectors))]
    asked, held = _blocks(queries, "query_id", "query"), _blocks(vectors, "vec_id", "embedding")
    pairs = asked.select(F.col("block").alias("asked")).crossJoin(held.select(F.col("block").alias("held")))

    def by_length(block: pa.StructArray) -> dict[int, tuple[pa.Array, np.ndarray]]:
        sizes = np.array(block.field("vector").value_lengths())
        parts = {int(n): block.take(pa.array(np.flatnonzero(sizes == n))) for n in np.unique(sizes) if n}
        return {n: (p.field("id"), p.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)) for n, p in parts.items()}

    def best(asked: pa.StructArray, held: pa.StructArray) -> Iterator[pa.RecordBatch]:
        found = by_length(held)
        for n, (query_id, q) in by_length(asked).items():
            if n not in found:
                continue
            vec_id, v = found[n]
            with np.errstate(all="ignore"):
                near = np.round(q @ v.T / np.sqrt((q * q).sum(1)[:, None] * (v * v).sum(1)[None, :]), 5)
            near[~np.isfinite(near) | (query_id.to_numpy()[:, None] == vec_id.to_numpy()[None, :])] = -np.inf
            order = np.argsort(vec_id.to_numpy(), kind="stable")
            top = order[np.argsort(-near[:, order], axis=1, kind="stable")[:, :most]]
            row, col = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
            real = near[row, col] > -np.inf
            row, col = row[real], col[real]
            yield pa.RecordBatch.from_arrays([query_id.take(pa.array(row)), vec_id.take(pa.array(col)), pa.array(near[row, col])], ["query_id", "vec_id", "similarity"])

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        query_id, vec_id, near = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        order = np.lexsort((vec_id, -near, query_id))
        place = np.arange(len(order))
        new = np.append(True, query_id[order][1:] != query_id[order][:-1])
        place -= np.maximum.accumulate(np.where(new, place, 0))
        return rows.take(pa.array(order[place < most]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0  # a task keeps the best of what it has seen
        for batch in batches:
            for a, h in zip(batch.column(0), batch.column(1), strict=True):
                new = [x for x in best(a.values, h.values) if x.num_rows]
                parts, rows = parts + new, rows + sum(x.num_rows for x in new)
                if rows > HELD_ROWS:
                    parts = [merged(parts)]
                    rows = parts[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield parts[0]
                        parts, rows = [], 0
        if parts:
            yield merged(parts)

    scored = pairs.mapInArrow(run, f"{', '.join(ids)}, similarity double")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("place") <= most)


def ledger(rows: DataFrame, key: str, at: str, tie: str, content: Column) -> DataFrame:
    """Each arrival of a key as new, unchanged or updated against the one before, with its revision from 1 on."""
    order = Window.partitionBy(key).orderBy(at, tie)
    marked = rows.withColumn("content", content).withColumn("was", F.lag("content").over(order)).withColumn("nth", F.row_number().over(order))
    state = F.when(F.col("nth") == 1, "new").when(F.col("content").eqNullSafe(F.col("was")), "unchanged").otherwise("updated")
    marked = marked.withColumn("state", state)
    revision = F.sum(F.when(F.col("state") == "unchanged", 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select(key, tie, "state", revision.alias("revision"))


def downsample(snapshots: DataFrame, now: str, daily_after: int, weekly_after: int) -> DataFrame:
    """Snapshots that stay: all recent ones, then the last of each item and day, then of each week, and each item's first."""
    age = F.date_diff(F.lit(now).cast("date"), F.to_date("occurred_at"))
    slot = F.when(age > weekly_after, F.to_date(F.date_trunc("week", "occurred_at"))).when(age > daily_after, F.to_date("occurred_at"))
    marked = snapshots.withColumn("slot", slot)
    last = Window.partitionBy("source", "slot").orderBy(F.desc("occurred_at"), F.desc("item_id"))
    first = Window.partitionBy("source").orderBy("occurred_at", "item_id")
    marked = marked.withColumns({"last": F.row_number().over(last), "first": F.row_number().over(first)})
    return marked.where("slot IS NULL OR last = 1 OR first = 1").select("source", "item_id")


def size_histogram(groups: DataFrame, size: str = "n") -> DataFrame:
    n = F.col(size)
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").when(n <= 50, "11-50").otherwise("51+")
    return groups.groupBy(bucket.alias("size")).agg(F.count(F.lit(1)).alias("groups"))


def quiet_sources(runs: DataFrame, empty: Column, now: str, least_runs: int, least_days: int) -> DataFrame:
    """Sources with many empty runs and none productive for days."""
    found = runs.groupBy("source").agg(F.count_if(empty).alias("empty_runs"), F.max(F.when(~empty, F.to_date("occurred_at"))).alias("last_day"))
    return found.where((F.col("empty_runs") >= least_runs) & (F.coalesce(F.date_diff(F.lit(now).cast("date"), F.col("last_day")), F.lit(99999)) >= least_days))
