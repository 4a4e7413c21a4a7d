"""Versions, labels, queues and links of stored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import text


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version, and how many versions there are; one aggregate, no sort of a key's rows."""
    found = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("row"), F.count(F.lit(1)).alias("versions"))
    return found.select(key, "row.*", "versions")


def text_of_positions(words: DataFrame, id_col: str) -> DataFrame:
    """(id, word, positions) -> (id, text): the words in the order of their positions."""
    placed = words.select(id_col, F.explode("positions").alias("pos"), "word")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return placed.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"))


def donors(rows: DataFrame, group: str, id_col: str, ready: Column) -> DataFrame:
    """(id, donor): for each row that isn't ready the ready row of its group to copy from: the group's first row if ready, else the earliest."""
    marked = rows.select(F.col(id_col), F.col(group), ready.alias("is_ready"))
    roots = marked.groupBy(group).agg(F.min(id_col).alias("root"), F.min(F.when(F.col("is_ready"), F.col(id_col))).alias("donor"))
    return marked.where(~F.col("is_ready")).join(roots.where("donor IS NOT NULL"), group).select(id_col, "donor")


def relabelled(branches: list[DataFrame], id_col: str) -> DataFrame:
    """branches of (id, label), first come first served: for each id and label the number of the first branch that has it."""
    every = None
    for i, branch in enumerate(branches):
        part = branch.select(id_col, "label", F.lit(i).alias("branch"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(id_col, "label").agg(F.min("branch").alias("branch"))


def implied(labels: DataFrame, paths: DataFrame, id_col: str) -> DataFrame:
    """(id, label): each label with all of its ancestors, by paths(node, path)."""
    return labels.join(paths, F.col("label") == F.col("node")).select(id_col, F.explode("path").alias("label")).distinct()


def remapped(rows: DataFrame, old: str, mapping: DataFrame, fallback: Column, most: int = 2) -> DataFrame:
    """`rows` with label: what mapping(old_label, new_label) says of the old one, else the first `most` of a fallback array."""
    found = rows.join(mapping, F.col(old) == F.col("old_label"), "left")
    return found.withColumn("labels", F.when(F.col("new_label").isNotNull(), F.array("new_label")).otherwise(F.slice(fallback, 1, most))).drop("old_label", "new_label")


def due(rows: DataFrame, asked: str, now: str, rules: list[Column], most: int) -> DataFrame:
    """The `most` rows that any rule calls due, those never asked first, then the longest ago."""
    wanted = rules[0]
    for rule in rules[1:]:
        wanted = wanted | rule
    return rows.where(F.coalesce(wanted, F.lit(False))).orderBy(F.col(asked).asc_nulls_first(), "item_id").limit(most)


def covered(windows: DataFrame, key: str, at: str, done: Column, least: float = 0.8) -> DataFrame:
    """(key, steady): whether each earlier window's share of done rows is at least `least` of the current one's (window 0)."""
    shares = windows.groupBy(key, at).agg(F.avg(done.cast("double")).alias("share"))
    found = shares.groupBy(key).agg(F.max(F.when(F.col(at) == 0, F.col("share"))).alias("now"), F.min(F.when(F.col(at) > 0, F.col("share"))).alias("low"))
    return found.select(key, F.coalesce(F.col("low") >= least * F.col("now"), F.lit(False)).alias("steady"))


def steps_with_shared_words(rows: DataFrame, chain: str, at: str, words: str, days: int) -> DataFrame:
    """(id, before, shared): consecutive rows of a chain within `days` days that have words in common."""
    order = Window.partitionBy(chain).orderBy(at, "item_id")
    pairs = rows.withColumns({"before": F.lag("item_id").over(order), "then": F.lag(at).over(order), "their": F.lag(words).over(order)})
    near = pairs.where(F.col("then").isNotNull() & (F.col(at) <= F.col("then") + F.expr(f"INTERVAL {days} DAYS")))
    return near.select("item_id", "before", F.size(F.array_intersect(words, "their")).alias("shared")).where("shared > 0")


def modal_shift(rows: DataFrame, key: str, hours: Column) -> DataFrame:
    """(key, shift, n): the most frequent offset of each key, the least of equally frequent ones."""
    counts = rows.groupBy(key, hours.alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by("shift", F.struct(-F.col("n"), F.col("shift"))).alias("shift"), F.max("n").alias("n"))


def supported(claims: DataFrame, evidence: DataFrame, least: int) -> DataFrame:
    """claims(claim, item_id) -> (claim, cited, known, sources, kept): what each cites, how much of it exists, and whether enough sources stand for it."""
    met = claims.join(evidence.select("item_id", "outlet"), "item_id", "left")
    found = met.groupBy("claim").agg(F.count(F.lit(1)).alias("cited"), F.count("outlet").alias("known"), F.countDistinct("outlet").alias("sources"))
    return found.withColumn("kept", (F.col("known") == F.col("cited")) & (F.col("sources") >= least))


def linked_names(rows: DataFrame, raw: str, names: DataFrame) -> DataFrame:
    """(raw, n, name): distinct raw names with how often they occur and the name of names(alias, name) whose alias is the folded raw one; null if none is."""
    folded = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    counts = rows.groupBy(F.col(raw).alias("raw"), folded.alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, F.col("fold") == F.col("alias"), "left").select("raw", "n", "name")


def without_shared_tails(rows: DataFrame, title: str, *within: str) -> DataFrame:
    """`rows`, titles without the tail after their last bar, dash or colon where two or more rows share it (among rows of the same columns `within`, if given).

    Tails are counted in one aggregate and joined back; a tail that one title alone has is part of it. Null titles stay null.
    """
    found = rows.withColumn("tail", F.when(F.col(title).rlike(text.TAILED), F.regexp_extract(title, text.TAILED, 2)))
    shared = found.where("tail IS NOT NULL").groupBy("tail", *within).agg(F.count(F.lit(1)).alias("sharers")).where("sharers > 1")
    joined = found.join(shared, ["tail", *within], "left")
    return joined.withColumn(title, F.when(F.col("sharers").isNotNull(), F.trim(F.regexp_extract(title, text.TAILED, 1))).otherwise(F.col(title))).select(*rows.columns)


def throttled(rows: DataFrame, key: str, at: str, value: str, seconds: int) -> DataFrame:
    """Readings that are recorded: a key's first, and each that differs from the last recorded one and comes `seconds` or more after it.

    What counts depends on the last recorded reading, so that a key's readings are scanned in order: sorted in its partition
    by Spark and read as a stream, of which only one row a key is held.
    """
    ordered = rows.select(key, at, value).repartition(key).sortWithinPartitions(key, at, value)

    def scan(batches):  # noqa: ANN001, ANN202
        last = None
        for batch in batches:
            keep = []
            for k, t, v in zip(batch[key], batch[at], batch[value], strict=True):
                new = last is None or last[0] != k
                if new or v != last[2] and (t - last[1]).total_seconds() >= seconds:
                    last = (k, t, v)
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch[keep]

    return ordered.mapInPandas(scan, ordered.schema)
