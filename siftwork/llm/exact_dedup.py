"""Exact duplicates of texts, white space aside, through an extendible-hash index on shared files. DataFrame functions only.

A record is a normalised text under a key of 64 hash bits. The directory doubles, one key bit at a time, until no bucket
holds more than its capacity; a bucket is a range of keys. The tasks that own the keys of a bucket chain the texts that
share a key and tell them apart by their bytes. What the chains hold is written to shared files, a bucket in one of them,
and each row is looked up there by its bucket, key and digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import fresh, new_folder, small_side, spill

#: Keys, and bytes of their texts, beyond which a bucket splits.
CAPACITY, CAPACITY_BYTES = 1 << 14, 64 << 20


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null becomes the empty text."""
    out = F.coalesce(text, F.lit(""))
    for char in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _cell(bits: int) -> Column:
    """The first `bits` bits of a key."""
    return F.shiftrightunsigned("key", 64 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY, capacity_bytes: int = CAPACITY_BYTES) -> tuple[DataFrame, int]:
    """keys(key, bytes), distinct -> ((cell, depth), bits): for each used cell of `bits` key bits the depth of its bucket.

    A bucket of d bits is split in two while it is overfull; the cells that share its d leading bits point to it. The
    cells are as fine as the fullest bucket needs: while one is overfull, and has more than one key, they double.
    """
    bits = 1 + math.ceil(math.log2(1 + keys.count() / capacity)) + 2
    while True:
        held = [F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")]
        cells = spill(keys.groupBy(_cell(bits).alias("cell")).agg(*held, F.min("key").alias("low"), F.max("key").alias("high")), "dedup-cells")
        over = (F.col("n") > capacity) | (F.col("b") > capacity_bytes)
        if bits == 63 or not cells.where(over & (F.col("low") < F.col("high"))).head(1):
            break
        bits = min(63, bits + 4)
    heads = cells.select("n", "b", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("d"), "cell").withColumn("head", F.expr(f"shiftright(cell, {bits} - d)"))
    full = heads.groupBy("d", "head").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(over).select("d", "head")
    split = heads.join(small_side(spill(full, "dedup-full")), ["d", "head"], "left_semi").groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    return cells.select("cell").join(small_side(split), "cell", "left").select("cell", F.coalesce("depth", F.lit(0)).alias("depth")), bits


def _facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, key, text_sha256, chars, bytes) of each row; `row` is a number of its own."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    facts = rows.select("id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256"), "chars", F.octet_length("norm").cast("long").alias("bytes"))
    return spill(facts.withColumn("row", F.monotonically_increasing_id()), "dedup-facts")


def _index(docs: DataFrame, facts: DataFrame, text_col: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, key, link, text_sha256) in shared files, and the facts with the bucket of each.

    Of rows with the same text each task sends one, so that a text held by a third of all rows costs one row a task; the
    owner of a key compares the bytes of what arrives and numbers the different texts of its chain by `link`.
    """
    depths, bits = directory(facts.groupBy("key").agg(F.max("bytes").alias("bytes")), capacity)
    depths = small_side(spill(depths, "dedup-directory"))
    bucket = F.expr(f"shiftright(shiftrightunsigned(key, {64 - bits}), {bits} - depth) * 64 + depth")
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).select(F.xxhash64("norm").alias("key"), "norm")
    placed = texts.withColumn("cell", _cell(bits)).join(depths, "cell").select(bucket.alias("bucket"), "key", "norm")
    chains = placed.groupBy("bucket", "key").agg(F.transform(F.collect_set("norm"), lambda t: F.sha2(t, 256)).alias("chain"))
    links = chains.select("bucket", "key", F.posexplode(F.array_sort("chain")).alias("link", "text_sha256"))
    path = new_folder(docs.sparkSession, "dedup-index")
    links.repartition("bucket").sortWithinPartitions("bucket", "key", "link").write.parquet(path)
    found = facts.withColumn("cell", _cell(bits)).join(depths, "cell").withColumn("bucket", bucket).drop("cell", "depth")
    return docs.sparkSession.read.schema(links.schema).parquet(path), found


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(bucket, key, link, text_sha256): one row for each distinct normalised text; link counts the texts of a key from 0."""
    return _index(docs, _facts(docs, id_col, text_col), text_col, capacity)[0]


def _judged(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row."""
    facts = _facts(docs, id_col, text_col)
    index, rows = _index(docs, facts, text_col, capacity)
    best = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"), F.col("row"))
    placed = rows.join(index, ["bucket", "key", "text_sha256"]).select("bucket", "key", "link", "id", "row", "chars", "text_sha256")
    groups = placed.groupBy("bucket", "key", "link").agg(F.min_by(F.struct("id", "row"), best).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return placed.join(groups, ["bucket", "key", "link"]).select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of `docs`: the id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts are one group. The row with the most code points stays, then the smallest
    id, null ids last. Repeated rows (same id and text) stay several rows, of which one is kept. An empty table gives
    no rows. Other columns of `docs` are not read, whatever their names.
    """
    return _judged(docs, id_col, text_col, capacity).withColumnRenamed("id", id_col)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of equal texts (see exact_groups).

    Ids all of whose rows go are taken out by an anti-join. Only for an id of which some rows go and others stay (repeated
    or null ids) are texts looked at again; of its rows with the same text and length it isn't defined which one stays.
    """
    judged = spill(_judged(docs, id_col, text_col, capacity).select("id", "kept", "text_sha256"), "dedup-judged")
    gone = fresh(docs, "gone_id")
    ids = judged.groupBy("id").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n")).where("stay < n")
    ids = spill(ids.select(F.col("id").alias(gone), (F.col("stay") > 0).alias("mixed")), "dedup-gone")
    same = docs[id_col].eqNullSafe(F.col(gone))
    out = docs.join(small_side(ids.select(gone)), same, "left_anti")
    mixed = ids.where("mixed").select(gone)
    if mixed.head(1):
        rows = docs.join(small_side(mixed), same, "left_semi").select(
            F.struct("*").alias("whole"), F.col(id_col).alias("own_id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"), F.length(F.coalesce(text_col, F.lit(""))).alias("chars")
        )
        first = rows.groupBy("own_id", "sha").agg(F.max_by("whole", "chars").alias("whole"))
        stay = judged.where("kept").join(small_side(mixed), F.col("id").eqNullSafe(F.col(gone)), "left_semi")
        first = first.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
        out = out.union(first.select([F.col("whole")[c].alias(c) for c in docs.columns]))
    return out
