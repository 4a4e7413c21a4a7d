"""Benchmark passages inside documents: a prefix-filtered set join of word shingles. DataFrame functions only.

A window of an item is a set of 3-word shingles (fewer where the window has fewer words), ordered by how rare they
are in all documents. A document holds the window only if it holds each of its shingles, so the necessary prefix is
the rarest one: documents are joined on it alone. Length and position then bound where the window would lie,
and the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import fresh, small_side, spill

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a shingle.
SHINGLE = 3


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then each run of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; a null has no words."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item_id, words): each distinct run of `size` words, or all words of an item that has fewer, but not none."""
    split = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {size} + 1, 1))")
    return split.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), size).alias("words")).distinct()


def _shingles(words: str, length: int) -> Column:
    """Hashes of the runs of `length` words of a column."""
    parts = [F.col(words) if j == 0 else F.slice(words, F.lit(1 + j), F.size(words)) for j in range(length)]
    zipped = F.slice(F.arrays_zip(*[p.alias(f"c{j}") for j, p in enumerate(parts)]), F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(0)))
    return F.transform(zipped, lambda x: F.xxhash64(F.lit(length), *[x[f"c{j}"] for j in range(length)]))


def _postings(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, h, n_words, pos, key): the wanted(k, key) shingles of each row and where they are; and for each row one without a key.

    h is a hash of the text. Texts are split here once; all that follows reads these narrow rows.
    """
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("w"))
    parts = [F.col("w") if j == 0 else F.slice("w", F.lit(1 + j), F.size("w")) for j in range(max(lengths, default=1))]
    runs = split.select("id", "h", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*[x.alias(f"c{j}") for j, x in enumerate(parts)])).alias("pos", "s"))
    first = F.coalesce("pos", F.lit(0)) == 0
    hits = []
    for k in lengths:
        words = [F.col(f"s.c{j}") for j in range(k)]
        known = small_side(wanted.where(F.col("k") == k).select(F.col("key").alias(f"wanted{k}")).distinct())
        runs = runs.withColumn(f"key{k}", F.when(words[-1].isNotNull(), F.xxhash64(F.lit(k), *words))).join(known, F.col(f"key{k}") == F.col(f"wanted{k}"), "left")
        hits.append(F.col(f"wanted{k}"))
    some = first
    for hit in hits:
        some = some | hit.isNotNull()
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.when(first, F.array(F.lit(None).cast("long"))).otherwise(none), F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else none)
    return runs.where(some).select("id", "h", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), F.explode(keys).alias("key"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
) -> DataFrame:
    """One row for each row of `docs`: the id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated if n_hit > 0 and
    share * n_hit >= n_words. Null and empty texts have no words; without items nothing is hit, and items_sha256 is
    that of the empty string. Repeated rows, and rows of a repeated id, are each judged by their own words. Null
    item ids are left out of n_items and the digest. Only the named columns are read. Rows that hold the rarest shingle
    of a window are looked at again; an occurrence is then one narrow row.
    """
    wins = spill(windows_of(items, item_col, item_text_col, window).withColumn("wid", F.sha2(F.array_join("words", " "), 256)), "windows")
    texts = wins.select("wid", "words").distinct()
    lengths = sorted(r[0] for r in texts.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect())  # 1, 2 and 3 at most
    keyed = texts.select("wid", "words", F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("key")).where("false")
    for k in lengths:
        part = texts.where(F.least(F.size("words"), F.lit(SHINGLE)) == k).select("wid", "words", F.lit(k).alias("k"), F.posexplode(_shingles("words", k)).alias("at", "key"))
        keyed = keyed.union(part)
    postings = spill(_postings(docs, id_col, text_col, keyed.select("k", "key"), lengths), "postings")
    found = postings.where("key IS NOT NULL")
    rarity = small_side(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    # A shingle that no document holds rules its windows out: it counts 0, and is then the rarest.
    ranked = keyed.join(rarity, "key", "left").groupBy("wid", F.size("words").alias("len")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at")).alias("first"))
    prefix = ranked.where("first.n > 0").select("wid", "len", F.col("first.key").alias("key"), F.col("first.at").alias("at"))
    near = found.join(small_side(prefix), "key").where("pos >= at AND pos - at + len <= n_words")
    near = near.groupBy("id", "h").agg(F.collect_list(F.struct((F.col("pos") - F.col("at")).alias("start"), "len", "wid")).alias("near"))
    near = spill(near.select(F.col("id").alias("near_id"), F.col("h").alias("near_h"), "near"), "near")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.join(small_side(near), (F.col("h") == F.col("near_h")) & F.col("id").eqNullSafe(F.col("near_id")))
    held = rows.select("id", "h", words_of(F.col("text")).alias("w"), "near")
    held = held.select("id", "h", F.explode(F.expr("transform(near, x -> struct(x.start, x.len, x.wid, slice(w, x.start + 1, x.len) AS own))")).alias("x"))
    held = held.select("id", "h", "x.*").join(small_side(texts), "wid").where("own = words").select("id", "h", "start", "len", "wid").distinct()
    held = spill(held, "hits")
    covered = (
        "aggregate(array_sort(collect_set(struct(start, len))), struct(0L AS total, 0L AS upto), (a, x) -> struct("
        "a.total + greatest(0L, x.start + x.len - greatest(a.upto, cast(x.start as long))) AS total, "
        "greatest(a.upto, cast(x.start + x.len as long)) AS upto), a -> a.total)"
    )
    hits = held.groupBy("id", "h").agg(F.expr(covered).alias("n_hit"))
    owners = held.select("id", "h", "wid").distinct().join(small_side(wins.select("wid", F.col("item_id").cast("string").alias("item"))), "wid").where("item IS NOT NULL")
    owners = owners.select("id", "h", "item").distinct().groupBy("id", "h").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    judged = hits.join(owners, hits["id"].eqNullSafe(owners["id"]) & (hits["h"] == owners["h"]), "left").select(hits["id"].alias("hit_id"), hits["h"].alias("hit_h"), "n_hit", "ids")
    every = postings.where("key IS NULL")
    out = every.join(small_side(spill(judged, "judged")), every["id"].eqNullSafe(F.col("hit_id")) & (every["h"] == F.col("hit_h")), "left")
    out = out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id isn't that of a contaminated row. Rows with a null id stay."""
    bad_id = fresh(docs, "bad_id")
    bad = contamination(docs, items, id_col, text_col, **options).where(F.col("contaminated") & F.col(id_col).isNotNull())
    bad = spill(bad.select(F.col(id_col).alias(bad_id)).distinct(), "contaminated")
    return docs.join(small_side(bad), docs[id_col] == F.col(bad_id), "left_anti")
