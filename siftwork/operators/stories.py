"""One story in several posts: keys, duplicate roots, bands of alike titles, blocked pairs and what a story adds up to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import refs
from siftwork.operators.graph import components, contracted
from siftwork.sources.shared import small_side, spill

#: Characters from which a text and a title stand for a story, of a lead, and of the title that a body may open with. Fixed values.
LEAST_TEXT, LEAST_TITLE, LEAD, OPENING = 40, 30, 120, 60
#: Rows of a band that a block holds, about; pairs that are compared at once.
BLOCK, CHUNK = 1_024, 100_000


def plain(text: Column) -> Column:
    """Lower case; links with what they were split into, @names and #tags removed; all but letters, digits and _ one space."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+(\s\S+){0,2}", " ")
    low = F.regexp_replace(low, r"(^|[^\p{L}\p{N}_])[@#][\p{L}\p{N}_.-]+", "$1 ")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "))


def dedup_keys(posts: DataFrame) -> DataFrame:
    """(item_id, text_key, title_key, lead_key, lead_title): what two posts of one story have in common; null where too short to tell."""
    digest = lambda x: F.substring(F.sha2(x, 256), 1, 32)
    rows = posts.select("item_id", plain(F.col("title")).alias("t"), plain(F.col("text")).alias("b"))
    opening = (F.col("t") != "") & F.col("b").startswith(F.substring("t", 1, OPENING))
    return rows.select(
        "item_id",
        F.when(F.length("t") + F.length("b") >= LEAST_TEXT, digest(F.concat_ws(" | ", "t", "b"))).alias("text_key"),
        F.when(F.length("t") >= LEAST_TITLE, digest(F.col("t"))).alias("title_key"),
        F.when(F.length("b") >= LEAST_TEXT, digest(F.substring("b", 1, LEAD))).alias("lead_key"),
        opening.alias("lead_title"),
    )


def duplicate_roots(keys: DataFrame) -> DataFrame:
    """(item_id, root, matched_by): the earliest earlier post with the same text, else with the same title and a body that agrees.

    Bodies agree where one has no lead, one opens with the title, or the leads are the same. The candidates of each kind
    are an equi-join on its key; as only the least one counts, each is a least id over the key, so that no group's pairs arise.
    """
    open_ended = F.col("lead_key").isNull() | F.col("lead_title")
    own = spill(keys.withColumn("open", open_ended), "keys")  # the texts are read for them once
    by_text = own.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("item_id").alias("text_root"))
    by_title = own.where("title_key IS NOT NULL").groupBy("title_key").agg(F.min("item_id").alias("any_root"), F.min(F.when(F.col("open"), F.col("item_id"))).alias("open_root"))
    by_lead = own.where("title_key IS NOT NULL AND lead_key IS NOT NULL").groupBy("title_key", "lead_key").agg(F.min("item_id").alias("lead_root"))
    found = own.join(by_text, "text_key", "left").join(by_title, "title_key", "left").join(by_lead, ["title_key", "lead_key"], "left")
    title_root = F.when(F.col("open"), F.col("any_root")).otherwise(F.least("open_root", "lead_root"))
    earlier = lambda x: F.when(x < F.col("item_id"), x)
    text, title = earlier(F.col("text_root")), earlier(title_root)
    return found.select("item_id", F.coalesce(text, title).alias("root"), F.when(text.isNotNull(), "text").when(title.isNotNull(), "title").alias("matched_by"))


def signed_titles(posts: DataFrame) -> DataFrame:
    """(item_id, title, sig): the first post of each distinct title, with the title's signature."""
    first = posts.where("title <> ''").groupBy("title").agg(F.min("item_id").alias("item_id"))
    return first.select("item_id", "title", refs.minhash(refs.char_shingles(F.col("title"))).alias("sig")).where("size(sig) > 0")


def alike_signatures(signed: DataFrame, least: float) -> DataFrame:
    """signed(item_id, sig) -> (item_id, leader, similarity): each two that share a band and agree in `least` or more, the later beside the earlier.

    Only bands that two rows have are kept before signatures are shuffled, as 32 bits a value. A band's rows are cut in blocks of BLOCK by a hash; two blocks are compared as
    matrices, in a stream over sorted rows, so that a hot band is many small comparisons. A pair is told by the first band that it shares.
    """
    numbers = F.sequence(F.lit(0), F.lit(refs.HASHES // refs.ROWS - 1))
    hashed = F.transform(numbers, lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("sig", i * refs.ROWS + 1, refs.ROWS)).alias("key")))
    keys = spill(signed.select("item_id", F.inline(hashed)), "bands")
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = keys.join(shared, ["band", "key"]).withColumn("side", F.pmod(F.xxhash64("item_id", F.lit(7)), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other"))
    placed = met.select("item_id", "band", "key", "p", "q", "side").join(signed.select("item_id", F.col("sig").cast("array<int>").alias("sig")), "item_id")
    placed = placed.repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q").select("item_id", "band", "key", "p", "q", "side", "sig")

    def pairs(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, band, p, q, side = (np.array(table.column(c), np.int64) for c in ("item_id", "band", "p", "q", "side"))
        sigs = np.array(table.column("sig").combine_chunks().flatten(), np.int32).reshape(len(ids), -1)
        later = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(ids)) - 1  # rows of the group after each
        total = np.concatenate([[0], np.cumsum(later)])
        for at in range(0, int(total[-1]), CHUNK):
            nth = np.arange(at, min(at + CHUNK, int(total[-1])))
            i = np.searchsorted(total, nth, "right") - 1
            j = i + 1 + nth - total[i]
            cross = (p[i] == q[i]) | (side[i] != side[j])
            i, j = i[cross], j[cross]
            same = sigs[i] == sigs[j]
            score = same.mean(1)
            close = score >= least
            i, j, score, same = i[close], j[close], score[close], same[close]
            whole = same.reshape(len(i), same.shape[1] // refs.ROWS, refs.ROWS).all(2)
            first = whole.any(1) & (whole.argmax(1) == band[i])
            a, b = ids[i[first]], ids[j[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(score[first])], ["item_id", "leader", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = np.stack([np.array(table.column(c), np.int64) for c in ("band", "key", "p", "q")])
            cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            rest = table.slice(cuts[-1])  # the last group may go on in the next batch
            if len(cuts) > 1:
                yield from pairs(table.slice(0, cuts[-1]), cuts)
        if rest is not None:
            yield from pairs(rest, np.array([0, rest.num_rows]))

    return placed.mapInArrow(run, "item_id long, leader long, similarity double")


def alike_titles(posts: DataFrame, least: float = 0.45) -> DataFrame:
    """(item_id, leader, similarity): each two distinct titles that share a band and whose signatures agree in `least` or more, the later
    title's first post beside the earlier one's; and each further post of a title beside its first, with 1.

    So all posts of equal titles are there, without their pairs. Signatures are written once. Empty titles are alike to none; titles without letters only to equal ones.
    """
    near = alike_signatures(spill(signed_titles(posts).select("item_id", "sig"), "signatures"), least)
    own = spill(posts.where("title <> ''").select("item_id", "title"), "titles")
    firsts = own.groupBy("title").agg(F.min("item_id").alias("leader"))
    copies = own.join(firsts, "title").where("leader < item_id").select("item_id", "leader", F.lit(1.0).alias("similarity"))
    return near.union(copies)


def story_clusters(edges: DataFrame) -> DataFrame:
    """(item_id, story): the components of item_id and leader."""
    return components(contracted(edges.select(F.col("item_id").alias("a"), F.col("leader").alias("b")))).select(F.col("node").alias("item_id"), F.col("root").alias("story"))


def reference_groups(rows: DataFrame, id_col: str, refs_col: str) -> DataFrame:
    """(id, group): rows that identifiers hold together, each named by the least id; a hot identifier adds one edge a row.

    Identifiers are found once. The least rows of a row's identifiers are linked to the least of them, so that components are made of the distinct links
    of those alone; all other rows take the group of their least one.
    """
    held = spill(rows.select(F.col(id_col).alias("id"), F.explode(refs_col).alias("ref")), "refs")
    first = spill(held.groupBy("ref").agg(F.min("id").alias("b")), "firsts")
    linked = spill(held.join(small_side(first), "ref").groupBy("id").agg(F.min("b").alias("least"), F.collect_set("b").alias("bs")), "linked")
    links = linked.select(F.explode("bs").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    groups = small_side(spill(components(links), "groups"))
    named = spill(linked.join(groups, F.col("least") == F.col("node"), "left").select("id", F.coalesce("root", "least").alias("root")).where("id <> root"), "named")
    return named.select(F.col("id").alias(id_col), F.col("root").alias("group")).union(named.select("root", F.col("root").alias("again")).distinct())


def story_folds(posts: DataFrame) -> DataFrame:
    """One row a story (or storyless post): posts, outlets, tracks, first and last time, and the most relevant post."""
    key = F.coalesce("story", -F.col("item_id"))
    best = F.struct(F.coalesce("relevance", F.lit(-1)), "occurred_at", "item_id")
    return posts.groupBy(key.alias("fold")).agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("outlet").alias("outlets"), F.countDistinct("track").alias("tracks"),
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.max_by("item_id", best).alias("representative"),
    )


def within(left: DataFrame, right: DataFrame, key: str, days: int, left_id: str, right_id: str, at: str = "occurred_at") -> DataFrame:
    """Rows of `left` with the number of rows of `right` of the same key up to `days` days later, and the first of those.

    Both sides meet on the key and on spans of `days` days, so that neither a long history nor the spans' edges cost
    a comparison with all of a key's rows.
    """
    span = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / (days * 86_400))
    asked = left.select(F.col(key).alias("k"), F.col(left_id).alias("l"), F.col(at).alias("from_at"))
    asked = asked.withColumn("span", F.explode(F.array(span(F.col("from_at")), span(F.col("from_at")) + 1)))
    held = right.select(F.col(key).alias("rk"), F.col(right_id).alias("r"), F.col(at).alias("then")).withColumn("rspan", span(F.col("then")))
    close = (F.col("k") == F.col("rk")) & (F.col("span") == F.col("rspan")) & (F.col("then") >= F.col("from_at"))
    close = close & (F.col("then") <= F.col("from_at") + F.expr(f"INTERVAL {days} DAYS"))
    met = asked.join(held, close).groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("then", "r")).alias("first"))
    return met.select(F.col("l").alias(left_id), "n", F.col("first.r").alias("first_id"))


def canonical_words(rows: DataFrame, words: str, aliases: DataFrame, id_col: str) -> DataFrame:
    """(id, keys): the canonical spelling of each word, where aliases(alias, canonical) has one, distinct, in order of first place."""
    placed = rows.select(id_col, F.posexplode(words).alias("pos", "word"))
    named = placed.join(aliases, F.col("word") == F.col("alias"), "left").select(id_col, "pos", F.coalesce("canonical", "word").alias("key"))
    first = named.groupBy(id_col, "key").agg(F.min("pos").alias("pos"))
    return first.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("keys"))


def party_pairs(names: DataFrame) -> DataFrame:
    """names(name) -> (a, b), a < b: spellings of one party, met in blocks of the first three letters; each distinct name once."""
    own = names.select("name").distinct().select("name", F.substring(F.array_join(refs.party_words(F.col("name")), ""), 1, 3).alias("block")).where("block <> ''")
    other = own.select(F.col("name").alias("b"), "block")
    pairs = own.withColumnRenamed("name", "a").join(other, "block").where("a < b")
    return pairs.where(refs.same_party(F.col("a"), F.col("b"))).select("a", "b")


def others_in_story(posts: DataFrame) -> DataFrame:
    """For each post of a story how many others of the story come from other outlets: two counts, no self-join."""
    both = posts.where("story IS NOT NULL")
    n, own = F.count(F.lit(1)).over(Window.partitionBy("story")), F.count(F.lit(1)).over(Window.partitionBy("story", "outlet"))
    return both.select("item_id", (n - own).alias("others"))
