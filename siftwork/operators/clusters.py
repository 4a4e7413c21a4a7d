"""Reports into stories: each joins the story of an earlier report within three days, by key, by likeness or by event, or starts its own.

Which report one joins depends only on earlier reports, not on the stories so far, so all choose at once; stories are the trees of these
choices. The one rule that looks at stories, that a publisher alone may not fill one, is applied to the trees until nothing changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import refs, text
from siftwork.operators.graph import components
from siftwork.sources.shared import spill

#: Hours that reports look back; hours between two reports of an event; candidates of a keyword that one looks at; least likeness of near
#: copies and of one event; reports that one publisher alone may bring a story by likeness; letters of a title that stands for itself. Fixed values.
WINDOW, EVENT_GAP, EVENT_CANDIDATES, NEAR, EVENT, ALONE, LEAST_TITLE = 72, 48, 300, 0.45, 0.35, 20, 30
#: Shingles whose hashes a task keeps; shingles or pairs that it holds at once, about; rows of a group of small blocks, about; reports of a band that a task compares with, about.
KEPT, PAIRS, GROUP, PART = 65_536, 65_536, 8_192, 4_096


def signatures(bare: Iterator[str], known: dict[str, int], hashes: np.ndarray) -> Iterator[np.ndarray]:
    """refs.minhash of the shingles of three characters of each text, whose case and punctuation are removed; `known` shingles have their hashes at that place of `hashes`."""
    multiply, add = (np.array(x, np.uint64) for x in zip(*refs.FAMILY, strict=True))
    for text_ in bare:
        shingles = {text_[i : i + 3] for i in range(len(text_) - 2)} or ({text_} if text_ else set())
        least = np.full(refs.HASHES, refs.PRIME, np.int32)
        some = list(shingles)
        for at in range(0, len(some), len(hashes)):
            part = some[at : at + len(hashes)]
            if len(known) + len(part) > len(hashes):
                known.clear()
            new = [x for x in part if x not in known]
            if new:
                x = np.array([int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % refs.PRIME for x in new], np.uint64)
                hashes[len(known) : len(known) + len(new)] = (x[:, None] * multiply + add) % np.uint64(refs.PRIME)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            least = np.minimum(least, hashes[[known[x] for x in part]].min(0))
        yield least if some else least[:0]


def signed(reports: DataFrame) -> DataFrame:
    """reports(item_id, seen_at, told_at, source, publisher, url, content_hash, title, keywords) as what the choices below need."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    title = F.coalesce("title", F.lit(""))
    rows = reports.select(
        "item_id", seconds("seen_at").alias("t"), F.floor(seconds("seen_at") / 3600).alias("hour"), F.floor(F.coalesce(seconds("told_at"), seconds("seen_at")) / 3600).alias("told"), "source", "publisher",
        text.dedup_url(F.col("url")).alias("url"), "content_hash", F.lower(title).alias("title"), F.when(F.length(F.trim(title)) >= LEAST_TITLE, F.lower(title)).alias("long_title"),
        F.array_distinct(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)).alias("keywords"), refs.bare(title).alias("bare"),
    )
    names = rows.columns[:-1]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = {}, np.empty((KEPT, refs.HASHES), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = list(signatures(part.column(len(names)).to_pylist(), known, hashes))
                sig = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], sig], [*names, "sig"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(sign, f"{kinds}, sig array<int>")


def _likest(sigs: np.ndarray, ask: np.ndarray, low: np.ndarray, high: np.ndarray, fits: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, values that agree) of each row of `ask`: the first of the likest of the rows from its `low` to `high`, of those whose number in `fits` is that near."""
    some = low < high
    ask, low, high = ask[some], low[some], high[some]
    end, out, at = np.cumsum(high - low), [], 0
    while at < len(ask):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + PAIRS, "right")))
        n = high[at:to] - low[at:to]
        starts = np.cumsum(n) - n
        row, other = np.repeat(ask[at:to], n), np.arange(n.sum()) + np.repeat(low[at:to] - starts, n)
        nth = np.repeat(np.arange(len(n)), n)
        if fits is not None:
            near = np.abs(fits[0][row] - fits[0][other]) <= fits[1]
            row, other, nth = row[near], other[near], nth[near]
        same = (sigs[row] == sigs[other]).view(np.uint64).sum(1) * np.uint64(0x0101010101010101) >> np.uint64(56)  # a byte for each value, and at most eight in a sum
        order = same.astype(np.int64) << 32 | (1 << 32) - 1 - other
        if len(row):
            new = np.flatnonzero(np.concatenate([[True], nth[1:] != nth[:-1]]))
            best = np.maximum.reduceat(order, new)
            out.append((row[new], (1 << 32) - 1 - (best & (1 << 32) - 1), best >> 32))
        at = to
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Of each row the number of its group; groups lie one after the other in `keys`."""
    new = np.zeros(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.cumsum(new)


def _since(group: np.ndarray, hour: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows `at` the place of the first row of their group that is at most WINDOW hours older; rows of a group are in the order of time."""
    hour = hour - hour.min(initial=0)
    key = group * (int(hour.max(initial=0)) + WINDOW + 2) + hour + WINDOW + 1
    return np.searchsorted(key, key[at] - WINDOW, "left") if len(at) else at


def _sigs(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.combine_chunks().flatten(), np.int32).reshape(-1, refs.HASHES)


def _spread(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with a key, in the span of WINDOW hours that they are in (own) and in the next, so that a key's long history isn't one group."""
    span = F.floor(F.col("hour") / WINDOW)
    some = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    return some.withColumn("s", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))).select("*", "s.*").drop("s")


def earliest(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """(item_id, name): the first (t, item_id) among the earlier reports with the same key that are at most WINDOW hours older."""
    first = F.min(F.struct("t", "item_id")).over(Window.partitionBy(*key, "span").orderBy("hour").rangeBetween(-WINDOW, 0))
    found = _spread(rows, key).withColumn("first", first).where("own")
    return found.where(F.col("first") < F.struct("t", "item_id")).select("item_id", F.col("first").alias(name))


def earliest_elsewhere(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The same of reports of other sources. A report whose first one is of its own source takes the next that isn't, which each report knows."""
    spread = _spread(rows.where("source IS NOT NULL"), [key])
    order = Window.partitionBy(key, "span").orderBy("t", "item_id")
    turn = spread.withColumn("turn", (F.lag("source").over(order) != F.col("source")).cast("int"))
    turn = turn.withColumn("run", F.sum(F.coalesce("turn", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.min(F.struct("t", "item_id")).over(Window.partitionBy(key, "span").orderBy("run").rangeBetween(1, 1))
    first = F.min(F.struct("t", "item_id", "source", "after")).over(Window.partitionBy(key, "span").orderBy("hour").rangeBetween(-WINDOW, 0))
    found = turn.withColumn("after", after).withColumn("first", first).where("own")
    chosen = F.when(F.col("first.source") != F.col("source"), F.struct("first.t", "first.item_id")).otherwise(F.col("first.after"))
    return found.withColumn(name, chosen).where(F.col(name) < F.struct("t", "item_id")).select("item_id", name)


def exact_choices(rows: DataFrame) -> DataFrame:
    """(item_id, parent): the first earlier report with the same link (and another source or the same title), else text, else long title."""
    kinds = [earliest_elsewhere(rows, "url", "link"), earliest(rows, ["url", "title"], "page"), earliest(rows, ["content_hash"], "content"), earliest(rows, ["long_title"], "headline")]
    out = rows.select("item_id")
    for found in kinds:
        out = out.join(found, "item_id", "left")
    return out.select("item_id", F.coalesce(F.least("link", "page"), "content", "headline")["item_id"].alias("parent")).where("parent IS NOT NULL")


def near_choices(rows: DataFrame, asked: DataFrame, least: float = NEAR) -> DataFrame:
    """(item_id, parent, similarity): of the earlier reports that share a band, the likest of NEAR or more, then the first.

    Of candidates with one signature and hour the first stands for all: it is as like, and comes first. The reports of a band are compared with its askers in
    parts of about PART, many small bands in one task's group; only the best of a part is kept.
    """
    span = F.floor(F.col("hour") / WINDOW)
    some = rows.where("size(sig) > 0")
    numbers = F.sequence(F.lit(0), F.lit(refs.HASHES // refs.ROWS - 1))
    part = lambda sig, i: F.slice(sig, i * refs.ROWS + 1, refs.ROWS)
    banded = F.inline(F.transform(numbers, lambda i: F.struct(i.alias("nth"), F.xxhash64(i, part(F.col("sig"), i)).alias("band"))))
    held = spill(some.groupBy("sig", "hour").agg(F.min(F.struct("t", "item_id")).alias("c")).withColumn("span", span), "held")
    ask = spill(some.join(asked, "item_id", "left_semi").select("item_id", "t", "sig", "hour", F.explode(F.array(span, span - 1)).alias("span")), "ask")
    held_bands, ask_bands = spill(held.select("c", "span", banded), "bands"), spill(ask.select("item_id", "t", "span", banded), "bands")
    # Bands meet before signatures are shuffled: an asker goes on with a band only if an earlier report has it, and a report only if an asker has.
    bounds = held_bands.groupBy("nth", "band", "span").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n"))
    wanted = ask_bands.groupBy("nth", "band", "span").agg(F.max(F.struct("t", "item_id")).alias("most"), F.count(F.lit(1)).alias("n2"))
    both = bounds.join(wanted, ["nth", "band", "span"]).where("least < most").withColumn("parts", F.ceil(F.col("n") / PART))
    both = spill(both.withColumn("n", F.col("n") + F.col("n2") * F.col("parts")), "both")
    askers = ask_bands.join(both, ["nth", "band", "span"]).where(F.col("least") < F.struct("t", "item_id")).select("item_id", "nth", "band", "span", "parts")
    answers = held_bands.join(both, ["nth", "band", "span"]).where(F.col("c") < F.col("most")).select("c", "nth", "band", "span", "parts")
    askers = askers.join(ask.select("item_id", "span", "t", "sig", "hour"), ["item_id", "span"])
    answers = answers.join(held.select("c", "sig", "hour"), "c").select(F.col("c.item_id").alias("item_id"), "nth", "band", "span", "parts", F.col("c.t").alias("t"), "sig", "hour")
    columns = ["nth", "span", "part", "item_id", "t", "hour", "sig", "ask"]
    askers = askers.withColumn("ask", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    answers = answers.withColumn("ask", F.lit(False)).withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")))
    rows = askers.select("band", *columns).unionByName(answers.select("band", *columns))
    groups = max(1, both.agg(F.sum("n")).first()[0] // GROUP) if both.head(1) else 1

    def compare(table: pa.Table) -> pa.Table:
        nth, span, part, ids, t, hour = (np.array(table.column(c), np.int64) for c in columns[:6])
        sigs, asks = _sigs(table.column("sig")), np.array(table.column("ask"))
        band = [sigs[np.arange(len(nth)), nth * refs.ROWS + k] for k in range(refs.ROWS)]
        order = np.lexsort((~asks, ids, t, *band, part, span, nth))  # an asker comes before the report that it is
        group = _starts(*(k[order] for k in (nth, span, part, *band)))
        asks, ids, t, hour, sigs, group = asks[order], ids[order], t[order], hour[order], sigs[order], group
        held = np.flatnonzero(~asks)  # candidates lie one after the other among these
        before = np.cumsum(~asks) - ~asks
        at = np.flatnonzero(asks)
        high = before[at]
        low = np.minimum(before[_since(group, hour, at)], high)
        both_, place = np.concatenate([sigs[held], sigs[at]]), np.arange(len(at)) + len(held)
        row, other, same = _likest(both_, place, low, high)
        row = at[row - len(held)]
        other, score = held[other], same / refs.HASHES
        hit = score >= least
        return pa.table({"item_id": ids[row[hit]], "score": score[hit], "ct": t[other[hit]], "cid": ids[other[hit]]})

    found = rows.withColumn("g", F.pmod(F.xxhash64("nth", "band", "span", "part"), F.lit(groups))).drop("band").groupBy("g").applyInArrow(compare, "item_id long, score double, ct long, cid long")
    return _best(found)


def _best(found: DataFrame) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("ct")).alias("ct"), (-F.col("cid")).alias("cid"))).alias("b")
    return found.groupBy("item_id").agg(best).select("item_id", (-F.col("b.cid")).alias("parent"), F.col("b.score").alias("similarity"))


def event_choices(rows: DataFrame, asked: DataFrame, least: float = EVENT, candidates: int = EVENT_CANDIDATES) -> DataFrame:
    """(item_id, parent, similarity): of the `candidates` earlier reports of each of its keywords, those told within EVENT_GAP hours: the likest, then the first.

    Reports of a keyword are numbered in the order of time, hour by hour, and put in blocks of `candidates`; a block is compared with itself and
    with the one before, many blocks in one task's group. So the work grows with the reports, also of a keyword that most have.
    """
    words = rows.where("size(sig) > 0").select("item_id", "t", "hour", "told", F.explode("keywords").alias("word")).join(asked.withColumn("ask", F.lit(True)), "item_id", "left")
    words = spill(words.withColumn("ask", F.coalesce("ask", F.lit(False))), "words")
    words = words.join(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("some")).where("n > 1 AND some").select("word"), "word")
    hours = words.groupBy("word", "hour").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("word").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.floor((F.sum("n").over(Window.partitionBy("word")) - 1) / candidates)
    ranked = words.withColumn("nth", F.row_number().over(Window.partitionBy("word", "hour").orderBy("t", "item_id"))).join(hours.withColumns({"start": before, "most": most}).drop("n"), ["word", "hour"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("nth") - 1).withColumn("own", F.floor(F.col("rank") / candidates))
    placed = ranked.withColumn("block", F.explode(F.array("own", F.col("own") + 1))).where("block <= most")
    placed = spill(placed.select("word", "block", "item_id", "t", "hour", "told", "rank", (F.col("ask") & (F.col("own") == F.col("block"))).alias("ask")), "placed")
    groups = max(1, placed.count() // GROUP)
    full = placed.join(rows.select("item_id", "sig"), "item_id").withColumn("g", F.pmod(F.xxhash64("word", "block"), F.lit(groups)))

    def compare(table: pa.Table) -> pa.Table:
        t, ids, hour, told, rank, block = (np.array(table.column(c), np.int64) for c in ("t", "item_id", "hour", "told", "rank", "block"))
        word = np.array(table.column("word").combine_chunks().dictionary_encode().indices, np.int64)
        order = np.lexsort((rank, block, word))
        t, ids, hour, told = t[order], ids[order], hour[order], told[order]
        group, at = _starts(word[order], block[order]), np.flatnonzero(np.array(table.column("ask"))[order])
        low = np.maximum(_since(group, hour, at), at - candidates)
        row, other, same = _likest(_sigs(table.column("sig"))[order], at, low, at, (told, EVENT_GAP))
        score = same / refs.HASHES
        hit = score >= least
        return pa.table({"item_id": ids[row[hit]], "score": score[hit], "ct": t[other[hit]], "cid": ids[other[hit]]})

    return _best(full.groupBy("g").applyInArrow(compare, "item_id long, score double, ct long, cid long"))


def choices(rows: DataFrame) -> DataFrame:
    """(item_id, t, publisher, parent, relation, similarity) of every report; a seed has no parent."""
    exact = spill(exact_choices(rows), "exact")
    rest = rows.select("item_id").join(exact, "item_id", "left_anti")
    near = spill(near_choices(rows, rest), "near")
    event = event_choices(rows, rest.join(near, "item_id", "left_anti"))
    found = exact.select("item_id", "parent", F.lit("exact").alias("relation"), F.lit(1.0).alias("similarity"))
    found = found.union(near.select("item_id", "parent", F.lit("near"), "similarity")).union(event.select("item_id", "parent", F.lit("event"), "similarity"))
    return rows.select("item_id", "t", "publisher").join(found, "item_id", "left").select("item_id", "t", "publisher", "parent", F.coalesce("relation", F.lit("seed")).alias("relation"), "similarity")


def _trees(chosen: DataFrame) -> DataFrame:
    """`chosen` with `story`: the seed that a report's choices lead to."""
    groups = components(chosen.where("parent IS NOT NULL").select(F.col("item_id").alias("a"), F.col("parent").alias("b")))
    rows = chosen.join(groups.select(F.col("node").alias("item_id"), F.col("root").alias("grp")), "item_id", "left").withColumn("grp", F.coalesce("grp", "item_id"))
    seeds = rows.where("parent IS NULL").select("grp", F.col("item_id").alias("story"))
    return rows.join(seeds, "grp").drop("grp")


def _refused(rows: DataFrame, alone: int) -> DataFrame:
    """(item_id): reports that come by likeness to a story that already has `alone`, all of their own publisher.

    Where a report's choice is among the first `alone`, or where it is the first refused of its story, that is certain; others may have left
    with a report that they chose, and are looked at again. The first ones are found with partial limits, not by a sort of a story's reports.
    """
    at = F.struct("t", "item_id")
    first = rows.groupBy("story").agg(F.min_by("publisher", at).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > alone)
    full = rows.join(first, "story")
    other = full.groupBy("story").agg(F.min(F.when(~F.col("publisher").eqNullSafe(F.col("first")), at)).alias("other"))
    head = full.withColumn("nth", F.row_number().over(Window.partitionBy("story").orderBy("t", "item_id"))).where(F.col("nth") <= alone)
    last = head.groupBy("story").agg(F.max(at).alias("last"))
    late = full.join(last, "story").join(other, "story").where((at > F.col("last")) & (F.col("other").isNull() | (at <= F.col("other"))) & F.col("publisher").eqNullSafe(F.col("first")))
    late = late.where("relation IN ('near', 'event')").select("story", "item_id", "t", "parent")
    sure = late.join(head.select(F.col("item_id").alias("parent")), "parent", "left_semi").select("item_id")
    return sure.union(late.groupBy("story").agg(F.min(at).alias("at")).select("at.item_id")).distinct()


def stories(reports: DataFrame, alone: int = ALONE) -> DataFrame:
    """(item_id, story, relation, similarity) of every report; a story is named by the report that started it.

    reports(item_id, seen_at, told_at, source, publisher, url, content_hash, title, keywords); item ids are unique, only they and seen_at may not be null.
    Of reports seen in the same second the smaller id is earlier; hours are counted whole. A null or empty title is like none, null
    keys are equal to none, a null publisher is one publisher. An empty table gives no rows.
    """
    rows = spill(choices(spill(signed(reports), "signed")), "choices")
    while True:
        placed = spill(_trees(rows), "trees")
        refused = spill(_refused(placed, alone), "refused")
        if not refused.head(1):
            return placed.select("item_id", "story", "relation", "similarity")
        gone = refused.withColumn("gone", F.lit(True))
        kept = placed.drop("story").join(gone, "item_id", "left")
        null = lambda c: F.when(F.col("gone").isNull(), F.col(c)).alias(c)
        rows = spill(kept.select("item_id", "t", "publisher", null("parent"), F.coalesce(F.when(F.col("gone"), "seed"), "relation").alias("relation"), null("similarity")), "choices")
