"""Reports of the same deal: blocks of parties and sizes, pairs within three weeks, groups, and who leads a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import refs
from siftwork.operators.graph import components, contracted
from siftwork.sources.shared import small_side, spill

#: Kinds whose two sides both tell deals apart; days within which reports of one deal come; ratio of their sizes; from which size, and within
#: which ratio, size alone tells where names are in other scripts; the name of an actor that isn't told. Fixed values.
PAIRED = ("partnership", "joint_venture", "licensing")
DAYS, SIZE_RATIO, BIG_USD, BIG_RATIO = 21, 1.15, 10e9, 1.02
UNDISCLOSED = "미공개"
#: Bands of sizes that have no logarithm, beyond those of any that has; spans of undated reports, and of all at once.
ZERO, UNSIZED, UNDEFINED, ENDLESS = 100_000, 100_010, 100_020, 100_030
UNDATED, ALL = 1_000_000, 2_000_000
SCRIPTS = ("hangul", "cjk", "latin")
_CJK = "[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3]"


def script(name: Column) -> Column:
    """hangul, cjk or latin: names in two scripts can't be compared."""
    return F.when(name.rlike("[\\uac00-\\ud7a3]"), "hangul").when(name.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff]"), "cjk").otherwise("latin")


def _party(name: Column, key: Column) -> Column:
    words = refs.party_words(name)
    return refs.bound(words, lambda w: F.struct(w.alias("words"), F.array_join(w, "").alias("fold"), key.alias("key"), script(F.coalesce(name, F.lit(""))).alias("script")))


def _match(a: Column, b: Column) -> Column:
    """Whether two parties may be one: registry keys decide where both have one, else spellings, or a key that is the other's folded name."""
    fa, fb, wa, wb = a["fold"], b["fold"], a["words"], b["words"]
    heads = lambda short, long, ws, wl: (
        (F.length(short) <= F.length(long))
        & long.startswith(short)
        & F.when(short.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3]"), F.length(short) >= 3).otherwise((F.length(short) >= 4) & (F.slice(wl, F.lit(1), F.greatest(F.size(ws), F.lit(0))) == ws))
    )
    same = (fa != "") & (fb != "") & ((fa == fb) | heads(fa, fb, wa, wb) | heads(fb, fa, wb, wa))
    keyed = (a["key"] == fb) | (b["key"] == fa)
    return F.when(a["key"].isNotNull() & b["key"].isNotNull(), a["key"] == b["key"]).otherwise(same | F.coalesce(keyed, F.lit(False)))


def prepared(reports: DataFrame) -> DataFrame:
    """reports(deal_id, kind, actor, actor_key, counterparty, counterparty_key, amount_usd, announced_on) with `parties`, whom a deal is about.

    That is both sides of a paired kind, in the order of their keys or folded names; else the counterparty, or the actor where there is none.
    """
    actor, other = _party(F.col("actor"), F.col("actor_key")), _party(F.col("counterparty"), F.col("counterparty_key"))
    rows = reports.withColumn("a", actor).withColumn("c", F.when(F.coalesce("counterparty", F.lit("")) != "", other).otherwise(F.col("a")))
    ident = lambda p: F.coalesce(p["key"], p["fold"])
    both = F.when(F.coalesce("counterparty", F.lit("")).isin("") | (F.col("actor").eqNullSafe(F.col("counterparty")) & F.col("actor_key").eqNullSafe(F.col("counterparty_key"))), F.array("a"))
    both = both.when(ident(F.col("a")) <= ident(F.col("c")), F.array("a", "c")).otherwise(F.array("c", "a"))
    return rows.withColumn("parties", F.when(F.col("kind").isin(*PAIRED), both).otherwise(F.array("c"))).drop("a", "c")


def _blocks() -> Column:
    """Where a report looks for others by its parties: first letters and key of each."""
    letters = F.transform("parties", lambda p: F.concat(F.lit("p:"), F.substring(p["fold"], 1, 3)))
    keys = F.transform(F.filter("parties", lambda p: p["key"].isNotNull()), lambda p: F.concat(F.lit("k:"), p["key"]))
    return F.array_except(F.concat(letters, keys), F.array(F.lit("p:")))


def _grid() -> Column:
    """Where a big report looks for others by its size: two overlapping grids."""
    size = F.log10("amount_usd")
    return F.array(F.floor(size * 10), F.floor((size + 0.05) * 10))


def _band(amount: Column, ratio: float) -> Column:
    """Sizes of one band are within `ratio` of each other. Unsized, zero, infinite and undefined ones have bands of their own, negative ones are alike to none."""
    odd = F.when(amount.isNull(), UNSIZED).when(amount == 0, ZERO).when(F.isnan(amount), UNDEFINED).when(amount == math.inf, ENDLESS).when(amount < 0, F.lit(None))
    return odd.otherwise(F.floor(F.log(amount) / _width(ratio))).cast("long")


def _width(ratio: float) -> float:
    return math.log(ratio) * (1 - 1e-9)


def _bands(lo: Column, hi: Column, band: Column, ratio: Column) -> Column:
    """All bands that may have sizes within `ratio` of some from `lo` to `hi`."""
    at = lambda x, way: F.floor((F.log(x) + way * F.log(ratio)) / (F.log(ratio) * (1 - 1e-9)) + way * 1e-6).cast("long")
    return F.when(F.abs(band) >= ZERO, F.array(band)).otherwise(F.sequence(at(lo, -1), at(hi, 1)))


def _sides(named: DataFrame) -> DataFrame:
    """(who, kind, parties, v, c, variant, cls, script): each spelling of a deal's sides.

    v and c name each party: by its words and key, and by its key or else its folded name. variant and cls do so for the parties and the kind at once. Those of
    one cls match each other; it is null for those that don't match even themselves. script is that of one party without a key.
    """
    rows = prepared(named.dropDuplicates(["who"]))
    v = F.transform("parties", lambda p: F.concat(F.array_join(p["words"], " "), F.lit("\n"), F.coalesce(F.concat(F.lit("="), p["key"]), F.lit(""))))
    c = F.transform("parties", lambda p: F.when(p["key"].isNotNull(), F.concat(F.lit("k:"), p["key"])).when(p["fold"] != "", F.concat(F.lit("f:"), p["fold"])))
    rows = rows.withColumn("v", v).withColumn("c", c)
    whole = F.col("kind").isNotNull() & ~F.exists("c", F.isnull)
    lone = F.col("kind").isNotNull() & (F.size("parties") == 1) & F.get("parties", F.lit(0))["key"].isNull()
    return rows.select(
        "who", "kind", "parties", "v", "c", F.xxhash64(F.lit("v"), "kind", "v", F.size("v")).alias("variant"), F.when(whole, F.xxhash64(F.lit("c"), "kind", "c", F.size("c"))).alias("cls"),
        F.when(lone, F.get("parties", F.lit(0))["script"]).alias("script"),
    )


def _party_pairs(sides: DataFrame) -> DataFrame:
    """(v, w): parties of other keys or folded names that match, both ways.

    They meet by equal tokens: a name asks for names that it starts with, and for itself with a key; a key for names that it is. Two keys decide by themselves.
    """
    parties = sides.select(F.explode(F.arrays_zip("v", "c", "parties")).alias("p")).select("p.v", "p.c", "p.parties").groupBy("v").agg(F.first("c").alias("c"), F.first("parties").alias("p"))
    parties = spill(parties, "parties")
    words, fold, key = F.col("p.words"), F.col("p.fold"), F.col("p.key")
    heads = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), ""))).otherwise(F.array().cast("array<string>"))
    letters = F.when(fold.rlike(_CJK) & (F.length(fold) > 3), F.transform(F.sequence(F.lit(3), F.length(fold) - 1), lambda i: F.substring(fold, F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    heads = F.filter(F.array_distinct(F.concat(heads, letters)), lambda x: F.length(x) >= 3)
    bare = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("0:"), x))
    keyed = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("1:"), x))
    asks = F.when(key.isNull(), F.concat(bare(heads), keyed(F.concat(heads, F.array(fold))))).otherwise(bare(F.array_distinct(F.concat(heads, F.array(fold, key)))))
    asked = parties.select("v", "c", "p", F.explode(asks).alias("token"))
    held = parties.select(F.col("v").alias("w"), F.col("c").alias("d"), F.col("p").alias("q"), F.concat(F.when(key.isNull(), "0:").otherwise("1:"), fold).alias("token"))
    met = asked.join(held, "token").where((F.col("v") != F.col("w")) & ~F.coalesce(F.col("c") == F.col("d"), F.lit(False)) & _match(F.col("p"), F.col("q"))).select("v", "w")
    return met.union(met.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct()


def _pairs(sides: DataFrame) -> DataFrame:
    """(variant, other, meet): variants of two classes whose parties match, both ways, and whether their blocks of parties let them meet."""
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    known = sides.where("kind IS NOT NULL").dropDuplicates(["variant"]).select("variant", "cls", "kind", at("v", 0).alias("v1"), at("v", 1).alias("v2"), "c", F.size("v").alias("n"), _blocks().alias("blocks"))
    parties = spill(_party_pairs(sides), "party-pairs")
    own = sides.select(F.explode(F.arrays_zip("v", "c")).alias("p")).where("p.c IS NOT NULL").select("p.v", F.concat(F.lit("c:"), F.col("p.c")).alias("token")).distinct()
    none = sides.sparkSession.range(1).select(F.lit("").alias("v"), F.lit("").alias("token"))
    tokens = own.union(parties.select("v", F.concat(F.lit("v:"), F.col("w")))).union(none)
    asked = known.join(tokens.toDF("v1", "t1"), "v1").join(tokens.toDF("v2", "t2"), "v2").select("variant", "kind", "t1", "t2", "cls", "blocks")
    both = lambda v, i: F.filter(F.array(F.concat(F.lit("v:"), F.col(v)), F.concat(F.lit("c:"), F.get("c", F.lit(i)))), F.isnotnull)
    held = known.select(F.col("variant").alias("other"), F.col("cls").alias("cls2"), F.col("blocks").alias("blocks2"), "kind", "v2", "c", F.explode(both("v1", 0)).alias("t1"))
    held = held.withColumn("t2", F.explode(F.when(F.col("v2") == "", F.array(F.lit(""))).otherwise(both("v2", 1))))
    met = asked.where("NOT (t1 LIKE 'c:%' AND (t2 = '' OR t2 LIKE 'c:%'))").join(held, ["kind", "t1", "t2"])
    return met.select("variant", "other", F.arrays_overlap("blocks", "blocks2").alias("meet"))


def _cells(days: DataFrame, key: str) -> DataFrame:
    """days(node, span, band, day, lo, hi) as one row for each node and `key`, with an array of its days, which are DAYS + 1 at most."""
    own = days.groupBy("node", F.col(key).alias("key"), "span", "band", "day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("day").alias("first"), F.max("day").alias("last")]
    return own.groupBy("node", "key", "span", "band").agg(*ends, F.collect_list(F.struct("day", "lo", "hi")).alias("days"))


def _touch() -> Column:
    """Whether some report of cell l and some of cell r are near in days and sizes. Where only one of the two is open, the cells' ends tell."""
    col = lambda side: lambda c: F.col(f"{side}.{c}")
    l, r = col("l"), col("r")  # noqa: E741
    fits = lambda a, b: b <= SIZE_RATIO * a
    sizes = F.when(l("band") == r("band"), True).when(l("band") < r("band"), fits(l("hi"), r("lo"))).otherwise(fits(r("hi"), l("lo")))
    near = F.coalesce(F.greatest(r("first") - l("last"), l("first") - r("last")) <= DAYS, F.lit(True))
    plain = (l("band") == r("band")) | (l("span") == r("span")) | l("first").isNull() | r("first").isNull()
    some = lambda low, high: F.exists(low("days"), lambda a: F.exists(high("days"), lambda b: (F.abs(a["day"] - b["day"]) <= DAYS) & fits(a["hi"], b["lo"])))
    return sizes & near & F.when(plain, True).when(l("band") < r("band"), some(l, r)).otherwise(some(r, l))


def _links(asked: DataFrame, cells: DataFrame, own: bool) -> DataFrame:
    """(a, b): nodes of `asked` and of `cells` with the same key that touch. If the two are one table (own), each pair is looked at from one side."""
    spread = lambda df: df.withColumn("band2", F.explode(_bands(F.col("lo"), F.col("hi"), F.col("band"), F.lit(SIZE_RATIO))))
    dated, loose = spread(asked.where(f"span <> {UNDATED}")).withColumn("span2", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1))), spread(asked.where(f"span = {UNDATED}"))
    if own:
        dated = dated.where("band2 > band OR band2 = band AND span2 > span")
    same, band = F.col("l.key") == F.col("r.key"), F.col("l.band2") == F.col("r.band")
    out = dated.alias("l").join(cells.alias("r"), same & band & (F.col("l.span2") == F.col("r.span"))).where(_touch()).select("l.node", "r.node")
    out = out.union(loose.alias("l").join(cells.alias("r"), same & band).where(_touch()).select("l.node", "r.node"))
    if not own:
        held = spread(cells.where(f"span = {UNDATED}"))
        out = out.union(asked.where(f"span <> {UNDATED}").alias("l").join(held.alias("r"), same & (F.col("l.band") == F.col("r.band2"))).where(_touch()).select("l.node", "r.node"))
    return out.toDF("a", "b")


def _reached(points: DataFrame, others: DataFrame) -> DataFrame:
    """(a, b): links that hold together what links of points(key, node, amount_usd, day, span, grid, ratio) to those of other keys do; others(key, other), both ways.

    A point is linked to the nearest size of each band, grid and day only: the others of these that it is alike to are linked to the nearest in its own.
    """
    bands = F.when(F.col("ratio") == SIZE_RATIO, _band(F.col("amount_usd"), SIZE_RATIO)).otherwise(_band(F.col("amount_usd"), BIG_RATIO))
    points = spill(points.withColumn("band", bands).distinct(), "points")
    ends = [f(c, "amount_usd").alias(f"{n}_{c}") for n, f in (("lo", F.min_by), ("hi", F.max_by)) for c in ("node", "amount_usd")]
    held = points.groupBy("key", "grid", "span", "band", "day").agg(*ends)
    held = held.union(points.groupBy("key", "grid", "band").agg(*ends).withColumn("span", F.lit(ALL).cast("long")).withColumn("day", F.lit(None).cast("int")).select(held.columns))
    spans = F.when(F.col("day").isNull(), F.array(F.lit(ALL).cast("long"))).otherwise(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1, F.lit(UNDATED).cast("long")))
    x = F.col("amount_usd")
    asks = points.join(others, "key").withColumn("key", F.col("other")).withColumn("span2", F.explode(spans)).withColumn("band2", F.explode(_bands(x, x, F.col("band"), F.col("ratio"))))
    met = asks.alias("l").join(held.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.span2") == F.col("r.span")) & (F.col("l.band2") == F.col("r.band")))
    nearest = lambda c: F.when(F.col("r.band") >= F.col("l.band"), F.col(f"r.lo_{c}")).otherwise(F.col(f"r.hi_{c}"))
    y = nearest("amount_usd")
    near = F.coalesce(F.abs(F.col("l.day") - F.col("r.day")) <= DAYS, F.lit(True)) & (F.greatest(F.col("l.amount_usd"), y) <= F.col("l.ratio") * F.least(F.col("l.amount_usd"), y))
    met = met.where(near & F.coalesce(F.arrays_overlap("l.grid", "r.grid"), F.lit(True)))
    return met.select(F.col("l.node").alias("a"), nearest("node").alias("b"))


def _fits(grouped: DataFrame, sides: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): groups of unsized reports, each with the only group that has sized reports of the same parties within DAYS of it.

    What is asked is the least and the most group of each class or matching variant within DAYS of a day, so that its reports aren't met one by one.
    """
    asked = grouped.where("NOT sized").select("variant", "day", "grp").distinct()
    reach = sides.where("cls IS NOT NULL").select("variant", F.col("cls").alias("source")).distinct().union(pairs.where("meet").select("variant", F.col("other").alias("source")))
    asks = spill(asked.select("variant", "day").distinct().join(reach, "variant"), "asks")
    sized = grouped.where("sized").select("cls", "variant", "day", "grp")
    held = sized.where("cls IS NOT NULL").select(F.col("cls").alias("source"), "day", "grp").union(sized.select("variant", "day", "grp"))
    held = spill(held.groupBy("source", "day").agg(F.min("grp").alias("least"), F.max("grp").alias("most")), "held")
    ends = [F.min("least").alias("least"), F.max("most").alias("most")]
    days = held.union(asks.select("source", "day", F.lit(None).cast("long"), F.lit(None).cast("long"))).where("day IS NOT NULL").groupBy("source", "day").agg(*ends)
    around = Window.partitionBy("source").orderBy("day").rangeBetween(-DAYS, DAYS)
    days = days.select("source", "day", F.min("least").over(around).alias("least"), F.max("most").over(around).alias("most")).where("least IS NOT NULL")
    dated = asks.where("day IS NOT NULL")
    found = dated.join(days, ["source", "day"]).select("variant", "day", "least", "most")
    found = found.union(dated.join(held.where("day IS NULL").drop("day"), "source").select("variant", "day", "least", "most"))
    found = found.union(asks.where("day IS NULL").join(held.groupBy("source").agg(*ends), "source").select("variant", "day", "least", "most"))
    one = found.groupBy("variant", "day").agg(*ends).where("least = most")
    return asked.alias("l").join(one.alias("r"), (F.col("l.variant") == F.col("r.variant")) & F.col("l.day").eqNullSafe(F.col("r.day"))).select(F.col("grp").alias("a"), F.col("least").alias("b")).distinct()


def deduped(reports: DataFrame) -> DataFrame:
    """(deal_id, lead_id, reports): the report that leads each one's group, and how many the group has.

    Two reports are one deal if they are of one kind, within DAYS of each other (undated ones are near all), have alike sizes (within SIZE_RATIO,
    or neither has one), and the same parties however spelled; big ones also if their sizes are nearly the same and their names, in other
    scripts and without keys, can't be compared. They meet in blocks of a party's first letters or key, or of a size. Groups are what such pairs hold together. Then a
    report without a size that fits sized reports of exactly one group takes its group there. Of a group, sized reports of a told actor lead, then those of
    a told actor, then the rest; the earliest of them (undated first), ties by the smaller id. Reports equal in all but the id are one group.
    Reports with a null kind, and blank names, meet none but their equals.

    Pairs of reports aren't made. Reports of one class of parties, one band of sizes and one span of DAYS + 1 days are all alike, so they are one node from the
    start; names, of which there are few, are matched once for all reports; and two nodes are linked if the sizes of their days allow it.
    """
    sided, own = ["kind", "actor", "actor_key", "counterparty", "counterparty_key"], ["amount_usd", "announced_on"]
    hashed = lambda cs: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cs])
    named = reports.select("deal_id", *sided, *own, hashed(sided).alias("who"), hashed([*sided, *own]).alias("same"))
    sides = spill(_sides(named.select("who", *sided)), "sides")
    told = ~F.col("actor").eqNullSafe(F.lit(UNDISCLOSED))
    tier = F.when(told & (F.coalesce("amount_usd", F.lit(0.0)) != 0), 0).when(told, 1).otherwise(2)
    day = F.unix_date("announced_on")
    span = F.coalesce(F.floor(day / (DAYS + 1)), F.lit(UNDATED)).cast("long")
    rows = named.select("deal_id", "who", "same", "amount_usd", day.alias("day"), span.alias("span"), _band(F.col("amount_usd"), SIZE_RATIO).alias("band"), tier.alias("tier"))
    rows = rows.join(small_side(sides.select("who", "variant", "cls", F.concat("script", F.lit(":"), "kind").alias("script"), "kind")), "who")
    node = F.when(F.col("cls").isNotNull() & F.col("band").isNotNull(), F.xxhash64("cls", "span", "band")).otherwise(F.xxhash64("same", F.lit("alone")))
    rows = spill(rows.withColumn("node", node).drop("who", "same"), "deals")
    days = rows.groupBy("node", "variant", "cls", "span", "band", "day", F.col("amount_usd").isNotNull().alias("sized")).agg(F.min("amount_usd").alias("lo"), F.max("amount_usd").alias("hi"))
    days = spill(days.where("variant IS NOT NULL"), "days")
    pairs = spill(_pairs(sides), "pairs")
    alike = days.where("band IS NOT NULL")
    cells = spill(_cells(alike.where("cls IS NOT NULL"), "cls"), "cells")
    edges = _links(cells, cells, True)
    crossing = spill(_cells(alike.join(pairs.where("meet").select("variant").distinct(), "variant", "left_semi"), "variant"), "crossing")
    weight = crossing.groupBy(F.col("key").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    rarer = pairs.where("meet").join(weight, "variant").join(weight.toDF("other", "m"), "other").where("n < m OR n = m AND variant < other").select(F.col("variant").alias("key"), "other")
    edges = edges.union(_links(crossing.join(rarer, "key").withColumn("key", F.col("other")).drop("other"), crossing, False))
    big = rows.where((F.col("amount_usd") >= BIG_USD) & F.col("kind").isNotNull())
    apart = pairs.where("NOT meet").select(F.col("variant").cast("string").alias("key"), F.col("other").cast("string").alias("other"))
    points = big.withColumn("key", F.col("variant").cast("string")).join(apart.select("key").distinct(), "key", "left_semi").withColumn("grid", _grid()).withColumn("ratio", F.lit(SIZE_RATIO))
    points = points.unionByName(big.where("script IS NOT NULL").withColumn("key", F.col("script")).withColumn("grid", F.lit(None).cast("array<long>")).withColumn("ratio", F.lit(BIG_RATIO)))
    scripts = big.where("script IS NOT NULL").select("kind").distinct()
    others = [scripts.select(F.concat(F.lit(f"{a}:"), "kind").alias("key"), F.concat(F.lit(f"{b}:"), "kind").alias("other")) for a in SCRIPTS for b in SCRIPTS if a != b]
    for other in others:
        apart = apart.union(other)
    edges = edges.union(_reached(points.select("key", "node", "amount_usd", "day", "span", "grid", "ratio"), apart))
    held = components(contracted(edges))
    roots = held.select("node", "root")
    grouped = spill(days.join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node")).select("variant", "cls", "day", "sized", "grp"), "grouped")
    moved = components(contracted(_fits(grouped, sides, pairs)))
    nodes = spill(rows.groupBy("node").agg(F.min(F.struct("tier", "day", "deal_id")).alias("lead"), F.count(F.lit(1)).alias("n")), "nodes")
    placed = nodes.join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node")).select("node", "grp", "lead", "n")
    placed = placed.join(moved.select(F.col("node").alias("grp"), F.col("root").alias("into")), "grp", "left").withColumn("grp", F.coalesce("into", "grp"))
    groups = placed.groupBy("grp").agg(F.min("lead")["deal_id"].alias("lead_id"), F.sum("n").alias("reports"))
    return rows.select("deal_id", "node").join(placed.select("node", "grp").join(groups, "grp"), "node").select("deal_id", "lead_id", "reports")
