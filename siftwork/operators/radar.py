"""Windowed series of topics and what stands out in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import stats


def window_of(at: str, end: str, days: int, windows: int) -> Column:
    """0 for the last `days` days before `end`, 1 for those before, ...; null outside all windows."""
    back = F.floor(F.date_diff(F.lit(end).cast("date") - F.expr("INTERVAL 1 DAY"), F.to_date(at)) / days).cast("int")
    return F.when((back >= 0) & (back < windows), back)


def series(items: DataFrame, key: str, end: str, days: int = 3, windows: int = 8) -> DataFrame:
    """Each key's counts in the trailing windows, oldest first, with its z, state and change; one aggregate."""
    back = items.withColumn("w", window_of("occurred_at", end, days, windows)).where("w IS NOT NULL")
    counts = [F.count_if(F.col("w") == i).alias(f"c{i}") for i in range(windows)]
    found = back.groupBy(F.col(key).alias("key")).agg(*counts, F.countDistinct(F.when(F.col("w") == 0, F.col("source"))).alias("sources"))
    found = found.withColumn("history", F.array(*[F.col(f"c{i}").cast("double") for i in range(windows - 1, 0, -1)]))
    z = stats.count_z(F.col("c0"), F.col("history"))
    return found.select(
        "key", F.col("c0").alias("now"), F.col("c1").alias("previous"), "sources", F.round(z, 4).alias("z"),
        stats.lifecycle(F.col("c0"), F.col("history"), F.round(z, 2), F.col("sources")).alias("state"), stats.change_percent(F.col("c0"), F.col("c1")).alias("change"),
    )


def effective_sources(items: DataFrame, key: str) -> DataFrame:
    """(sum of a key's counts by source) squared over the sum of their squares: how many even sources it is worth."""
    by_source = items.groupBy(F.col(key).alias("key"), "source").agg(F.count(F.lit(1)).alias("c"))
    return by_source.groupBy("key").agg(F.round(F.pow(F.sum("c"), 2) / F.sum(F.col("c") * F.col("c")), 4).alias("effective"))


def normalised_share(items: DataFrame, key: str, cap: int = 3) -> DataFrame:
    """Mean over tracks of a key's percent of the track, where a source counts `cap` times a day and key at most."""
    capped = items.groupBy("track", F.col(key).alias("key"), "source", F.to_date("occurred_at").alias("day")).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("c"))
    by_track = capped.groupBy("track", "key").agg(F.sum("c").alias("c"))
    totals = by_track.groupBy("track").agg(F.sum("c").alias("total"))
    tracks = totals.agg(F.count(F.lit(1)).alias("tracks"))
    shares = by_track.join(F.broadcast(totals), "track").crossJoin(F.broadcast(tracks))  # one row for each track, and one in all
    return shares.groupBy("key").agg(F.round(F.sum(100.0 * F.col("c") / F.col("total")) / F.first("tracks"), 4).alias("share"))


def lift(items: DataFrame, array: str, least: int = 1) -> DataFrame:
    """Pairs of elements (a < b) that items share, with how often, and how much oftener than by chance.

    Pairs are made inside each row, whose arrays are short; then only counts are joined.
    """
    n = items.agg(F.count(F.lit(1)).alias("n"))
    singles = items.select(F.explode(array).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    pairs = items.select(F.explode(array).alias("a"), array).select("a", F.explode(array).alias("b")).where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)
    left, right = singles.select(F.col("e").alias("a"), F.col("c").alias("ca")), singles.select(F.col("e").alias("b"), F.col("c").alias("cb"))
    scored = pairs.join(left, "a").join(right, "b").crossJoin(F.broadcast(n))  # one row
    return scored.select("a", "b", "together", F.round(F.col("together") * F.col("n") / (F.col("ca") * F.col("cb")), 4).alias("lift"))


def category_links(items: DataFrame, chain: str, category: str) -> DataFrame:
    """Pairs of categories that a chain of items spans, and how many chains do."""
    own = items.groupBy(chain).agg(F.array_sort(F.collect_set(category)).alias("all"))
    pairs = own.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("chains"))


def flows(items: DataFrame, chain: str = "story") -> DataFrame:
    """Steps between tracks in the order in which a chain first reaches them: how many, and the median lag in hours.

    Lags are counted by whole seconds first, so that the exact median holds a step's distinct lags only.
    """
    arrived = items.groupBy(chain, "track").agg(F.min("occurred_at").alias("at"))
    order = Window.partitionBy(chain).orderBy("at", "track")
    steps = arrived.withColumns({"to": F.lead("track").over(order), "then": F.lead("at").over(order)}).where("to IS NOT NULL")
    lags = steps.groupBy(F.col("track").alias("from_track"), F.col("to").alias("to_track"), F.timestamp_diff("SECOND", F.col("at"), F.col("then")).alias("lag")).agg(F.count(F.lit(1)).alias("c"))
    return lags.groupBy("from_track", "to_track").agg(F.sum("c").alias("steps"), F.round(F.expr("percentile(lag, 0.5, c)") / 3600, 1).alias("lag_hours"))


def day_anomalies(items: DataFrame, key: str, z: float = 3.0, ratio: float = 2.5, least: int = 8, most: int = 8) -> DataFrame:
    """The `most` days that stand out most: a key has far more items than on the same weekday of the four weeks before; quiet days count as 0."""
    counted = items.groupBy(F.col(key).alias("key"), F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = items.agg(F.min(F.to_date("occurred_at")).alias("lo"), F.max(F.to_date("occurred_at")).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    spine = counted.select("key").distinct().crossJoin(F.broadcast(days))  # calendar days
    filled = spine.join(counted, ["key", "day"], "left").fillna(0, ["n"])
    order = Window.partitionBy("key").orderBy("day")
    lags = F.filter(F.array(*[F.lag("n", k).over(order) for k in (7, 14, 21, 28)]), lambda x: x.isNotNull())
    scored = filled.withColumn("h", lags).where("size(h) = 4").withColumn("mean", stats.mean_of(F.transform("h", lambda x: x.cast("double"))))
    scored = scored.withColumn("z", stats.rate_z(F.col("n"), F.col("mean")))
    found = scored.where((F.col("z") >= z) & (F.col("n") >= ratio * F.col("mean")) & (F.col("n") >= least))
    return found.orderBy(F.desc("z"), "key", "day").limit(most).select("key", "day", "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


def movers(snapshots: DataFrame, cutoff: str, most: int) -> DataFrame:
    """Items whose metric grew most since the cutoff: latest against the last at or before it, else the first; two readings at least."""
    at = F.col("occurred_at")
    before = at <= F.lit(cutoff).cast("timestamp_ntz")
    order = F.struct("occurred_at", "item_id")
    found = snapshots.groupBy("source").agg(
        F.max_by("value", order).alias("latest"), F.max_by(F.when(before, F.col("value")), F.when(before, order)).alias("base"), F.min_by("value", order).alias("first"), F.count(F.lit(1)).alias("n")
    )
    base = F.coalesce("base", "first")
    moved = found.where("n >= 2").select("source", base.alias("baseline"), "latest", F.round(F.col("latest") - base, 4).alias("delta"))
    return moved.orderBy(F.desc("delta"), "source").limit(most)


def first_ever(items: DataFrame, key: str, since: str) -> DataFrame:
    """Keys whose first report falls on or after `since`, with that time."""
    return items.groupBy(F.col(key).alias("key")).agg(F.min("occurred_at").alias("debut")).where(F.col("debut") >= F.lit(since).cast("timestamp_ntz"))


def platform_z(items: DataFrame, platform: str, at: str, least: int = 30) -> DataFrame:
    """How fast each item gains, log1p(value / hours since it came, two at least), against its platform's mean and deviation.

    A platform of fewer than `least` items is held against all of them; without any deviation z is 0.
    """
    hours = F.timestamp_diff("SECOND", F.col("occurred_at"), F.lit(at).cast("timestamp_ntz")) / 3600.0
    own = items.select("item_id", F.col(platform).alias("platform"), F.log1p(F.greatest("value", F.lit(0.0)) / F.greatest(hours, F.lit(2.0))).alias("v"))
    by = own.groupBy("platform").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    pooled = own.agg(F.avg("v").alias("am"), F.stddev_pop("v").alias("asd"))
    scored = own.join(by, "platform").crossJoin(F.broadcast(pooled))  # one row
    mean, spread = F.when(F.col("n") >= least, F.col("m")).otherwise(F.col("am")), F.when(F.col("n") >= least, F.col("sd")).otherwise(F.col("asd"))
    return scored.select("item_id", F.round(F.when(spread > 0, (F.col("v") - mean) / spread).otherwise(0.0), 4).alias("z"))


def paced_counts(items: DataFrame, key: str, end: str, now: str, days: int = 7, windows: int = 8) -> DataFrame:
    """Each key's counts in the trailing windows, oldest first; all up to the share of a window that has passed at `now` in the last one."""
    last = F.lit(end).cast("timestamp_ntz")
    back = window_of("occurred_at", end, days, windows)
    since = lambda t: F.timestamp_diff("SECOND", last - F.expr(f"INTERVAL {days} DAYS"), t)
    into = F.pmod(F.timestamp_diff("SECOND", last - F.expr(f"INTERVAL {days * windows} DAYS"), F.col("occurred_at")), F.lit(days * 86_400))
    rows = items.withColumn("back", back).where("back IS NOT NULL").where(into < since(F.lit(now).cast("timestamp_ntz")))
    counts = F.array(*[F.count_if(F.col("back") == i) for i in range(windows - 1, -1, -1)])
    return rows.groupBy(F.col(key).alias("key")).agg(counts.alias("counts"))


def history_of(items: DataFrame, key: str, start: str, end: str, days: int) -> DataFrame:
    """Keys reported in a window, with their first report ever: debut if that is in it, returning if none came in the `days` days before it."""
    at, begin = F.col("occurred_at"), F.lit(start).cast("timestamp_ntz")
    inside = (at >= begin) & (at < F.lit(end).cast("timestamp_ntz"))
    before = (at < begin) & (at >= begin - F.expr(f"INTERVAL {days} DAYS"))
    found = items.groupBy(F.col(key).alias("key")).agg(F.count_if(inside).alias("n"), F.min("occurred_at").alias("first_ever"), F.count_if(before).alias("b"))
    debut = F.col("first_ever") >= begin
    return found.where("n > 0").select("key", "n", "first_ever", debut.alias("debut"), (~debut & (F.col("b") == 0)).alias("returning"))


def gains(snapshots: DataFrame, item: str, theme: str, start: str, end: str) -> DataFrame:
    """(theme, items, score): the sum of log1p of what each item's metric gained in a window, by theme.

    The gain is the last reading in the window less the last one before it, else the first in it.
    """
    at, begin = F.col("occurred_at"), F.lit(start).cast("timestamp_ntz")
    inside, order = at >= begin, F.struct("occurred_at", "item_id")
    own = snapshots.where(at < F.lit(end).cast("timestamp_ntz")).groupBy(F.col(theme).alias("theme"), F.col(item).alias("item")).agg(
        F.max_by(F.when(inside, F.col("value")), F.when(inside, order)).alias("now"),
        F.coalesce(F.max_by(F.when(~inside, F.col("value")), F.when(~inside, order)), F.min_by(F.when(inside, F.col("value")), F.when(inside, order))).alias("then"),
    )
    grown = own.where("now > then").select("theme", F.log1p(F.col("now") - F.col("then")).alias("g"))
    return grown.groupBy("theme").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("g"), 2).alias("score"))


def signal_candidates(topics: DataFrame, overall: dict[str, Column] | None = None) -> DataFrame:
    """topics(key, now, mean, z, state, sources, effective, home, research, all_now, base_research, base_all, windows, debut, returning) -> (tone, key, score).

    `windows` is the number of earlier windows that the base counts are of. new: first told of in this window, or so few times before that its state is new, by several sources. back: told of again after
    silence in all earlier windows. early: rising, and at least half of it research; the share counts drawn towards that of all. hype: what isn't
    research is well and significantly above its usual count, while research is not. surge: the state says so. cool: falling. thin: rising or surging on few effective sources. gap: several sources, none at
    home, though the usual share at home makes that unlikely. shift: the share of research fell, by 0.2 and significantly.
    """
    share = topics.agg((F.sum("home") / F.sum("all_now")).alias("rate"), F.coalesce(F.try_divide(F.sum("research"), F.sum("all_now")), F.lit(0.0)).alias("research_rate"))
    rows = topics.crossJoin(F.broadcast(share))  # one row
    chance = stats.zero_chance(F.col("now"), F.coalesce("rate", F.lit(0.0)))
    drop_z = stats.two_proportion_z(F.col("base_research"), F.col("base_all"), F.col("research"), F.col("all_now"))
    drop = F.try_divide(F.col("base_research"), F.col("base_all")) - F.try_divide(F.col("research"), F.col("all_now"))
    chatter, usual = F.col("all_now") - F.col("research"), (F.col("base_all") - F.col("base_research")) / F.greatest("windows", F.lit(1))
    usual_research = F.col("base_research") / F.greatest("windows", F.lit(1))
    hype_z = stats.rate_z(chatter, usual)
    state = F.coalesce("state", F.lit(""))
    tones = {
        "new": (~F.col("returning") & (F.col("sources") >= 2) & ((state == "new") | (F.col("debut") & (state != "falling"))), F.col("now")),
        "back": (F.col("returning"), F.col("now")),
        "early": ((F.col("all_now") >= 5) & (F.col("z") >= 1) & (F.try_divide(F.col("research"), F.col("all_now")) >= 0.5), F.col("z") * stats.shrunk_share(F.col("research"), F.col("all_now"), F.col("research_rate"))),
        "hype": ((chatter >= 5) & (usual > 0) & (chatter >= 1.5 * usual) & (hype_z >= 2) & (stats.rate_z(F.col("research"), usual_research) < 1), hype_z),
        "surge": (F.col("state") == "surging", F.col("z")),
        "cool": (F.col("state") == "falling", -F.col("z")),
        "thin": (F.col("state").isin("surging", "rising") & (F.col("effective") < 2.5), F.col("z")),
        "gap": ((F.coalesce("state", F.lit("")) != "falling") & (F.col("sources") >= 2) & (F.col("home") == 0) & (chance <= 0.05), F.col("now").cast("double")),
        "shift": ((F.col("now") >= 5) & (drop >= 0.2) & (drop_z >= 2), drop_z),
    }
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(t).alias("tone"), score.cast("double").alias("score"))) for t, (hit, score) in tones.items()])
    return rows.select("key", F.explode(found).alias("s")).where("s IS NOT NULL").select("s.tone", "key", F.round("s.score", 4).alias("score"))


def keyword_pick(topics: DataFrame, live: int = 90, falling: int = 12) -> DataFrame:
    """topics(key, now, mean, state) -> the `live` keys with most reports, and of the falling ones those with the largest mean."""
    best = topics.where("now > 0 AND coalesce(state, '') <> 'falling'").orderBy(F.desc("now"), "key").limit(live).select("key", F.lit("live").alias("why"))
    return best.union(topics.where("state = 'falling'").orderBy(F.desc("mean"), "key").limit(falling).select("key", F.lit("falling").alias("why")))


def calendar(items: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(day, key, n) for every day from `start` to before `end` and every key, zeros too."""
    counted = items.groupBy(F.to_date("occurred_at").alias("day"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    days = items.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("day"))
    spine = counted.select("key").distinct().crossJoin(F.broadcast(days))  # calendar days
    return spine.join(counted, ["day", "key"], "left").select("day", "key", F.coalesce("n", F.lit(0)).alias("n"))


def entries(items: DataFrame, actor: str, theme: str, start: str) -> DataFrame:
    """(theme, actor, n): actors that a theme has reports of since `start` and had none of before."""
    late = F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz")
    found = items.groupBy(F.col(theme).alias("theme"), F.col(actor).alias("actor")).agg(F.count_if(late).alias("n"), F.count_if(~late).alias("b"))
    return found.where("n > 0 AND b = 0").select("theme", "actor", "n")


def leaders(items: DataFrame, actor: str, theme: str, most: int = 3) -> DataFrame:
    """(theme, actor, n, share, place): the actors named most in each theme, and their share of its reports."""
    counts = items.groupBy(F.col(theme).alias("theme"), F.col(actor).alias("actor")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("theme").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("n"), "actor"))).where(F.col("place") <= most)
    return ranked.join(totals, "theme").select("theme", "actor", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "place")


def spikes(items: DataFrame, array: str, day: str, days: int = 28, least: int = 3, most: int = 3) -> DataFrame:
    """(key, n, lift): elements most above their average of the `days` days before a day."""
    on, first = F.to_date("occurred_at"), F.date_sub(F.lit(day).cast("date"), days)
    rows = items.where((on >= first) & (on <= F.lit(day).cast("date"))).select(on.alias("on"), F.explode(array).alias("key"))
    today = F.col("on") == F.lit(day).cast("date")
    found = rows.groupBy("key").agg(F.count_if(today).alias("n"), F.count_if(~today).alias("b")).where(F.col("n") >= least)
    lift = F.round(F.col("n") - F.col("b") / days, 4)
    return found.select("key", "n", lift.alias("lift")).orderBy(F.desc("lift"), "key").limit(most)
