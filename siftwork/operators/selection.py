"""A shortlist by quotas: a greedy choice, after a reduction to few candidates that provably changes nothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of tracks in which their quotas are filled and the list is shown. Fixed values.
TRACKS = ("research_ip", "oss", "community", "news")


@dataclass(frozen=True)
class Rules:
    """How many are chosen, the least of each track, the most of a domain and the least of three kinds, as shares of the size."""

    size: int = 60
    track_min: dict[str, int] = field(default_factory=lambda: {"news": 30, "research_ip": 10, "oss": 6, "community": 8})
    domain_cap: float = 0.08
    local_min: float = 0.15
    official_min: float = 0.25
    independent_min: float = 0.25

    @property
    def cap(self) -> int:
        return max(1, math.floor(self.domain_cap * self.size))


def _pools() -> list[tuple[str, Column]]:
    return [("local", F.col("local")), ("official", F.col("official")), ("independent", F.col("independent")), *[(t, F.col("track") == t) for t in TRACKS], ("all", F.lit(True))]


def reduced(candidates: DataFrame, rules: Rules) -> DataFrame:
    """Those of `candidates` that a greedy choice may look at and take, from each pool.

    Of a pool's items of one domain and story only the best can be taken: once it is passed over, its domain is full or its story is taken, and so it is for
    the others. What then stands before an item that is taken, in its domain, is taken itself or of the story of one that is: at most `size` items. Before it in
    the pool, there are as many outside full domains, and at most size / cap domains are full. So the first size + 1 of a domain and the first
    size + (size / cap) (size + 1) + 1 of a pool do. Both are found with partial limits.
    """
    most = rules.size + rules.size // rules.cap * (rules.size + 1) + 1
    order = [F.desc("score"), F.asc("item_id")]
    out = None
    for name, holds in _pools():
        pool = candidates.where(F.coalesce(holds, F.lit(False)))
        story = F.coalesce(F.concat(F.lit("s"), F.col("story").cast("string")), F.concat(F.lit("i"), F.col("item_id").cast("string")))
        best = pool.groupBy("domain", story.alias("one")).agg(F.max_by(F.struct(*candidates.columns), F.struct("score", -F.col("item_id"))).alias("x")).select("x.*")
        near = best.withColumn("nth", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where(F.col("nth") <= rules.size + 1).drop("nth")
        near = near.orderBy(*order).limit(most).withColumn("pool", F.lit(name))
        out = near if out is None else out.union(near)
    return out


def shortlist(candidates: DataFrame, rules: Rules | None = None) -> DataFrame:
    """candidates(item_id, track, domain, score, story, local, official, independent) -> (place, item_id, track, domain, score).

    Local, official, independent items and those of each track are taken first, the best first, as far as their quotas ask; then the best of all. No domain is taken
    more often than its cap, no story twice; ties go by the smaller id. A null domain is one domain, items of no story are stories of their own, a null score
    comes last, a null flag is false. The list goes by track, then score; an empty table gives an empty list.
    """
    rules = rules or Rules()
    own = candidates.select("item_id", "track", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce(F.col("score").cast("double"), F.lit(-1e300)).alias("score"), "story", "local", "official", "independent")
    few = reduced(own, rules).collect()  # bounded by the rules, not by the candidates
    pools: dict[str, list] = {name: [] for name, _ in _pools()}
    for r in sorted(few, key=lambda r: (-r.score, r.item_id)):
        pools[r.pool].append(r)
    chosen, taken, stories, domains = [], set(), set(), {}

    def take(name: str, need: int) -> None:
        for r in pools[name]:
            if need <= 0 or len(chosen) >= rules.size:
                return
            if r.item_id in taken or domains.get(r.domain, 0) >= rules.cap or (r.story is not None and r.story in stories):
                continue
            chosen.append(r)
            taken.add(r.item_id)
            stories.add(r.story)
            domains[r.domain] = domains.get(r.domain, 0) + 1
            need -= 1

    quota = lambda share, kind: math.ceil(share * rules.size) - sum(bool(r[kind]) for r in chosen)
    for share, kind in ((rules.local_min, "local"), (rules.official_min, "official"), (rules.independent_min, "independent")):
        take(kind, quota(share, kind) if kind != "local" else math.ceil(share * rules.size))
    for track in TRACKS:
        take(track, rules.track_min.get(track, 0) - sum(r.track == track for r in chosen))
    take("all", rules.size - len(chosen))
    place = {t: i for i, t in enumerate(TRACKS)}
    chosen.sort(key=lambda r: (place.get(r.track, len(place)), -r.score))
    rows = [(i, r.item_id, r.track, r.domain, r.score) for i, r in enumerate(chosen, 1)]
    return candidates.sparkSession.createDataFrame(rows, f"place int, item_id {candidates.schema['item_id'].dataType.simpleString()}, track string, domain string, score double")
