"""Sections against a plain choice, and places lent in either direction."""

import datetime as dt
import random

from siftwork.operators import sections

END = dt.datetime(2024, 2, 20)


def brute(rows, now, sustained):
    out = []
    for section in {r[0] for r in rows if r[0]}:
        groups = {"now": [], "sustained": []}
        for key in {r[1] for r in rows if r[0] == section and r[1] is not None}:
            own = [r for r in rows if r[:2] == (section, key) and END - dt.timedelta(days=7) <= r[4] < END]
            recent = [r for r in own if r[4] >= END - dt.timedelta(days=1)]
            if recent or len({r[4].date() for r in own}) >= 3:
                priority, less = min((r[2], -r[3]) for r in recent or own)
                groups["now" if recent else "sustained"].append((priority, less, key))
        total = now + sustained
        n, s = len(groups["now"]), len(groups["sustained"])
        keep = min(n, total - min(s, sustained))
        for name, most in (("now", keep), ("sustained", min(s, total - keep))):
            out += [(section, key, name, priority, -less, place) for place, (priority, less, key) in enumerate(sorted(groups[name])[:most], 1)]
    return sorted(out)


def test_sections(spark):
    rng = random.Random(3)
    rows = []
    for section, recent, steady in (("full", 30, 30), ("calm", 2, 30), ("busy", 30, 1), ("few", 3, 2), (None, 2, 2)):
        for k in range(recent + steady):
            days = [0, 3] if k < recent else [2, 3, 5] if k % 4 else [2, 3]
            rows += [(section, f"k{k}" if k != 1 else None, rng.randrange(3), rng.randrange(9), END - dt.timedelta(days=x, minutes=rng.randrange(1, 1400))) for x in days]
    rows += [("full", "late", 0, 99, END), ("full", "old", 0, 99, END - dt.timedelta(days=8))]
    df = spark.createDataFrame(rows, "section string, key string, priority int, score int, occurred_at timestamp_ntz")
    found = sections.picked(sections.entries(df, "2024-02-20"), 10, 5)
    got = sorted((r.section, r.key, r.grp, r.priority, r.score, r.place) for r in found.collect())
    assert got == brute(rows, 10, 5)
    count = lambda s, g: sum(x[0] == s and x[2] == g for x in got)
    assert [(count(s, "now"), count(s, "sustained")) for s in ("full", "calm")] == [(10, 5), (1, 14)] and count("busy", "now") >= 14
    assert sections.picked(sections.entries(df.where("false"), "2024-02-20")).count() == 0
