"""Stories against a loop that takes one report after the other, as they are seen."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from siftwork.operators import clusters

SCHEMA = "item_id long, seen_at timestamp, told_at timestamp, source string, publisher string, url string, content_hash string, title string, keywords array<string>, sig string, t string"


def loop(rows, sigs, alone, candidates=300):
    hours = lambda x: int(x.timestamp()) // 3600
    story, members, out = {}, {}, []
    rows = sorted(rows, key=lambda r: (int(r["seen_at"].timestamp()), r["item_id"]))
    like = lambda a, b: sum(x == y for x, y in zip(sigs[a["item_id"]], sigs[b["item_id"]], strict=True)) / 64 if sigs[a["item_id"]] and sigs[b["item_id"]] else 0
    shares = lambda a, b: any(sigs[a["item_id"]][k : k + 4] == sigs[b["item_id"]][k : k + 4] for k in range(0, 64, 4))
    for n, r in enumerate(rows):
        earlier = [x for x in rows[:n] if hours(x["seen_at"]) >= hours(r["seen_at"]) - 72]
        low = lambda x: (x["title"] or "").lower()
        link = [x for x in earlier if r["url"] and x["url"] == r["url"] and ((r["source"] and x["source"] and x["source"] != r["source"]) or low(x) == low(r))]
        content = [x for x in earlier if r["content_hash"] and x["content_hash"] == r["content_hash"]]
        title = [x for x in earlier if len((r["title"] or "").strip()) >= 30 and low(x) == low(r)]
        parent, relation, best = (link or content or title or [None])[0], "exact", 1.0
        if parent is None:
            near = [x for x in earlier if like(x, r) >= 0.45 and shares(x, r)]
            event = []
            for word in {w.lower() for w in r["keywords"] or ()}:
                held = [x for x in rows[:n] if sigs[x["item_id"]] and word in {w.lower() for w in x["keywords"] or ()}][-candidates:]
                event += [x for x in held if x in earlier and like(x, r) >= 0.35 and abs(hours(x["told_at"] or x["seen_at"]) - hours(r["told_at"] or r["seen_at"])) <= 48]
            relation = "near" if near else "event"
            order = lambda x: (-like(x, r), int(x["seen_at"].timestamp()), x["item_id"])
            parent = min(near or event, key=order, default=None)
            best = like(parent, r) if parent else None
            held = members[story[parent["item_id"]]] if parent else []
            if len(held) >= alone and {x["publisher"] for x in held} == {r["publisher"]}:
                parent, best = None, None
        story[r["item_id"]] = story[parent["item_id"]] if parent else r["item_id"]
        members.setdefault(story[r["item_id"]], []).append(r)
        out.append((r["item_id"], story[r["item_id"]], relation if parent else "seed", best))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    heads = ["Galaxy agent opens to all developers today", "Chip maker doubles its memory output in May", "Panel of experts warns of rising costs", "Weekly update", "주간 기술 동향 보고서 반도체"]
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for i in range(n):
        head = rng.choice(heads)
        cut = rng.choice(["", " again", " report", f" {rng.randrange(99)}", " " + rng.choice(heads)[:18]])
        title = rng.choice([head, head.upper(), head + cut, head[: rng.randrange(4, 40)], head[5:] + cut, None if rng.random() < 0.1 else head + "!"])
        seen = start + dt.timedelta(minutes=rng.randrange(60 * 24 * 9))
        yield dict(
            item_id=rng.randrange(10**6) * 1000 + i, seen_at=seen, told_at=rng.choice([None, seen - dt.timedelta(hours=rng.randrange(70))]), source=rng.choice(["a", "a", "b", "c", None]),
            publisher=rng.choice(["p", "p", "p", "p", "p", "q"]), url=rng.choice([None, None, "https://x.org/a", "https://x.org/b", f"https://x.org/{i}"]),
            content_hash=rng.choice([None, None, None, "h1", str(i)]) if rng.random() < 0.2 else str(i), title=title, keywords=rng.choice([None, ["Agent"], ["memory", "agent"], ["Cost"], []]),
        )


def asked(spark, rows):
    df = spark.createDataFrame([(*r.values(), "x", "y") for r in rows], SCHEMA)
    sigs = {r.item_id: list(r.sig) for r in clusters.signed(df).select("item_id", "sig").collect()}
    return df, sigs


@pytest.mark.parametrize(("seed", "alone"), [(1, 20), (2, 3)])
def test_stories_are_those_of_the_loop(spark, seed, alone):
    rows = list(made(seed, 160))
    df, sigs = asked(spark, rows)
    found = sorted(tuple(r) for r in clusters.stories(df, alone).collect())
    assert found == loop(rows, sigs, alone)
    assert {r[2] for r in found} == {"seed", "exact", "near", "event"} and len({r[1] for r in found}) > 5


def test_blocks_of_a_keyword_that_all_have(spark):
    rows = [r | {"keywords": ["all"]} for r in made(3, 120)]
    df, sigs = asked(spark, rows)
    held = clusters.signed(df)
    got = {r.item_id: (r.parent, r.similarity) for r in clusters.event_choices(held, held.select("item_id"), candidates=7).collect()}
    want = {}
    by_time = sorted(rows, key=lambda r: (int(r["seen_at"].timestamp()), r["item_id"]))
    by_time = [r for r in by_time if sigs[r["item_id"]]]
    hour = lambda x: int(x.timestamp()) // 3600
    for n, r in enumerate(by_time):
        fits = [x for x in by_time[max(0, n - 7) : n] if hour(x["seen_at"]) >= hour(r["seen_at"]) - 72 and abs(hour(x["told_at"] or x["seen_at"]) - hour(r["told_at"] or r["seen_at"])) <= 48]
        scored = [(sum(a == b for a, b in zip(sigs[x["item_id"]], sigs[r["item_id"]], strict=True)) / 64, x["item_id"]) for x in fits]
        best = max(scored, key=lambda x: x[0], default=(0, 0))
        if best[0] >= 0.35:
            want[r["item_id"]] = (best[1], best[0])
    assert got == want and len(got) > 20
    assert clusters.stories(df.where(F.lit(False))).count() == 0


def test_signatures_take_32_bits_a_value(spark):
    df, sigs = asked(spark, list(made(5, 30)))
    held = clusters.signed(df)
    assert dict(held.dtypes)["sig"] == "array<int>"
    near = clusters.near_choices(held, held.select("item_id")).collect()
    low = {r.item_id: (r.t, r.hour) for r in held.collect()}
    for r in near:  # parents come earlier, within the window, share a band, and are as like as told
        a, b = sigs[r.item_id], sigs[r.parent]
        assert (low[r.parent][0], r.parent) < (low[r.item_id][0], r.item_id) and low[r.parent][1] >= low[r.item_id][1] - 72
        assert any(a[k : k + 4] == b[k : k + 4] for k in range(0, 64, 4)) and sum(x == y for x, y in zip(a, b, strict=True)) / 64 == r.similarity
    assert len(near) > 5


def test_signatures_are_those_of_the_expression(spark):
    import numpy as np
    from siftwork.functions import refs

    texts = ["", "a", "ab", "Abc", "Weekly update, again", "weekly UPDATE again!", "주간 기술 동향 보고서 반도체", "𝒳𝒴 b𝒳𝒴c", "İstanbul ß ﬁ Σας", "x_y ²½Ⅷ٣ é", "aaaa" * 50, *[r["title"] or "" for r in made(4, 60)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = df.select("i", refs.bare(F.col("t")).alias("bare"), refs.minhash(refs.char_shingles(F.col("t"))).alias("sig")).orderBy("i").collect()
    for kept in (3, 70, 4096):  # also if shingles are forgotten, within a text too
        got = clusters.signatures((r.bare for r in rows), {}, np.empty((kept, refs.HASHES), np.int32))
        assert [list(map(int, x)) for x in got] == [list(r.sig) for r in rows]


def test_small_blocks_share_a_group_and_large_ones_are_parted(spark, monkeypatch):
    """Tasks get groups of many keywords and bands, not one for each; a band of many reports is compared in parts."""
    rows = [r | {"keywords": ["all", f"word{r['item_id'] % 70}", f"only{r['item_id']}"]} for r in made(6, 150)]
    df, sigs = asked(spark, rows)
    held = clusters.signed(df)
    want = [sorted(map(tuple, f(held, held.select("item_id")).collect())) for f in (clusters.near_choices, clusters.event_choices)]
    calls = spark.sparkContext.accumulator(0)
    grouped = type(held.groupBy("item_id"))
    run = grouped.applyInArrow
    monkeypatch.setattr(grouped, "applyInArrow", lambda self, f, *a: run(self, lambda table: calls.add(1) or f(table), *a))
    assert sorted(map(tuple, clusters.event_choices(held, held.select("item_id")).collect())) == want[1] and calls.value == 1
    assert sorted(map(tuple, clusters.near_choices(held, held.select("item_id")).collect())) == want[0] and calls.value == 2
    for name, value in (("PART", 5), ("GROUP", 64)):
        monkeypatch.setattr(clusters, name, value)
    found = clusters.stories(df, 3).collect()
    assert sorted(map(tuple, found)) == loop(rows, sigs, 3)


def test_likest_of_stretches(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    sigs, told = rng.integers(0, 2, (90, 64)).astype(np.int32), rng.integers(0, 9, 90)
    ask = np.arange(0, 90, 2)
    low = np.maximum(ask - rng.integers(0, 40, 45), 0)
    want = []
    for i, start in zip(ask.tolist(), low.tolist(), strict=True):
        fits = [(-int((sigs[j] == sigs[i]).sum()), j) for j in range(start, i) if abs(told[i] - told[j]) <= 3]
        want += [(i, min(fits)[1], -min(fits)[0])] if fits else []
    for pairs in (1, 7, 10_000):
        monkeypatch.setattr(clusters, "PAIRS", pairs)
        assert [tuple(map(int, x)) for x in zip(*clusters._likest(sigs, ask, low, ask, (told, 3)), strict=True)] == want
    assert len(want) > 30
