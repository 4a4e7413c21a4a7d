"""Reports of one deal against a plain comparison of all pairs, in either order of the rows."""

import datetime as dt
import itertools
import random
import re

import pytest
from siftwork.operators import deals

FORMS = "inc incorporated corp corporation co company ltd limited llc plc gmbh ag sa nv bv holding holdings group".split()
SCHEMA = "deal_id long, kind string, actor string, actor_key string, counterparty string, counterparty_key string, amount_usd double, announced_on date, id string"


def words(name):
    out = ["brothers" if w == "bros" else w for w in re.split(r"[\s,.'’`\"&!?/:;·_-]+", re.sub(r"\s*[(\[][^)\]]*[)\]]", " ", (name or "").lower())) if w]
    while len(out) > 1 and out[-1] in FORMS:
        out.pop()
    return out


def fold(name):
    return "".join(words(name))


def script(name):
    return "hangul" if re.search("[가-힣]", name or "") else "cjk" if re.search("[぀-ヿ㐀-鿿]", name or "") else "latin"


def parties(r):
    actor, other = (r["actor"], r["actor_key"]), (r["counterparty"], r["counterparty_key"])
    other = other if r["counterparty"] else actor
    return sorted({actor, other}, key=lambda p: p[1] or fold(p[0])) if r["kind"] in deals.PAIRED else [other]


def match(p, q):
    if p[1] and q[1]:
        return p[1] == q[1]
    (a, wa), (b, wb) = sorted(((fold(x[0]), words(x[0])) for x in (p, q)), key=lambda x: len(x[0]))
    same = bool(a) and bool(b) and b.startswith(a) and (a == b or (len(a) >= 3 if script(a) != "latin" else len(a) >= 4 and wb[: len(wa)] == wa))
    return same or (p[1] or 0) == fold(q[0]) or (q[1] or 0) == fold(p[0])


def blocks(r):
    out = {"p" + fold(n)[:3] for n, _ in parties(r) if fold(n)} | {"k" + k for _, k in parties(r) if k}
    return out | ({("s", int(deals.math.log10(r["amount_usd"]) * 10 + x)) for x in (0, 0.5)} if (r["amount_usd"] or 0) >= 10e9 else set())


def one_deal(r, s, sized=True):
    if r["kind"] is None or r["kind"] != s["kind"] or not blocks(r) & blocks(s):
        return False
    if r["announced_on"] and s["announced_on"] and abs((r["announced_on"] - s["announced_on"]).days) > 21:
        return False
    x, y = r["amount_usd"], s["amount_usd"]
    if sized and ((x is None) != (y is None) or (x is not None and max(x, y) > 1.15 * min(x, y))):
        return False
    p, q = parties(r), parties(s)
    if len(p) == len(q) and all(itertools.starmap(match, zip(p, q, strict=True))):
        return True
    if not sized or not x or min(x, y) < 10e9 or max(x, y) > 1.02 * min(x, y):
        return False
    return len(p) == len(q) == 1 and not p[0][1] and not q[0][1] and script(p[0][0]) != script(q[0][0])


def grouped(n, edges):
    label = list(range(n))
    while True:
        new = list(label)
        for i, j in edges:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


def brute(rows):
    same = {}
    first = [same.setdefault(tuple(v for k, v in r.items() if k != "deal_id"), i) for i, r in enumerate(rows)]
    edges = [(i, first[i]) for i in range(len(rows))]
    edges += [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if one_deal(rows[i], rows[j])]
    label = grouped(len(rows), edges)
    more = []
    for i, r in enumerate(rows):
        if r["amount_usd"] is None:
            fits = {label[j] for j, s in enumerate(rows) if s["amount_usd"] is not None and one_deal(r, s, False)}
            more += [(i, fits.pop())] if len(fits) == 1 else []
    label = grouped(len(rows), edges + more)
    out = []
    for i, r in enumerate(rows):
        own = [s for j, s in enumerate(rows) if label[j] == label[i]]
        rank = lambda s: (0 if s["actor"] != deals.UNDISCLOSED and s["amount_usd"] else 1 if s["actor"] != deals.UNDISCLOSED else 2, s["announced_on"] or dt.date.min, s["deal_id"])
        out.append((r["deal_id"], min(own, key=rank)["deal_id"], len(own)))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    names = ["Warner", "Warner Bros. Discovery", "Warner Brothers Inc", "Acme Corp.", "ACME (US) Ltd", "Acme Robotics", "파라마운트", "Paramount", "파라마운트 글로벌", "派拉蒙", "Amaz", "Amazon", None, ""]
    for i in range(n):
        actor = rng.choice([deals.UNDISCLOSED, "Fund One", "Fund Two LLC", "Acme"])
        big = rng.choice([1e6, 1.1e6, 1.2e6, 2e6, 10.1e9, 10.2e9, 40e9, None, None])
        yield dict(
            deal_id=i, kind=rng.choice(["acquisition", "partnership", "ipo", None]), actor=actor, actor_key=rng.choice([None, None, "fundone"]), counterparty=rng.choice(names),
            counterparty_key=rng.choice([None, None, None, "acme"]), amount_usd=big, announced_on=rng.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))] * 9]),
        )


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = list(made(seed, 150))
    rows += [rows[3] | {"deal_id": 900 + i} for i in range(4)]
    df = spark.createDataFrame([(*r.values(), "x") for r in rows], SCHEMA)
    found = sorted(tuple(r) for r in deals.deduped(df).collect())
    assert found == brute(rows)
    assert 20 < len({x[1] for x in found}) < len(rows) - 20


def dense(seed, n):
    """Many reports of few names on few days: keys that are other names, sizes at the edges of bands and grids, zero and negative ones."""
    rng = random.Random(seed)
    names = ["Alphabet", "Google", "Google Cloud Inc", "Goog le", "알파벳", "알파벳 코리아", "字母", "Gooch", "(x)", None]
    for i in range(n):
        size = rng.choice([None, 0.0, -5e6, 1e6 * 1.15 ** rng.randrange(4), 10 ** rng.uniform(6, 6.5), 10 ** rng.uniform(6, 6.5), 10 ** rng.uniform(10, 10.5), 10 ** rng.uniform(10, 10.5)])
        yield dict(
            deal_id=i, kind=rng.choice(["acquisition", "partnership", "ipo"]), actor=rng.choice([deals.UNDISCLOSED, "Zeta", "Fund One"]), actor_key=rng.choice([None, None, "zeta"]), counterparty=rng.choice(names),
            counterparty_key=rng.choice([None, None, None, "google", "alphabet"]), amount_usd=size, announced_on=rng.choice([None, *[dt.date(1970, 1, 1) + dt.timedelta(days=rng.randrange(-200, 200))] * 15]),
        )


@pytest.mark.parametrize("seed", [3, 4])
def test_dense_groups_are_those_of_all_pairs(spark, seed):
    rows = list(dense(seed, 500))
    df = spark.createDataFrame([(*r.values(), "x") for r in rows], SCHEMA)
    found = sorted(tuple(r) for r in deals.deduped(df).collect())
    assert found == brute(rows)
    assert 50 < len({x[1] for x in found}) < 450


def test_reports_of_one_deal_are_not_paired(spark, monkeypatch):
    """3,000 reports of two spellings within 100 days and four bands of sizes are linked by few pairs, not by millions."""
    links, components = [], deals.components
    monkeypatch.setattr(deals, "components", lambda edges: links.append(edges.count()) or components(edges))
    day = dt.date(2024, 1, 1)
    rows = [(i, "ipo", None, None, ("Warner", "Warner Bros.")[i % 2], None, 1e6 * 1.5 ** (i // 1000) + i, day + dt.timedelta(days=i % 100), "x") for i in range(3000)]
    found = deals.deduped(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.deal_id // 1000, r.lead_id, r.reports) for r in found} == {(k, 1000 * k, 1000) for k in range(3)}
    assert 0 < links[0] < 300


def test_spellings_sizes_days_and_unsized_reports(spark):
    base = dict(kind="acquisition", actor="Fund", actor_key=None, counterparty="Warner", counterparty_key=None, amount_usd=1e8, announced_on=dt.date(2024, 3, 1))
    cases = [
        {}, {"counterparty": "Warner Bros. Discovery", "amount_usd": 1.1e8, "announced_on": dt.date(2024, 3, 22)},  # one deal
        {"announced_on": dt.date(2024, 4, 20), "counterparty": "Warner Bros."},  # four weeks after the second: another one
        {"amount_usd": 1.3e8}, {"kind": "ipo"}, {"counterparty": "War"},  # other size, kind, too short a name
        {"amount_usd": None, "counterparty": "Warner Bros.", "announced_on": dt.date(2024, 4, 25)},  # fits the third alone
        {"amount_usd": None, "announced_on": dt.date(2024, 3, 5)},  # fits two groups: stays by itself
        {"counterparty": "파라마운트", "amount_usd": 20e9}, {"counterparty": "Paramount", "amount_usd": 20.1e9}, {"counterparty": "Paramount", "amount_usd": 21e9, "counterparty_key": "x"},
    ]
    rows = [dict(deal_id=i) | base | c for i, c in enumerate(cases)]
    df = spark.createDataFrame([(*r.values(), "x") for r in rows], SCHEMA)
    found = {r.deal_id: (r.lead_id, r.reports) for r in deals.deduped(df).collect()}
    assert sorted((i, *x) for i, x in found.items()) == brute(rows)
    assert found[0] == found[1] == (0, 2) and found[2] == found[6] == (2, 2) and found[7] == (7, 1) and found[8] == found[9]
    assert deals.deduped(df.where("false")).count() == 0


SPELLINGS = [
    ("Warner Bros. Discovery", "Warner Bros Discovery", True), ("Warner", "Warner Bros. Discovery", True), ("Paramount Inc.", "Paramount", True), ("Character.AI", "Character.ai", True), ("TypeSafe", "TypeSafe AI", True),
    ("워너 브라더스", "워너브러더스 디스커버리", True), ("(주)인텔리빅스", "인텔리빅스", True), ("Meta", "Metaplanet", False), ("Arm", "Armada", False), ("Paramount", "파라마운트", False), ("", "", False), (None, "x", False),
]


def test_party_spellings(spark):
    df = spark.createDataFrame([(i, a, b, None) for i, (a, b, _) in enumerate(SPELLINGS)], "i int, a string, b string, k string")
    party = lambda c: deals._party(deals.F.col(c), deals.F.col("k"))
    rows = df.select("i", party("a").alias("x"), party("b").alias("y")).select("i", deals._match(deals.F.col("x"), deals.F.col("y")).alias("same")).collect()
    assert {r.i: r.same for r in rows} == {i: same for i, (_, _, same) in enumerate(SPELLINGS)}
