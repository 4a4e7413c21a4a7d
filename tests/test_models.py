"""Triage against numpy, places and quantiles against sorting, the shortlist against a choice from all candidates."""

import math
import random

import numpy as np
import pytest
from siftwork.operators import models, ranks, selection


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    y = (x @ rng.normal(size=6) + rng.normal(size=400) > 0).astype(int)
    return [(i, x[i].tolist(), int(y[i]), int(i % 5), float(rng.integers(0, 300))) for i in range(400)]


def numpy_triage(rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    y, source, at = (np.array([r[k] for r in rows], float) for k in (2, 3, 4))
    fit = at < np.quantile(at, 0.7)
    full = np.hstack([x, np.ones((len(x), 1))])
    weights = np.linalg.solve(full[fit].T @ full[fit] + 3 * np.eye(7), full[fit].T @ (2 * y[fit] - 1))
    linear, base = full @ weights, y.mean()
    prior = np.array([(y[source == s].sum() + 5 * base) / ((source == s).sum() + 5) for s in source])
    z = lambda v: np.clip((v - v[fit].mean()) / max(v[fit].std(), 0.05), -3, 3)
    score = z(linear) + 0.5 * z(prior)
    a, b = 1.0, 0.0
    s, t = score[~fit], y[~fit]
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p)
        step = np.linalg.solve(np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]]) + 1e-6 * np.eye(2), np.array([((p - t) * s).sum(), (p - t).sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    place = np.empty(len(s))
    place[np.lexsort((np.arange(len(rows))[~fit], s))] = np.arange(1, len(s) + 1)
    n1 = t.sum()
    return weights, score, ~fit, a, b, (place[t == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(t) - n1))


def test_triage_is_that_of_numpy(spark, rows):
    bad = [(900, None, 1, 1, 5.0), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, 1, 5.0), (902, [1.0] * 6, None, 1, 5.0)]
    df = spark.createDataFrame([(*r, "t") for r in rows + bad], "id long, x array<double>, y int, source int, at double, prior string")
    model, scored = models.train(df.drop("prior"))
    weights, score, out, a, b, area = numpy_triage(rows)
    assert np.allclose(model.weights, weights) and (model.a, model.b) == pytest.approx((a, b), rel=1e-5)
    found = {r.id: r for r in scored.withColumn("p", models.probability(scored["s"], model)).collect()}
    assert len(found) == len(rows) and all(found[i].s == pytest.approx(score[i]) and found[i].held_out == bool(out[i]) for i in found)
    assert all(found[i].p == pytest.approx(1 / (1 + math.exp(-(a * score[i] + b))), rel=1e-4) for i in found)
    assert models.ordinal_auc(scored.where("held_out")) == pytest.approx(area) and area > 0.7
    with pytest.raises(ValueError, match="no rows"):
        models.train(df.drop("prior").where("false"))


def test_places_and_quantiles(spark, monkeypatch):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5, -3.0, 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id long, x double")
    found = {r.id: r.place for r in ranks.ranked(df.where("x IS NOT NULL").repartition(7), ["x", "id"], "place").collect()}
    assert found == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1)}
    monkeypatch.setattr(ranks, "FEW", 20)
    monkeypatch.setattr(ranks, "BINS", 8)
    for share in (0.0, 0.31, 0.7, 1.0):
        assert ranks.quantile(df.select("x"), share) == pytest.approx(np.quantile(values, share))
    assert ranks.quantile(df.where("false").select("x"), 0.5) is None


def brute_shortlist(items, rules):
    items = sorted(items, key=lambda r: (-r["score"], r["item_id"]))
    chosen = []

    def take(pool, need):
        for r in pool:
            if need <= 0 or len(chosen) >= rules.size:
                return
            if r in chosen or sum(c["domain"] == r["domain"] for c in chosen) >= rules.cap or (r["story"] is not None and any(c["story"] == r["story"] for c in chosen)):
                continue
            chosen.append(r)
            need -= 1

    take([r for r in items if r["local"]], math.ceil(rules.local_min * rules.size))
    for kind, share in (("official", rules.official_min), ("independent", rules.independent_min)):
        take([r for r in items if r[kind]], math.ceil(share * rules.size) - sum(bool(c[kind]) for c in chosen))
    for t in selection.TRACKS:
        take([r for r in items if r["track"] == t], rules.track_min.get(t, 0) - sum(c["track"] == t for c in chosen))
    take(items, rules.size - len(chosen))
    return [r["item_id"] for r in sorted(chosen, key=lambda r: (selection.TRACKS.index(r["track"]), -r["score"]))]


@pytest.mark.parametrize(("seed", "size", "domains"), [(1, 12, 30), (2, 12, 3), (3, 20, 9)])
def test_shortlist_is_that_of_all_candidates(spark, seed, size, domains):
    rng = random.Random(seed)
    items = [
        dict(item_id=i, track=rng.choice(selection.TRACKS), domain=f"d{rng.randrange(domains)}", score=float(rng.randrange(40)), story=rng.choice([None, rng.randrange(60)]), local=rng.random() < 0.2, official=rng.choice([None, False, True]), independent=rng.random() < 0.4)
        for i in range(400)
    ]
    rules = selection.Rules(size, {"news": 4, "oss": 2, "research_ip": 3}, 0.2)
    df = spark.createDataFrame([(*r.values(), "x") for r in items], "item_id long, track string, domain string, score double, story long, local boolean, official boolean, independent boolean, pool string")
    found = selection.shortlist(df, rules).collect()
    assert [r.item_id for r in found] == brute_shortlist(items, rules) and [r.place for r in found] == list(range(1, len(found) + 1))
    assert selection.shortlist(df.where("false"), rules).count() == 0
