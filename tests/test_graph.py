"""Groups that shared identifiers hold together, against a plain union of sets."""

import random

from siftwork.operators import stories


def test_groups_are_those_of_a_plain_union(spark):
    rng = random.Random(7)
    rows = [(i, [f"r{rng.randrange(150)}" for _ in range(rng.randrange(4))] + (["hot"] if i % 9 == 0 else [])) for i in range(200)] + [(900, None)]
    found = {r.id: r.group for r in stories.reference_groups(spark.createDataFrame(rows, "id long, refs array<string>"), "id", "refs").collect()}
    label = {i: i for i, _ in rows}
    while True:
        least = {}
        for i, refs in rows:
            for r in refs or ():
                least[r] = min(least.get(r, label[i]), label[i])
        new = {i: min([label[i], *(least[r] for r in refs or ())]) for i, refs in rows}
        if new == label:
            break
        label = new
    sizes = {g: list(label.values()).count(g) for g in label.values()}
    assert found == {i: g for i, g in label.items() if sizes[g] > 1}


def test_identifiers_are_found_once(spark):
    from pyspark.sql import functions as F

    found = spark.sparkContext.accumulator(0)

    def refs(i):
        found.add(1)
        return [f"a{i // 2}", f"b{i % 5}"] if i < 40 else [f"c{i}"]

    rows = spark.range(50).select("id", F.udf(refs, "array<string>").asNondeterministic()("id").alias("refs"))
    assert {(r.id, r.group) for r in stories.reference_groups(rows, "id", "refs").collect()} == {(i, 0) for i in range(40)} and found.value == 50


def test_bands_in_blocks_give_each_alike_pair_once(spark, monkeypatch):
    monkeypatch.setattr(stories, "BLOCK", 8)
    monkeypatch.setattr(stories, "CHUNK", 50)
    rng = random.Random(2)
    base = [[rng.randrange(2**31 - 1) for _ in range(64)] for _ in range(3)]
    sigs = {i: [v if rng.random() < 0.75 else rng.randrange(2**31 - 1) for v in base[i % 3]] for i in range(90)}
    df = spark.createDataFrame(list(sigs.items()), "item_id long, sig array<long>")
    same = lambda a, b: [x == y for x, y in zip(sigs[a], sigs[b], strict=True)]
    want = [(b, a, sum(same(a, b)) / 64) for a in sigs for b in sigs if a < b and sum(same(a, b)) >= 0.45 * 64 and any(all(same(a, b)[k : k + 4]) for k in range(0, 64, 4))]
    assert sorted(tuple(r) for r in stories.alike_signatures(df, 0.45).collect()) == sorted(want) and len(want) > 200
    assert stories.alike_signatures(df.where("false"), 0.45).count() == 0
