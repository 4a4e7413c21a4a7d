"""Edits of trees: the rules one by one, snapshots against replays of the edits up to them, rollbacks, labels and previews."""

import random

import pytest
from siftwork.operators import taxonomy

COLUMNS = ("scheme", "seq", "op", "node", "parent", "name", "target")


def edit(seq, op, node, parent=None, name=None, target=None, scheme="s"):
    return (scheme, seq, op, node, parent, name, target)


BASE = [edit(1, "create", "a", name="A"), edit(2, "create", "b", "a", "B"), edit(3, "create", "c", "b", "C"), edit(4, "create", "d", "a", "D"), edit(5, "create", "e", "c", "E")]


def frame(spark, rows):
    return spark.createDataFrame(rows, taxonomy.EDIT)


def state(df):
    return {(r.scheme, r.node): (r.parent, r.name, r.status, r.target) for r in df.collect()}


def test_rules(spark):
    more = [
        edit(6, "create", "a", name="again"), edit(7, "move", "b", "e"), edit(8, "move", "c", "d"), edit(9, "merge", "b", target="d"), edit(10, "rename", "b", name="no"), edit(11, "merge", "d", target="e"),
        edit(12, "retire", "c"), edit(13, "retire", "d", target="a"), edit(14, "create", "f", "d", "F"), edit(15, "split", "a"), edit(16, "rename", "a", name="All"), edit(17, "merge", "e"), edit(18, "move", "e"),
    ]
    history = taxonomy.histories(frame(spark, BASE + more + [(None, 1, "create", "x", None, None, None)]))
    told = {r.seq: r.outcome for r in history.where("outcome IS NOT NULL").collect()}
    assert [told[k] for k in range(6, 19)] == ["refused", "refused", "moved", "merged", "refused", "refused", "retired", "retired", "refused", "refused", "renamed", "refused", "moved"]
    assert state(taxonomy.snapshot(history)) == {
        ("s", "a"): (None, "All", "active", None), ("s", "b"): ("a", "B", "merged", "d"), ("s", "c"): ("d", "C", "deprecated", None), ("s", "d"): ("a", "D", "deprecated", "a"), ("s", "e"): (None, "E", "active", None),
    }
    assert {(r.node, "/".join(r.path)) for r in taxonomy.paths(taxonomy.snapshot(history, 8)).collect()} == {("a", "a"), ("b", "a/b"), ("d", "a/d"), ("c", "a/d/c"), ("e", "a/d/c/e")}
    found = {(r.node, r.change) for r in taxonomy.differences(taxonomy.snapshot(history, 5), taxonomy.snapshot(history)).collect()}
    assert found == {("a", "renamed"), ("b", "status"), ("c", "moved"), ("c", "status"), ("d", "status"), ("e", "moved")}


@pytest.fixture(scope="module")
def log():
    rng = random.Random(9)
    rows = [edit(k, "create", f"n{k}", rng.choice([None, *[f"n{j}" for j in range(k)]]), f"name {k}", scheme=s) for s in ("x", "y") for k in range(30)]
    for seq in range(30, 150):
        node, other = f"n{rng.randrange(34)}", f"n{rng.randrange(34)}"
        op = rng.choice(["create", "rename", "move", "move", "merge", "retire"])
        rows.append(edit(seq, op, node, other if op in ("move", "create") else None, f"name {seq}", rng.choice([None, other]) if op == "retire" else other if op == "merge" else None, rng.choice(["x", "x", "y"])))
    return rows


def test_snapshots_are_replays_and_rollbacks_restore_them(spark, log):
    history = taxonomy.histories(frame(spark, log))
    history.cache()
    for upto in (29, 80, 149):
        then = state(taxonomy.snapshot(history, upto))
        assert then == state(taxonomy.snapshot(taxonomy.histories(frame(spark, [e for e in log if e[1] <= upto]))))
        for (scheme, _), (parent, _, status, target) in then.items():
            if status == "active":  # no active node below one that isn't, and no cycles
                seen = set()
                while parent is not None:
                    assert then[scheme, parent][2] == "active" and parent not in seen
                    seen.add(parent)
                    parent = then[scheme, parent][0]
            else:
                assert status == "deprecated" or target is not None
        back = [tuple(r) for r in taxonomy.rollback(history, upto).select(*COLUMNS).collect()]
        assert state(taxonomy.snapshot(taxonomy.histories(frame(spark, log + back)))) == then
    assert taxonomy.rollback(history, 149).count() == 0
    assert sum(r.outcome != "refused" for r in history.where("outcome IS NOT NULL AND seq >= 30").collect()) > 40
    assert taxonomy.histories(frame(spark, log).where("false")).count() == 0


def test_labels_follow_and_previews_count(spark, log):
    history = taxonomy.histories(frame(spark, log))
    nodes = state(taxonomy.snapshot(history))
    rng = random.Random(4)
    labels = [(i, rng.choice("xy"), f"n{rng.randrange(36)}") for i in range(200)] + [(1, "x", "n1")] * 2
    df = spark.createDataFrame(labels, "item_id long, scheme string, node string")
    want = set()
    for item, scheme, node in labels:
        while node is not None and nodes.get((scheme, node), (0, 0, "absent", None))[2] != "active":
            node = nodes.get((scheme, node), (0, 0, "absent", None))[3]
        if node is not None:
            want.add((item, scheme, node))
    after = taxonomy.relabelled(df, taxonomy.snapshot(history))
    assert sorted(tuple(r) for r in after.select("item_id", "scheme", "node").collect()) == sorted(want) and len(want) < len(set(labels))
    tree = taxonomy.paths(taxonomy.snapshot(history))
    below = {(r.scheme, r.node): set(r.path) for r in tree.collect()}
    asked = spark.createDataFrame([("x", "n0"), ("y", "n3"), ("x", "none")], "scheme string, node string")
    found = {(r.scheme, r.node): r["items"] for r in taxonomy.affected(after, tree, asked).collect()}
    assert found == {(s, n): len({i for i, t, m in want if t == s and n in below.get((t, m), ())}) for s, n in (("x", "n0"), ("y", "n3"), ("x", "none"))}


def test_paths_read_their_edges_once(spark):
    from pyspark.sql import functions as F
    from siftwork.operators import digest

    read = spark.sparkContext.accumulator(0)

    def count(x):
        read.add(1)
        return x

    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "node string, parent string")
    found = digest.paths_of(edges.select(F.udf(count, "string").asNondeterministic()("node").alias("node"), "parent"))
    assert {(r.node, r.depth) for r in found.collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4)} and read.value == 4
