"""Edits of trees of topics: an ordered log replayed to the history of each node, and from it snapshots, differences, rollbacks and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.digest import paths_of
from siftwork.sources.shared import spill

EDIT = "scheme string, seq long, op string, node string, parent string, name string, target string"
HISTORY = "scheme string, seq long, node string, parent string, name string, status string, target string, outcome string"
_NAMES = [c.split()[0] for c in HISTORY.split(", ")]
_FACTS = ("parent", "name", "status", "target")


class Tree:
    """The nodes of one scheme: name -> [parent, label, status, where its labels go], and the nodes below each."""

    def __init__(self) -> None:
        self.nodes: dict[str, list] = {}
        self.below: dict[str, set[str]] = {}

    def put(self, node: str, parent: str | None, name: str | None, status: str, target: str | None) -> None:
        if node in self.nodes:
            self.below.get(self.nodes[node][0], set()).discard(node)
        if status == "absent":
            self.nodes.pop(node, None)
        else:
            self.nodes[node] = [parent, name, status, target]
            self.below.setdefault(parent, set()).add(node)

    def active(self, node: str | None) -> bool:
        return node in self.nodes and self.nodes[node][2] == "active"

    def inside(self, node: str | None, top: str) -> bool:
        while node is not None and node != top:
            node = self.nodes[node][0] if node in self.nodes else None
        return node == top

    def apply(self, op: str, node: str, parent: str | None, name: str | None, target: str | None) -> tuple[str, list[str]]:
        """(outcome, nodes that changed) of an edit; one that breaks the tree's rules is refused and changes nothing."""
        if op == "create":
            if node in self.nodes or (parent is not None and not self.active(parent)):
                return "refused", []
            self.put(node, parent, name, "active", None)
            return "created", [node]
        if not self.active(node):
            return "refused", []
        own = self.nodes[node]
        if op == "rename":
            self.put(node, own[0], name, "active", None)
            return "renamed", [node]
        if op == "move":
            if parent is not None and (not self.active(parent) or self.inside(parent, node)):
                return "refused", []
            self.put(node, parent, own[1], "active", None)
            return "moved", [node]
        if op in ("merge", "retire"):
            if (target is None and op == "merge") or (target is not None and (not self.active(target) or self.inside(target, node))):
                return "refused", []
            # What is below goes to the target, or to the parent of a node that is retired without one.
            children = sorted(c for c in self.below.get(node, ()) if self.active(c))
            for child in children:
                self.put(child, target or own[0], *self.nodes[child][1:])
            self.put(node, own[0], own[1], "merged" if op == "merge" else "deprecated", target)
            return op + "d", [node, *children]
        return "refused", []


def histories(edits: DataFrame) -> DataFrame:
    """edits(scheme, seq, op, node, parent, name, target) -> what each node is from an edit on, and what came of each edit (outcome).

    Edits of a scheme count in the order of seq, ties by op, node, parent and target; ops are create, rename, move, merge, retire and set, which rollbacks are made of (name, parent
    and target as given, the status in front of the name). Spark sorts a scheme's edits in their partition; they are read as a stream, of which one scheme's tree is held.
    An edit's own row has an outcome; rows without one are of nodes that changed with it. Rows without a scheme, seq or node take no part.
    """
    own = edits.where("scheme IS NOT NULL AND seq IS NOT NULL AND node IS NOT NULL").select([c.split()[0] for c in EDIT.split(", ")])
    ordered = own.repartition("scheme").sortWithinPartitions("scheme", "seq", "op", "node", "parent", "target")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme, tree = None, Tree()
        for batch in batches:
            out = []
            for e in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if e.scheme != scheme:
                    scheme, tree = e.scheme, Tree()
                if e.op == "set":
                    status, _, name = (e.name or "").partition(":")
                    tree.put(e.node, e.parent, name, status, e.target)
                    outcome, changed = "set", [e.node]
                else:
                    outcome, changed = tree.apply(e.op, e.node, e.parent, e.name, e.target)
                first = tree.nodes.get(e.node, [None, None, "absent", None])
                out.append((scheme, e.seq, e.node, *first, outcome))
                out += [(scheme, e.seq, n, *tree.nodes[n], None) for n in changed if n != e.node]
            yield pd.DataFrame(out, columns=_NAMES)

    return ordered.mapInPandas(scan, HISTORY)


def snapshot(history: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """(scheme, node, parent, name, status, target) as of an edit, the last if none is named; nodes that aren't there have no row."""
    rows = history if upto is None else history.where(F.col("seq") <= upto)
    # Several edits of one number are told apart by the order in which they came: refused ones say what was, as did those before.
    last = rows.groupBy("scheme", "node").agg(F.max_by(F.struct(*_FACTS), F.struct("seq", F.col("outcome").isNull(), F.coalesce("outcome", F.lit("")) != "refused")).alias("x"))
    return last.select("scheme", "node", "x.*").where("status <> 'absent'")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scheme, node, change, was, is): created, gone, renamed, moved, or changed in status, of two snapshots; a node may have several changes."""
    facts = lambda name: F.struct(*_FACTS).alias(name)
    both = before.select("scheme", "node", facts("was")).join(after.select("scheme", "node", facts("is")), ["scheme", "node"], "full")
    kinds = F.array(
        F.when(F.col("was").isNull(), "created"), F.when(F.col("is").isNull(), "gone"), *[F.when(F.col("was").isNotNull() & F.col("is").isNotNull() & ~F.col(f"was.{c}").eqNullSafe(F.col(f"is.{c}")), label) for c, label in (("name", "renamed"), ("parent", "moved"), ("status", "status"))]
    )
    return both.select("scheme", "node", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("change"), "was", "is")


def rollback(history: DataFrame, upto: int) -> DataFrame:
    """Edits, numbered on from each scheme's last, that bring all nodes back to what they were as of `upto`."""
    now, then = snapshot(history), snapshot(history, upto)
    facts = lambda name: F.struct(*_FACTS).alias(name)
    both = now.select("scheme", "node", facts("is")).join(then.select("scheme", "node", facts("was")), ["scheme", "node"], "full").where("NOT (is <=> was)")
    last = history.groupBy("scheme").agg(F.max("seq").alias("last"))
    told = F.concat(F.coalesce("was.status", F.lit("absent")), F.lit(":"), F.coalesce("was.name", F.lit("")))
    number = F.col("last") + F.row_number().over(Window.partitionBy("scheme").orderBy("node"))
    return both.join(last, "scheme").select("scheme", number.alias("seq"), F.lit("set").alias("op"), "node", F.col("was.parent").alias("parent"), told.alias("name"), F.col("was.target").alias("target"))


def paths(nodes: DataFrame) -> DataFrame:
    """(scheme, node, path, depth) of the active nodes of a snapshot."""
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat("scheme", F.lit("\x1f"), c))
    found = paths_of(nodes.where("status = 'active'").select(name("node").alias("node"), name("parent").alias("parent")))
    split = F.split("node", "\x1f")
    return found.select(split[0].alias("scheme"), split[1].alias("node"), F.transform("path", lambda x: F.split(x, "\x1f")[1]).alias("path"), "depth")


def relabelled(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """labels(item_id, scheme, node) -> where they are after the edits: labels of merged or replaced nodes go on to the target, through several if need be; those of nodes
    that were retired without one, or are not there, go. An item has a node once."""
    rows = spill(labels.select("item_id", "scheme", "node").distinct(), "labels")
    done = None
    while True:
        met = rows.join(nodes.select("scheme", "node", "status", "target"), ["scheme", "node"])
        here = met.where("status = 'active'").select("item_id", "scheme", "node")
        done = here if done is None else done.union(here)
        rows = spill(met.where("status <> 'active' AND target IS NOT NULL").select("item_id", "scheme", F.col("target").alias("node")).distinct(), "labels")
        if not rows.head(1):
            return done.distinct()


def affected(labels: DataFrame, tree: DataFrame, touched: DataFrame) -> DataFrame:
    """(scheme, node, items): how many items an edit of each of touched(scheme, node) would affect: those that have it or a node below it; tree(scheme, node, path)."""
    over = tree.select("scheme", F.col("node").alias("below"), F.explode("path").alias("node")).join(touched.select("scheme", "node").distinct(), ["scheme", "node"])
    held = labels.select("item_id", "scheme", F.col("node").alias("below"))
    return touched.select("scheme", "node").distinct().join(over.join(held, ["scheme", "below"]).groupBy("scheme", "node").agg(F.countDistinct("item_id").alias("items")), ["scheme", "node"], "left").fillna(0, ["items"])
