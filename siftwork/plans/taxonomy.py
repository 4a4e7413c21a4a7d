"""The query of siftwork.operators.taxonomy; each edit depends on those before, so there is no DuckDB twin: tests hold it against replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import taxonomy
from siftwork.plans.registry import query
from siftwork.sources.adapters import table
from siftwork.sources.shared import spill


def edits(spark, d):
    """A tree of nations and customers for each region, and an edit of a customer for each order."""
    none, k = F.lit(None).cast("string"), F.col("o_orderkey")
    region = F.concat(F.lit("r"), "n_regionkey")
    nations = table(spark, d, "nation")
    tops = nations.select(region.alias("scheme"), (F.col("n_nationkey") + 1).cast("long").alias("seq"), F.lit("create").alias("op"), F.concat(F.lit("n"), "n_nationkey").alias("node"), none.alias("parent"), F.col("n_name").alias("name"), none.alias("target"))
    people = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    leaf = lambda c: F.concat(F.lit("c"), c.cast("string"))
    leaves = people.select(region, F.col("c_custkey") + 1000, F.lit("create"), leaf(F.col("c_custkey")), F.concat(F.lit("n"), "c_nationkey"), F.col("c_name"), none)
    op = F.element_at(F.array(*map(F.lit, ("move", "rename", "merge", "retire", "move", "rename", "rename"))), (k % 7 + 1).cast("int"))
    nation = F.concat(F.lit("n"), (k % 25).cast("string"))
    changes = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        region, k + 10_000_000_000, op, leaf(F.col("o_custkey")), F.when(op == "move", nation), F.concat(F.lit("name "), k.cast("string")), F.when(op == "merge", nation).when((op == "retire") & (k % 2 == 0), nation)
    )
    return tops.union(leaves).union(changes)


@query("taxonomy_after_edits")
def _(spark, d):
    nodes = spill(taxonomy.snapshot(taxonomy.histories(edits(spark, d))), "nodes")  # the edits are replayed once
    found = taxonomy.paths(nodes).select("scheme", "node", F.array_join("path", "/").alias("path"))
    return nodes.join(found, ["scheme", "node"], "left")
