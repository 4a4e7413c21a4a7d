"""Merkle manifest of a table: a tree of digests for each source, one over the sources' roots, and each row's proof.

Every level is an equijoin of its nodes with themselves by computed sibling indices: index XOR 1 for binary trees, else the slots'
offsets in a run. The rows of slot zero then hold their whole run and emit the parent. Each node joins back to its run's slot zero,
and so gets its siblings. Rows get their indices from a range sort, not from a window over a source: a source may hold
most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.shared import small_side, spill

ARITY = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """H: lowercase hex SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def field(column: Column) -> Column:
    """A column's value as a leaf holds it: `-` for null, else its bytes in UTF-8, a colon, the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes(tree, idx, h) -> (tree, parent, run): the digests of each run of `arity` consecutive nodes, in order.

    The rows of slot zero ask for the indices of their siblings and join the nodes that have them.
    """
    firsts = nodes.where(F.col("idx") % arity == 0)
    if arity == 2:
        asked = firsts.select("tree", F.col("idx").alias("first"), F.expr("idx ^ 1").alias("idx"))
    else:
        asked = firsts.select("tree", F.col("idx").alias("first"), F.explode(F.expr(f"transform(sequence(1, {arity - 1}), o -> idx + o)")).alias("idx"))
    found = asked.join(nodes, ["tree", "idx"]).groupBy("tree", "first").agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("others"))
    joined = firsts.join(found.withColumnRenamed("first", "idx"), ["tree", "idx"], "left")
    run = F.concat(F.array("h"), F.coalesce(F.expr("transform(others, x -> x.h)"), F.array().cast("array<string>")))
    return joined.select("tree", (F.col("idx") / arity).cast("long").alias("parent"), run.alias("run"))


def _climb(leaves: DataFrame, counts: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """leaves(tree, idx, h), counts(tree, n) -> (roots(tree, root), paths(tree, parent, path)).

    A tree's nodes are joined in runs while it has more than one. paths has a row for each run of leaves: the runs from there to the
    root, each with the slot that the way up takes in it; the first one's slot is left open (-1), since all its leaves share the row.
    """
    most = counts.agg(F.max("n")).first()[0] or 0
    levels, nodes, width = [], leaves, most
    roots = leaves.join(small_side(counts.where("n = 1").select("tree")), "tree", "left_semi").select("tree", F.col("h").alias("root"))
    wide = counts.where("n > 1")
    while width > 1:
        runs = spill(_runs(nodes.join(small_side(wide.select("tree")), "tree", "left_semi"), arity), "runs")
        levels.append(runs)
        nodes = runs.select("tree", F.col("parent").alias("idx"), digest(F.array_join("run", "")).alias("h"))
        wide = wide.withColumn("n", F.ceil(F.col("n") / arity))
        done = small_side(wide.where("n = 1").select("tree"))
        roots = roots.union(nodes.join(done, "tree", "left_semi").select("tree", F.col("h").alias("root")))
        wide, width = wide.where("n > 1"), -(-width // arity)
    empty = F.expr("array()").cast("array<struct<run: array<string>, slot: int>>")
    path = None
    for runs in reversed(levels):
        own = F.array(F.struct("run", F.lit(-1).alias("slot")))
        if path is None:
            path = runs.select("tree", "parent", own.alias("path"))
            continue
        above = path.select("tree", F.col("parent").alias("up"), F.col("path").alias("rest"))
        here = runs.withColumn("up", (F.col("parent") / arity).cast("long")).join(above, ["tree", "up"], "left")
        slot = (F.col("parent") % arity).cast("int")
        placed = F.transform(F.coalesce("rest", empty), lambda x: F.struct(x["run"].alias("run"), F.when(x["slot"] < 0, slot).otherwise(x["slot"]).alias("slot")))
        path = spill(here.select("tree", "parent", F.concat(own, placed).alias("path")), "proofs")
    return roots, path if path is not None else leaves.where("false").select("tree", F.col("idx").alias("parent"), empty.alias("path"))


def siblings(path: Column) -> Column:
    """The digests of a path's siblings, left to right and from below, as one text."""
    others = F.transform(path, lambda x: F.array_join(F.filter(x["run"], lambda _, i: i != x["slot"]), ""))
    return F.array_join(others, "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, x: digest(F.array_join(F.transform(x["run"], lambda y, i: F.when(i == x["slot"], h).otherwise(y)), "")))


def leaves(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, grp, leaf, seen) for each row of `docs`: its digest, and that of the row as it is found again.

    Where 5 divides the CRC-32 of the decimal id, the row is found with A-Z of its text lower-cased; rows without an id are found as they were.
    """
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = F.when(hit, F.translate(F.col(text_col), _UPPER, _LOWER)).otherwise(F.col(text_col))
    whole = lambda text: digest(F.concat(*[field(text if c == text_col else F.col(c)) for c in fields]))
    return docs.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), whole(F.col(text_col)).alias("leaf"), F.when(hit, whole(found)).alias("changed"), hit.alias("hit")).select(
        "id", "grp", "leaf", F.when(F.col("hit"), F.col("changed")).otherwise(F.col("leaf")).alias("seen")
    )


def manifest(docs: DataFrame, arity: int = ARITY, group: str = "source", id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row for each row of `docs`: the id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaves of a source ascend by id, null ids first, rows of the same id by their digests (equal rows are leaves of their own). A tree of one
    leaf has it as its root, and its leaf has no siblings. The null source is a source of its own, before all others. Folded roots come
    from the row as it is found again (see `leaves`). An empty table has no rows and no root.
    """
    found = leaves(docs, fields, group, id_col, text_col)
    sorted_rows = found.repartitionByRange("grp", "id", "leaf", "seen").sortWithinPartitions("grp", "id", "leaf", "seen")
    rows = spill(sorted_rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")  # number of the task, then of the row in it
    part = F.shiftright("nth", 33)
    cells = spill(rows.groupBy("grp", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first")), "cells")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("grp", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("part", part).alias("r").join(small_side(spill(cells, "starts")).alias("c"), F.expr("r.grp <=> c.grp AND r.part = c.part"))
    tree = F.struct(F.col("r.grp").isNotNull().alias("named"), F.coalesce(F.col("r.grp").cast("string"), F.lit("")).alias("name"))
    placed = spill(placed.select("id", tree.alias("tree"), (F.col("nth") - F.col("first") + F.col("start")).alias("idx"), "leaf", "seen"), "placed")
    counts = spill(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "counts")
    subroots, paths = _climb(placed.select("tree", "idx", F.col("leaf").alias("h")), counts, arity)
    subroots = spill(subroots, "subroots")
    # The tree over the sources: as many leaves as there are sources, ranked by the same kind of sort.
    ranked = spill(subroots.repartitionByRange("tree").sortWithinPartitions("tree").withColumn("nth", F.monotonically_increasing_id()), "sources")
    tops = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    tops = tops.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a task
    top = ranked.withColumn("part", part).join(tops, "part").select(F.lit(0).alias("tree"), (F.col("nth") - F.col("first") + F.col("start")).alias("idx"), F.col("root").alias("h"), F.col("tree").alias("own"))
    top = spill(top, "sources")
    roots, above = _climb(top.select("tree", "idx", "h"), top.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), arity)
    roots = F.broadcast(spill(roots, "root"))  # one row
    empty = F.expr("array()").cast("array<struct<run: array<string>, slot: int>>")
    in_run = lambda path, slot: F.transform(path, lambda x: F.struct(x["run"].alias("run"), F.when(x["slot"] < 0, slot).otherwise(x["slot"]).alias("slot")))
    over = top.withColumn("parent", (F.col("idx") / arity).cast("long")).join(above, ["tree", "parent"], "left").join(roots, "tree")
    over = over.select(F.col("own").alias("tree"), F.col("h").alias("subroot"), "root", in_run(F.coalesce("path", empty), (F.col("idx") % arity).cast("int")).alias("over"))
    over = small_side(spill(over, "over"))
    upper = placed.withColumn("parent", (F.col("idx") / arity).cast("long")).join(paths, ["tree", "parent"], "left").join(over, "tree")
    path = F.concat(in_run(F.coalesce("path", empty), (F.col("idx") % arity).cast("int")), F.col("over"))
    return upper.withColumn("whole", path).select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", digest(siblings(F.col("whole"))).alias("proof_sha256"), folded(F.col("seen"), F.col("whole")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
