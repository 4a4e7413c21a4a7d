"""Connected components of edges between rows, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.sources.shared import spill


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


#: Edges that a task holds at once.
HELD = 1_000_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs of the same components: of each HELD edges of a task one from each node to the least that it leads to."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([np.array(p.column(k), np.int64) for p in parts]) for k in (0, 1))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, label = at[: len(a)], at[len(a) :], np.arange(len(names))
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= HELD:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    own = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    return own.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root): the least node of its component, for each node with an edge to another.

    Each round is two joins on a node, written to the shared folder; they go on until nothing changes, about the logarithm
    of the longest chain. Self-loops, nulls and repeated edges do no harm.
    """
    edges = spill(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        edges = spill(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = now
