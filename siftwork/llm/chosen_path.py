"""N-gram Jaccard join of documents by chosen paths.

Each distinct set of word shingles is embedded as `COORDINATES` MinHash values, so that a shared token is a value shared
at a coordinate. A run splits all sets at once: a node of its tree samples coordinates with a hash of its own path,
and a set goes to one child for each, named by the value there. Buckets of two up to `LEAF` sets are compared by brute
force; larger ones split again. Runs are repeated until a pair at the threshold is missed with a chance below
1 - recall. Buckets leave candidate components; within each, all sets are compared exactly, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.components import components, stars
from siftwork.llm.shared import BROADCAST_ROWS, fresh, small_side, spill
from siftwork.llm.textvec import mix, shingle_sets

COORDINATES, LEAF, DEEPEST = 64, 64, 13
#: Once no bucket has more members, all that are left are compared: further levels would cost more than they save.
LAST = 512
#: Members of a large bucket that all of it is compared with.
PIVOTS = 8
#: Large buckets whose pivots' sketches (about 2,200 bytes a bucket) are broadcast at most.
BROADCAST_PIVOTS = 10_000
#: Sets in the buckets that are compared together, and members of large buckets that a task splits, about.
GROUP_SETS, TASK_SETS = 20_000, 20_000
#: Of sets, and of their shingles, that one block holds at most (a longer set has a block of its own).
BLOCK_SETS, BLOCK_SHINGLES = 256, 250_000
#: Rings of distances to a large component's first set; rows of such sets (or of all rings of a component) that are broadcast at most.
RINGS, PIVOT_ROWS = 50, 20_000
_EDGES = (np.arange(COORDINATES + 1, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)
_PROBES = np.random.default_rng(7).integers(0, COORDINATES, (400, COORDINATES))


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met in a bucket of depth 4 or less with the chance `recall`."""
    miss = 0.75 * (1 - threshold) + 0.25 * (1 - threshold) ** 2  # of one or two coordinates, none is shared
    met = 1.0
    for _ in range(4):
        met *= 1 - miss
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set; an empty bin copies the first full one of its fixed probes."""
    at = np.searchsorted(shingles, _EDGES[:-1])
    full = at < np.append(at[1:], len(shingles))
    out = np.zeros(COORDINATES, np.uint32)
    out[full] = (shingles[at[full]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    left = np.flatnonzero(~full)
    for probes in _PROBES:
        if not len(left):
            break
        hit = full[probes[left]]
        out[left[hit]] = out[probes[left[hit]]]
        left = left[~hit]
    if len(left):
        out[left] = out[np.flatnonzero(full)[0]]
    return out


def _sketched(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_hash, n, d, sig) for each row: shingles in its set, a hash of the set, the signature (null if no words)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sigs = [], [], []
            for own in shingle_sets(batch.column(2), words):
                counts.append(len(own))
                digests.append(int(mix(own).sum(dtype=np.uint64).view(np.int64)) if len(own) else None)
                sigs.append(signature(own).tobytes() if len(own) else None)
            made = [pa.array(counts, pa.int64()), pa.array(digests, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "text_hash", "n", "d", "sig"])

    return rows.mapInArrow(run, f"id {id_type}, text_hash long, n long, d long, sig binary")


def _children(nodes: np.ndarray, sigs: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, set) of each set at its node: one coordinate that the node samples, and with odds of one in four another."""
    rows = np.arange(len(nodes))
    first = (mix(nodes + np.uint64(1)) % np.uint64(COORDINATES)).astype(np.int64)
    second = (mix(nodes + np.uint64(2)) % np.uint64(COORDINATES)).astype(np.int64)
    two = (mix(nodes + np.uint64(3)) & np.uint64(3) == 0) & (first != second)
    name = lambda c, r: mix(mix(nodes[r] ^ (c.astype(np.uint64) << np.uint64(40))) + sigs[r, c].astype(np.uint64))
    return np.concatenate([name(first, rows), name(second[two], rows[two])]), np.concatenate([sets, sets[two]])


def _roots(sigs: DataFrame, runs: int) -> DataFrame:
    """(d, sig) -> (d, node): the children of the roots of `runs` trees that each set goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets, rows = np.array(batch.column(0), np.int64), _matrix(batch.column(1))
                for r in range(runs):
                    root = np.full(len(sets), mix(np.array([r + 1], np.uint64))[0])
                    child, own = _children(root, rows, sets)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(child.view(np.int64))], ["d", "node"])

    return sigs.mapInArrow(run, "d long, node long")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in sigs), np.uint32).reshape(-1, COORDINATES)


def _bins(n: np.ndarray) -> np.ndarray:
    """About how many coordinates of a set of n shingles have a shingle of their own."""
    return COORDINATES * (1 - np.exp(-np.maximum(n, 1) / COORDINATES))


def _least_likeness(similarity: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the sketches of sets of n and m shingles agree in at least, but for a chance of 1 in 70,000, if they are so similar."""
    return similarity - 4.2 * np.sqrt(similarity * (1 - similarity) / np.minimum(_bins(n), _bins(m)))


def _split(held: DataFrame, threshold: float) -> DataFrame:
    """Members (d, n, sig, node, pivots) of large buckets -> (a, node, b): a goes to the bucket `node` one level below, or is tied to b.

    A set whose sketch agrees with a pivot's to the threshold is taken out of the bucket and goes no further. It is tied
    to the pivot, and so is each set that may be at the threshold with one that is taken out. The ties of a batch are
    given as stars, from each set to one that it leads to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tied = [np.zeros((2, 0), np.int64)]
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                d, n, rows, node = np.array(part.column(0), np.int64), np.array(part.column(1), np.int64), _matrix(part.column(2)), np.array(part.column(3), np.int64)
                pivots = part.column(4)
                own = np.repeat(np.arange(len(d)), np.array(pivots.value_lengths()))
                pivots = pivots.flatten()
                like = (rows[own] == _matrix(pivots.field("sig"))).mean(1)
                taken = like >= threshold
                # The share of coordinates that differ is a metric: this is what a set like a taken one has of its pivot.
                halo = like >= threshold + _least_likeness(threshold, threshold * n, threshold * n)[own] - 1
                tied.append(np.stack([d[own], np.array(pivots.field("d"), np.int64)])[:, halo])
                on = np.ones(len(d), bool)
                on[own[taken]] = False
                child, back = _children(node[on].view(np.uint64), rows[on], d[on])
                nothing = pa.nulls(len(back), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(back), pa.array(child.view(np.int64)), nothing], ["a", "node", "b"])
            a, b = stars(*np.concatenate(tied, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], ["a", "node", "b"])

    return held.mapInArrow(run, "a long, node long, b long")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most `rows` rows as counted before, marked for broadcast if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _labels(linked: np.ndarray) -> np.ndarray:
    """The first member of each one's component, of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidate_edges(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """reps(d, n, sig) -> (a, b): edges whose components hold each pair that met in a bucket and has like sketches.

    All members of a large bucket are compared with its pivots. Those like a pivot go no further; whatever is similar to
    one that is taken out is, by the triangle inequality, still somewhat like its pivot, and is tied to that. A bucket
    all of whose sets were tied together at the first level is done, too, so that a group of near copies doesn't stay
    together from level to level. A bucket still larger than LEAF at depth DEEPEST is not dropped: each of its sets is tied to a
    pivot, and the exact comparison decides.
    """
    sigs = reps.select("d", "n", "sig")
    rows, lists, depth = spill(_roots(reps.select("d", "sig"), runs_for(recall, threshold)), "paths"), None, 1
    held_sets = 0
    ties, known = None, None  # (a, b): edges; each set that was tied at the first level, and the least of its component
    while True:
        # The same hashes in all buckets: sets that meet in many buckets then have the same few pivots there.
        firsts = [F.min_by("d", F.xxhash64("d", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
        group = F.col("d")
        if known is not None:
            named = rows.join(known, F.col("d") == F.col("a"), "left").select("d", "node", F.coalesce("b", "d").alias("root"))
            group = F.col("root")
        sizes = (rows if known is None else named).groupBy("node").agg(F.count(F.lit(1)).alias("size"), (F.min(group) != F.max(group)).alias("mixed"), *firsts).where("mixed")
        sizes = spill(sizes.select("node", "size", F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivots")), "buckets")
        most, total, many, sets, split = sizes.agg(
            F.max("size"), F.count(F.lit(1)), F.count_if(F.col("size") > LEAF), F.sum("size"), F.sum(F.when(F.col("size") > LEAF, F.col("size")))
        ).first()
        held_sets += sets or 0
        leaf, many = (LAST, 0) if depth > 1 and (most or 0) <= LAST else (LEAF, many)
        few = total - many
        small = rows.join(_sized(sizes.where(F.col("size") <= leaf).select("node"), few), "node")
        small = small.groupBy("node").agg(F.sort_array(F.collect_set("d")).alias("members")).select("members")
        lists = small if lists is None else lists.union(small)
        if not many:
            break
        large = sizes.where(F.col("size") > LEAF).select("node", "pivots")
        if depth == DEEPEST:
            tied = rows.join(_sized(large, many), "node").select(F.col("d").alias("a"), F.element_at("pivots", 1).alias("b")).where("a <> b")
            ties = tied.union(ties)
            break
        asked = large.select("node", F.explode("pivots").alias("d")).join(sigs, "d")
        asked = asked.groupBy("node").agg(F.collect_list(F.struct("d", "sig")).alias("pivots"))
        # All memberships of a set come to one task, and to few enough tasks that their ties to the same pivots become one.
        # The pivots, most of a row, come last: nothing is sorted with them.
        held = rows.select("d", "node").join(_sized(large.select("node"), many), "node", "left_semi").repartition("d").join(sigs, "d")
        held = held.join(F.broadcast(asked) if many <= BROADCAST_PIVOTS else asked, "node").select("d", "n", "sig", "node", "pivots")
        parts = spill(_split(held.coalesce(1 + split // TASK_SETS), threshold), "paths")
        tied = parts.where("b IS NOT NULL").select("a", "b")
        ties = tied if ties is None else ties.union(tied)
        if known is None:
            found = components(ties)
            ties = found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
            known = small_side(ties)
        rows, depth = parts.where("b IS NULL").select(F.col("a").alias("d"), "node"), depth + 1
    lists = lists.where("size(members) > 1").distinct().select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("d"))
    # Buckets go to tasks in groups of about GROUP_SETS sets, so that no more than those are in a worker's memory.
    part = F.pmod(F.xxhash64("bucket"), F.lit(1 + held_sets // GROUP_SETS))
    full = lists.join(reps.select("d", "n", "sig"), "d").select(part.alias("part"), "bucket", "d", "n", "sig")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket").combine_chunks()
        bucket = np.array(table.column("bucket"), np.int64)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        a, b = [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
            own = table.slice(lo, hi - lo)
            d, n, sig = np.array(own.column("d"), np.int64), np.array(own.column("n"), np.int64), _matrix(own.column("sig"))
            label = _labels(np.stack([(sig == row).mean(1) for row in sig]) >= _least_likeness(threshold, n[:, None], n[None, :]))
            moved = np.flatnonzero(label != np.arange(len(d)))
            a.append(d[moved])
            b.append(d[label[moved]])
        a, b = stars(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": a, "b": b})

    edges = full.groupBy("part").applyInArrow(compare, "a long, b long")
    return edges if ties is None else edges.union(ties)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    held = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    new = np.append(True, held[1:] != held[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    out = np.zeros((len(sets), len(sets)), np.float64)
    out[np.arange(len(sets)), np.arange(len(sets))] = [len(s) for s in sets]
    owner, column = owner[shared], column[shared]
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    total = np.zeros_like(out)
    width = 4096
    for k in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [k, k + width])
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[lo:hi], column[lo:hi] - k] = 1
        total += grid @ grid.T
    np.fill_diagonal(total, 0)
    return out + total


def _texts_of(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """members(..., id, text_hash) -> the same rows with `text` in place of id and text_hash."""
    texts = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"), F.col(text_col).alias("text"))
    rows = texts.join(small_side(members), F.col("own_hash").eqNullSafe(F.col("text_hash")) & F.col("own_id").eqNullSafe(F.col("id")))
    return rows.select(*[c for c in members.columns if c not in ("id", "text_hash")], "text")


def _with_sets(rows: DataFrame, words: int, kept: list[str], tell: Callable[[pa.RecordBatch, list[np.ndarray]], pa.Array], told: str, kind: str) -> DataFrame:
    """rows(..., text) -> the columns `kept` and `told`, which `tell` gives for the shingles of up to 500 texts."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                out = tell(part, list(shingle_sets(part.column("text"), words)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], out], [*kept, told])

    return rows.mapInArrow(run, f"{schema}, {told} {kind}")


def _shingled(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """members(..., id, text_hash) -> the same rows with `own`, the shingles of the text, in place of id and text_hash."""
    rows = _texts_of(members, docs, id_col, text_col)
    return _with_sets(rows, words, rows.columns[:-1], lambda part, sets: pa.array([s.tobytes() for s in sets], pa.binary()), "own", "binary")


def _ringed(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Members of components of more than one block -> (root, pivot, d, far): the exact distance to the component's first set."""
    large = members.where("blocks > 1")
    first = large.groupBy("root").agg(F.min_by(F.struct("d", "id", "text_hash"), "d").alias("x")).select("root", "x.d", "x.id", "x.text_hash")
    first = spill(_shingled(first, docs, id_col, text_col, words).groupBy("root", "d").agg(F.first("own").alias("core")), "pivots")
    texts = _texts_of(large.select("root", "d", "id", "text_hash"), docs, id_col, text_col)
    rows = texts.join(small_side(first.select("root", F.col("d").alias("pivot"), "core"), PIVOT_ROWS), "root").select("root", "pivot", "d", "core", "text")

    def far(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.Array:
        out = []
        for x, core in zip(sets, part.column("core"), strict=True):
            y = np.frombuffer(core.as_py(), np.uint64)
            shared = len(np.intersect1d(x, y, True))
            out.append(1 - shared / (len(x) + len(y) - shared))
        return pa.array(out, pa.float64())

    # Shingles and distances come from one function: a task needs one Python worker, not two.
    return spill(_with_sets(rows, words, ["root", "pivot", "d"], far, "far", "double").distinct(), "rings")


def _exact_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """members(root, blocks, d, id, text_hash, copies, n) -> (d, label, links): parts of a set's links, and a set that it leads to.

    A component of few sets is one block, whose sets are all compared. The sets of a larger one lie in rings by their
    exact distance to its first set. By the triangle inequality all sets of two near rings are linked, and those of rings
    far apart are not: only what lies between is compared, in pairs of blocks of BLOCK_SETS sets.
    """
    reach = 1 - threshold
    ring = F.least(F.floor(F.col("far") * RINGS), F.lit(RINGS - 1)).cast("int")
    far = _ringed(members, docs, id_col, text_col, words).withColumn("ring", ring)
    placed = members.join(far.drop("root"), "d", "left").withColumn("ring", F.coalesce("ring", F.lit(0)))
    placed = spill(placed.select("root", "ring", "d", "id", "text_hash", "copies", "n", "pivot", F.coalesce("far", F.lit(0.0)).alias("far"), "blocks"), "placed")
    rings = placed.groupBy("root", "ring").agg(
        F.min("far").alias("near"), F.max("far").alias("most"), F.sum("copies").alias("held"), F.max("blocks").alias("blocks"),
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"),
    )
    by_root = rings.groupBy("root").agg(F.collect_list(F.struct("ring", "near", "most", "held", "parts")).alias("rings"))  # RINGS at most
    here = F.expr("filter(rings, r -> r.ring = ring)[0]")
    placed = placed.join(small_side(spill(by_root, "ring-sizes"), PIVOT_ROWS), "root").withColumn("here", here)
    sure = f"blocks > 1 AND r.most + here.most <= {reach - 1e-9}"
    none = f"greatest(r.near - here.most, here.near - r.most) > {reach + 1e-9}"
    linked = placed.where("blocks > 1").select("d", F.when((F.col("far") <= reach + 1e-9) & (F.col("far") > 0), F.col("pivot")).otherwise(F.col("d")).alias("label"),
        (F.expr(f"aggregate(filter(rings, r -> {sure}), 0L, (n, r) -> n + r.held)") - F.when(F.expr(sure.replace("r.", "here.")), F.col("copies")).otherwise(0)).alias("links"))
    spread = placed.withColumn("others", F.expr(f"flatten(transform(filter(rings, r -> NOT ({sure}) AND NOT ({none})), r -> transform(sequence(0, r.parts - 1), p -> r.ring * {1 << 24} + p)))"))
    spread = spread.withColumn("block", F.expr(f"ring * {1 << 24} + cast(pmod(xxhash64(d), here.parts) as int)")).where("size(others) > 0")
    sets = _shingled(spread.select("root", "block", "others", "d", "copies", "id", "text_hash"), docs, id_col, text_col, words)
    sets = sets.withColumn("other", F.explode("others"))
    sets = sets.select("root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "d", "copies", "own")

    def compare(table: pa.Table) -> pa.Table:
        d = np.array(table.column("d"), np.int64)
        _, first = np.unique(d, return_index=True)  # rows with a null id may come more than once
        table, d = table.take(pa.array(first)), d[first]
        own = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("own")]
        size = np.array([len(x) for x in own], np.float64)
        shared = _overlaps(own)
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        if p != q:
            block = np.array(table.column("block"))
            linked &= block[:, None] != block[None, :]
        copies = np.array(table.column("copies"), np.int64)
        at = np.flatnonzero(linked.any(1))
        return pa.table({"d": d[at], "label": d[_labels(linked)[at]], "links": linked[at].astype(np.int64) @ copies})

    return sets.groupBy("root", "p", "q").applyInArrow(compare, "d long, label long, links long").union(linked)


def similarity_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, recall: float = 0.9999
) -> DataFrame:
    """One row for each row of `docs`: the id, class_id, n_links, copy_id.

    Two rows are linked if the sets of their runs of `words` words (A-Z lower-cased; one run of all words where there
    are fewer) have a Jaccard similarity of `threshold` or more. class_id is the smallest id that links lead to,
    copy_id the smallest id with the same set, n_links the number of other rows linked, copies with it. Rows with the
    same set are one vertex, so copies are never paired. Rows without words (null and empty texts too) have no links and
    their own id as class_id. Rows with a null id take part; a class of only those has a null class_id.
    """
    sketched = spill(_sketched(docs, id_col, text_col, words), "sketches")
    reps = sketched.where("n > 0").groupBy("d").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.first("sig").alias("sig"),
        F.first("n").alias("n"),
    )
    reps = spill(reps.select("d", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), "copies", "sig", "n"), "sets")
    found = components(spill(candidate_edges(reps, threshold, recall), "candidates"))
    members = spill(found.join(reps.drop("sig"), found["node"] == reps["d"]).select("root", "d", "id", "text_hash", "copies", "n"), "members")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "root").select("root", "blocks", "d", "id", "text_hash", "copies", "n")
    linked = spill(_exact_links(members, docs, id_col, text_col, words, threshold), "links")
    classes = components(linked.select(F.col("d").alias("a"), F.col("label").alias("b")))
    named = classes.join(reps.select("d", "id"), F.col("node") == F.col("d")).select("d", "id", "root")
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    totals = linked.groupBy("d").agg(F.sum("links").alias("links"))
    info = named.join(least, "root").join(totals, "d").select("d", "class_id", "links")
    info = reps.select("d", F.col("id").alias("copy_id"), "copies").join(info, "d", "left")
    info = small_side(spill(info.where("copies > 1 OR links > 0"), "classes"))
    return sketched.select("id", "d").join(info, "d", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("links") > 0, F.col("class_id")).otherwise(F.coalesce("copy_id", "id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copy_id", "id").alias("copy_id"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of `docs`, with all their columns, but for those that aren't the first of their class. Null ids stay."""
    classes = similarity_classes(docs, id_col, text_col, **options)
    own = fresh(docs, "dropped_id")
    dropped = spill(classes.where(f"class_id <> `{id_col}`").select(F.col(id_col).alias(own)).distinct(), "dropped")
    return docs.join(small_side(dropped), docs[id_col] == F.col(own), "left_anti")
