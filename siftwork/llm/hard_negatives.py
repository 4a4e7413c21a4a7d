"""Hard negatives from blocks of vectors on a Hilbert curve, chosen by interval arithmetic.

All rows are sorted by label and by their place on a Hilbert curve through the axes of most variance, and written as Parquet rows
of up to BLOCK vectors, each with its labels' range and, per dimension, the least and the greatest component: a zone map.
Anchors are kept in chunks of the same order. From an anchor a and a block's zone map, interval arithmetic gives bounds of all
inner products, sum(max(a*low, a*high)) above and sum(min(a*low, a*high)) below. A look reads, for each anchor, only the blocks
that its bounds can't rule out. Two looks find the positives (a few promising blocks give thresholds; then what may beat these is
read), two more the negatives in each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.shared import spill

#: Vectors of a block, anchors of a chunk, zone maps that are judged at once, and blocks that are compared with a chunk at once.
BLOCK, CHUNK, ZONES, GROUP = 1024, 1024, 2048, 32
#: Blocks that an anchor looks into first, of each ZONES blocks.
PROBES = 2
#: Rows (by a hash) that the axes of the curve are fitted on; axes, and bits for each. The axes decide only on the order.
SAMPLE, AXES, BITS = 5_000, 8, 7
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's score has at least and at most.
LOW, HIGH = 50, 95
_MOST, _LEAST = np.int64(2**63 - 1), np.int64(-(2**63))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows with an id, a label and a non-empty vector of finite components, each as floor(scale * x), x as double.

    Rows that agree in all three columns count once. Components saturate at 64 bits.
    """
    v, finite = F.col(vector_col), F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(finite & fine).select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.distinct()


def noisy_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """`rows` with the next label, of `labels`, where `every` divides the id."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of non-negative integers below 2**bits (at most 63 bits in all).

    The curve's step from a cell to its place: from the highest bit down, a set bit of an axis inverts the lower bits of the first
    axis, a clear one exchanges them with it; a Gray code over the axes then gives the place's bits.
    """
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            up = x[i] & q != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[i] >> level & 1
    return key


def _axes(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: the axes of most variance of a sample of about SAMPLE rows, twice that at most, and the range of the sample on each."""
    hit = F.pmod(F.xxhash64("vec_id", "v"), F.lit(rows.count() // SAMPLE + 1)) == 0
    sample = rows.where(hit).select("v").limit(2 * SAMPLE).collect()
    out = {}
    for size in {len(r.v) for r in sample if r.v}:
        x = np.array([r.v for r in sample if len(r.v) == size], float)
        _, axes = np.linalg.eigh(np.cov(x.T).reshape(size, size) if len(x) > 1 else np.eye(size))
        axes = axes[:, ::-1][:, :AXES]
        at = x @ axes
        out[size] = axes, at.min(0), np.maximum(at.max(0) - at.min(0), 1e-9)
    return out


def _keyed(rows: DataFrame) -> DataFrame:
    """rows(vec_id, label, v) with `size` and `key`, their place on the curve; sizes that the sample hasn't have one place."""
    fitted = _axes(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(2).value_lengths(), np.int64)
            flat, starts = np.array(batch.column(2).flatten(), np.int64), np.append(0, np.cumsum(sizes))
            keys = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                if size in fitted:
                    at = np.flatnonzero(sizes == size)
                    axes, low, span = fitted[size]
                    place = (flat[starts[at][:, None] + np.arange(size)].astype(float) @ axes - low) / span
                    keys[at] = hilbert_keys(np.clip(np.nan_to_num(place) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(keys)], ["vec_id", "label", "v", "size", "key"])

    return rows.mapInArrow(run, "vec_id long, label long, v array<long>, size long, key long")


def _narrow(x: np.ndarray) -> bytes:
    """Integers in as many bytes as they need, the first byte telling how many."""
    for kind in ("<i2", "<i4", "<i8"):
        if kind == "<i8" or not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return kind[2].encode() + np.ascontiguousarray(x, kind).tobytes()
    raise AssertionError


def _wide(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).reshape(-1, size)


def _blocks(keyed: DataFrame, most: int) -> DataFrame:
    """(block, size, labels, ids, matrix, first, last, low, high) of each run of up to `most` rows on the curve."""
    ordered = keyed.repartitionByRange("size", "label", "key", "vec_id", "v").sortWithinPartitions("size", "label", "key", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []  # type: ignore[union-attr]

        def emit(rows: int) -> pa.RecordBatch:
            """The first `rows` of those held, as a block."""
            nonlocal number, held
            ids, labels, matrix = (np.concatenate([h[k] for h in held]) for k in range(3))
            held = [(ids[rows:], labels[rows:], matrix[rows:])] if len(ids) > rows else []
            number += 1
            ids, labels, matrix = ids[:rows], labels[:rows], matrix[:rows]
            columns = [[number], [matrix.shape[1]], [labels.tobytes()], [ids.tobytes()], [_narrow(matrix)], [int(labels.min())], [int(labels.max())], [_narrow(matrix.min(0))], [_narrow(matrix.max(0))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "size", "labels", "ids", "matrix", "first", "last", "low", "high"])

        whole, raw = pa.int64(), pa.binary()
        kinds = [whole, whole, raw, raw, raw, whole, whole, raw, raw]
        for batch in batches:
            ids, labels = (np.array(batch.column(k), "<i8") for k in (0, 1))
            sizes, flat = np.array(batch.column(2).value_lengths(), np.int64), np.array(batch.column(2).flatten(), np.int64)
            starts = np.append(0, np.cumsum(sizes))
            turns = np.flatnonzero(np.diff(sizes)) + 1
            for lo, hi in zip(np.append(0, turns).tolist(), np.append(turns, len(ids)).tolist(), strict=True):
                if lo == hi:
                    continue
                if held and held[0][2].shape[1] != sizes[lo]:
                    yield emit(most)
                held.append((ids[lo:hi], labels[lo:hi], flat[starts[lo] : starts[hi]].reshape(hi - lo, int(sizes[lo]))))
                while sum(len(h[0]) for h in held) >= most:
                    yield emit(most)
        if held:
            yield emit(most)

    return spill(ordered.mapInArrow(run, "block long, size long, labels binary, ids binary, matrix binary, first long, last long, low binary, high binary"), "blocks")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, exactly; beyond 64 bits they saturate."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(whole, int(_LEAST), int(_MOST)).astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the inner product of each anchor and any row of each block can be, by interval arithmetic, with room for rounding."""
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    slack = 1e-9 * (np.abs(anchors).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T) + 0.5
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _first(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first `most` that fit of each row: higher scores first, ties by smaller ids."""
    rows = np.flatnonzero(fits.any(1))
    fits, score = fits[rows], score[rows]
    if len(rows) and score.shape[1] > most:
        value = np.where(fits, score, _LEAST)
        fits = fits & (score >= np.partition(value, -most, 1)[:, [-most]])
    r, c = np.nonzero(fits)
    order = np.lexsort((ids[c], ~score[r, c], r))
    r, c = r[order], c[order]
    kept = _nth(r) < most
    return rows[r[kept]], c[kept]


def _nth(keys: np.ndarray) -> np.ndarray:
    """The place of each one in its run of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))


def _choose(chunks: DataFrame, zones: DataFrame, wanted: Callable[..., np.ndarray]) -> DataFrame:
    """(chunk, block, at): the anchors (places in the chunk) of each chunk that have to read a block, by its zone map.

    Chunks meet zone maps ZONES blocks at a time, by an equijoin on the part of the blocks: 2 bytes a dimension stand for a block.
    """
    parts = zones.agg(F.max("zone")).first()[0]
    spread = chunks.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(parts or 0))))
    met = spread.alias("c").join(zones.alias("z"), ["zone", "size"]).select("c.*", *[F.col(f"z.{x}").alias(f"z_{x}") for x in ("blocks", "firsts", "lasts", "lows", "highs")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                anchors = _wide(row["matrix"], size)
                blocks, first, last = (np.array(row[f"z_{x}"], np.int64) for x in ("blocks", "firsts", "lasts"))
                low, high = np.concatenate([_wide(x, size) for x in row["z_lows"]]), np.concatenate([_wide(x, size) for x in row["z_highs"]])
                least, most = bounds(anchors, low, high)
                need = wanted(row, np.frombuffer(row["labels"], "<i8"), first, last, least, most)
                at = np.flatnonzero(need.any(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(at), pa.int64()), pa.array(blocks[at]), pa.array([np.flatnonzero(need[:, k]).astype("<i2").tobytes() for k in at.tolist()], pa.binary())], ["chunk", "block", "at"]
                )

    return met.mapInArrow(run, "chunk long, block long, at binary")


def _zones(blocks: DataFrame) -> DataFrame:
    """(zone, size, blocks, firsts, lasts, lows, highs): the zone maps of up to about ZONES blocks in a row."""
    total = blocks.count()
    narrow = blocks.select("block", "size", "first", "last", "low", "high").withColumn("zone", F.pmod(F.xxhash64("block"), F.lit(1 + total // ZONES)).cast("int"))
    listed = narrow.groupBy("zone", "size").agg(F.collect_list(F.struct("block", "first", "last", "low", "high")).alias("x"))
    return spill(listed.select("zone", "size", *[F.col(f"x.{c}").alias(f"{c}s") for c in ("block", "first", "last", "low", "high")]), "zones")


def _look(chunks: DataFrame, blocks: DataFrame, chosen: DataFrame, finder: Callable[[dict], Callable[..., list[tuple]]], most: int) -> DataFrame:
    """(chunk, place, slot, score, vec_id): the first `most` for each anchor and slot that a group of blocks has, as finder(chunk) finds them.

    A chunk meets the blocks that its anchors chose GROUP blocks at a time, so a task holds no more than those and the chunk.
    """
    total = blocks.count()
    grouped = spill(chosen.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(1 + total // GROUP))), "chosen")
    read = grouped.join(blocks.select("block", "ids", "labels", "matrix"), "block").select("chunk", "grp", "at", "ids", "labels", "matrix")
    asked = chunks.join(grouped.select("chunk", F.col("grp").alias("part")).distinct(), "chunk")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        anchors, names, labels = _wide(row["matrix"], row["size"]), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        find, found = finder(row), [np.zeros((4, 0), np.int64)]
        for part in left.to_pylist():
            at, ids, own = np.frombuffer(part["at"], "<i2").astype(np.int64), np.frombuffer(part["ids"], "<i8"), np.frombuffer(part["labels"], "<i8")
            score = scores(anchors[at], _wide(part["matrix"], row["size"]))
            same, own_id = labels[at][:, None] == own[None, :], names[at][:, None] == ids[None, :]
            for slot, fits in find(at, score, same & ~own_id, ~same & ~own_id):
                r, c = _first(score, ids, fits, most)
                found.append(np.stack([at[r], np.full(len(r), slot), score[r, c], ids[c]]))
        place, slot, score, ids = np.concatenate(found, 1)
        order = np.lexsort((ids, ~score, slot, place))
        kept = order[_nth(place[order] << 8 | slot[order]) < most]
        return pa.table([pa.array(x[kept]) for x in (np.full(len(place), row["chunk"]), place, slot, score, ids)], names=["chunk", "place", "slot", "score", "vec_id"])

    return read.groupBy("chunk", "grp").cogroup(asked.groupBy(F.col("chunk").alias("own"), "part")).applyInArrow(compare, "chunk long, place long, slot long, score long, vec_id long")


def _best(found: DataFrame, most: int) -> DataFrame:
    """(chunk, place, slot, best): the first `most` (less, vec_id) of each anchor and slot; less orders scores downwards (score XOR -1)."""
    kept = F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id"))), 1, most)
    return found.groupBy("chunk", "place", "slot").agg(kept.alias("best"))


def _told(chunks: DataFrame, best: DataFrame, name: str) -> DataFrame:
    """`chunks` with `name`: what was found for its anchors, as (place, slot, best) of each that has something."""
    told = best.groupBy("chunk").agg(F.collect_list(F.struct("place", "slot", "best")).alias(name))
    return spill(chunks.join(told, "chunk", "left"), name)


def _thresholds(row: dict, name: str, slots: int, most: int) -> np.ndarray:
    """The score of the `most`-th found for each anchor and slot; the least number where fewer are known."""
    out = np.full((len(row["ids"]) // 8, slots), _LEAST)
    for x in row.get(name) or ():
        if len(x["best"]) >= most:
            out[x["place"], x["slot"]] = ~x["best"][most - 1]["less"]
    return out


def _windows(row: dict, positives: int, negatives: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the scores that a negative of each anchor and positive may have; low > high where there is no positive.

    What is known to have `negatives` of at least some score in a window raises its low end to that score.
    """
    low, high = np.ones((len(row["ids"]) // 8, positives), np.int64), np.zeros((len(row["ids"]) // 8, positives), np.int64)
    for x in row["positives"] or ():
        for k, found in enumerate(x["best"]):
            score = ~found["less"]
            low[x["place"], k], high[x["place"], k] = -(-LOW * score // 100), HIGH * score // 100
    return np.maximum(low, _thresholds(row, "tried_negatives", positives, negatives)), high


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """One row for each anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows(vec_id, label, v) as `quantised` gives them; `is_anchor` is a condition on them. A positive is one of the first `positives`
    other rows of the anchor's label; its negatives are the first `negatives` rows of other labels whose score lies between LOW and
    HIGH percent of the positive's (none does if that is negative). Higher scores come first, ties by smaller ids. Rows of the anchor's
    own id, and vectors of another length than the anchor's, are never met. Where ids repeat with other vectors or labels, each row takes part
    by itself. An empty table has no rows.
    """
    keyed = spill(_keyed(spill(rows, "vectors")), "keyed")
    blocks = _blocks(keyed, BLOCK)
    chunks = _blocks(keyed.where(is_anchor), CHUNK).select(F.col("block").alias("chunk"), "size", "labels", "ids", "matrix")
    zones = _zones(blocks)

    def probed(need: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of the needed blocks of each anchor, the PROBES whose bounds promise most."""
        value = np.where(need, most, -np.inf)
        need = need & (value >= np.sort(value, 1)[:, [-min(PROBES, value.shape[1])]])
        return need & (need.cumsum(1) <= PROBES)

    def need_positives(row: dict, labels: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        own = (first[None, :] <= labels[:, None]) & (labels[:, None] <= last[None, :])
        return own & (most >= _thresholds(row, "tried", 1, positives))

    def need_negatives(row: dict, labels: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = _windows(row, positives, negatives)
        need = np.zeros(most.shape, bool)
        for k in range(positives):
            need |= (low[:, [k]] <= high[:, [k]]) & (most >= low[:, [k]]) & (least <= high[:, [k]])
        return need & ((first[None, :] != labels[:, None]) | (last[None, :] != labels[:, None]))

    def find_positives(row: dict):  # noqa: ANN202
        known = _thresholds(row, "tried", 1, positives)
        return lambda at, score, same, other: [(0, same & (score >= known[at]))]

    def find_negatives(row: dict):  # noqa: ANN202
        low, high = _windows(row, positives, negatives)
        return lambda at, score, same, other: ((k, other & (score >= low[at, k][:, None]) & (score <= high[at, k][:, None])) for k in range(positives))

    tried = _best(_look(chunks, blocks, _choose(chunks, zones, lambda *x: probed(need_positives(*x), x[-1])), find_positives, positives), positives)
    asked = _told(chunks, tried, "tried")
    found = _best(_look(asked, blocks, _choose(asked, zones, need_positives), find_positives, positives), positives)
    with_positives = _told(chunks, found, "positives")
    tried = _best(_look(with_positives, blocks, _choose(with_positives, zones, lambda *x: probed(need_negatives(*x), x[-1])), find_negatives, negatives), negatives)
    asked = _told(with_positives, tried, "tried_negatives")
    found = spill(_best(_look(asked, blocks, _choose(asked, zones, need_negatives), find_negatives, negatives), negatives), "negatives")

    # Names of the places in the chunks, and the positives' scores.
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                out = [(row["chunk"], x["place"], k, int(ids[x["place"]]), y["vec_id"], ~y["less"]) for x in row["positives"] or () for k, y in enumerate(x["best"])]
                columns = np.array(out, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in columns], ["chunk", "place", "slot", "anchor_id", "positive_id", "positive_score"])

    pairs = with_positives.mapInArrow(named, "chunk long, place long, slot long, anchor_id long, positive_id long, positive_score long")
    listed = found.select("chunk", "place", "slot", F.posexplode("best").alias("k", "x"))
    return pairs.join(listed, ["chunk", "place", "slot"]).select(
        "anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.bitwise_not("x.less").alias("negative_score")
    )
