"""Packing of documents into sequences of a fixed capacity, as a cutting-stock problem.

A document's ids are cut into whole sequences first; what is left, shorter than the capacity, is an item of the stock problem.
The histogram of the items' lengths (never more rows than the capacity) goes to a linear program over patterns,
multisets of lengths that fit a sequence. Its columns are generated: a knapsack by dynamic programming over the duals prices them.
The counts of the patterns that fill a sequence to the last id are rounded down; what that leaves is filled by subset sums. Then the
items of each length are ranked, and an item's rank tells its pattern, sequence and place. Items that no pattern holds run on
as one stream, cut at each full sequence and, at its end, at powers of two.
So there is no padding at all, and few documents are cut that fit a sequence whole.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.bpe import Vocabulary
from siftwork.llm.shared import new_folder, small_side, spill

CAPACITY, END = 2048, 1
#: Columns that are priced at most, and the share of sequences below which a saving isn't sought. An early stop costs only cuts.
MOST_COLUMNS, LEAST_GAIN = 300, 0.001
#: Lengths that a subset sum is first looked for among; all are, where those don't do.
TRIED = 64
#: Characters beyond which a text is encoded by runs of its matches.
LONG_TEXT = 200_000


# --- the linear program, over a histogram of at most CAPACITY lengths -------------------------------------------------


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern {length: copies} of the greatest value, where value[l] is that of an item of length l (0 or less: not used)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    backward = np.where(value > 0, value, -np.inf)[:0:-1]
    for room in range(1, capacity + 1):
        top = min(room, len(backward))
        got = best[room - top : room] + backward[len(backward) - top :]
        k = int(got.argmax())  # the longest item, of equal ones
        best[room] = best[room - 1]
        if got[k] > 0 and got[k] >= best[room]:
            best[room], last[room] = got[k], top - k
    found: dict[int, int] = {}
    room = capacity
    while room > 0:
        if last[room]:
            found[int(last[room])] = found.get(int(last[room]), 0) + 1
        room -= int(last[room]) or 1
    return float(best[capacity]), found


def _first_patterns(lengths: list[int], counts: list[float], capacity: int) -> list[dict[int, int]]:
    """For each length, the longest first, a pattern of it and of shorter ones that are still left: a triangular basis that is feasible."""
    left, out = list(counts), []
    for i, length in enumerate(lengths):
        own = capacity // length
        times, room = left[i] / own, capacity - own * length
        pattern = {length: own}
        for j in range(i + 1, len(lengths)) if times > 0 else ():
            if room < lengths[-1]:
                break
            copies = min(room // lengths[j], int(left[j] / times + 1e-9))
            if copies > 0:
                pattern[lengths[j]] = copies
                room -= copies * lengths[j]
                left[j] = max(0.0, left[j] - copies * times)
        out.append(pattern)
    return out


def relaxed(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """(pattern, times) of the relaxed problem: as few sequences as possible that hold counts[l] items of each length l.

    The simplex method with generated columns. It ends if no pattern is worth more than a sequence, if the ids themselves or Farley's
    bound prove that at most LEAST_GAIN of the sequences could be saved, or after MOST_COLUMNS.
    """
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return []
    demand, place = counts[lengths].astype(float), {int(x): i for i, x in enumerate(lengths)}
    patterns = _first_patterns(lengths.tolist(), demand.tolist(), capacity)

    def column(pattern: dict[int, int]) -> np.ndarray:
        out = np.zeros(len(lengths))
        out[[place[x] for x in pattern]] = list(pattern.values())
        return out

    basis = np.stack([column(p) for p in patterns], 1)
    value, least = np.zeros(int(lengths[0]) + 1), float(lengths @ demand) / capacity
    inverse = np.linalg.inv(basis)
    for priced in range(MOST_COLUMNS):
        times = inverse @ demand
        if times.sum() <= least * (1 + LEAST_GAIN):
            break
        value[lengths] = inverse.sum(0)
        worth, pattern = best_pattern(value, capacity)
        if 1 - 1 / max(worth, 1) <= LEAST_GAIN:
            break
        change = inverse @ (new := column(pattern))
        up = change > 1e-9
        ratio = np.full(len(change), np.inf)
        ratio[up] = np.maximum(times[up], 0) / change[up]
        out = int(ratio.argmin())
        patterns[out], basis[:, out] = pattern, new
        if priced % 100 == 99:  # rounding errors add up
            inverse = np.linalg.inv(basis)
            continue
        row, moved = inverse[out] / change[out], np.flatnonzero(np.abs(change) > 1e-12)
        inverse[moved] -= np.outer(change[moved], row)
        inverse[out] = row
    return list(zip(patterns, np.linalg.solve(basis, demand).tolist(), strict=True))


def _subset(left: list[int], lengths: list[int], room: int) -> dict[int, int] | None:
    """Items of `lengths` (the longest first, left[l] of each) whose lengths add up to `room`."""
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        for _ in range(min(left[length], room // length)):
            if reach >> room & 1:
                break
            trail.append((length, reach))
            reach |= reach << length & mask
    if not reach >> room & 1:
        return None
    found: dict[int, int] = {}
    for length, before in reversed(trail):
        if not before >> room & 1:
            found[length] = found.get(length, 0) + 1
            room -= length
    return found


def _filled(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times), each filling sequences exactly, of at most counts[l] items of each length l, the longest first, by subset sums.

    A pattern is used until a length is used up, so that their number is bounded by the capacity, not by the items.
    """
    left, out = counts.tolist(), []
    for first in range(len(left) - 1, 0, -1):
        while left[first]:
            left[first] -= 1
            room = capacity - first
            lengths = [x for x in range(min(room, first), 0, -1) if left[x]]
            found = _subset(left, lengths[:: len(lengths) // TRIED + 1], room) or _subset(left, lengths, room)
            left[first] += 1
            if found is None:
                break  # nor do the others of this length
            found[first] = found.get(first, 0) + 1
            times = min(left[length] // copies for length, copies in found.items())
            for length, copies in found.items():
                left[length] -= copies * times
            out.append((found, times))
    return out


def rounded(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times), each filling its sequences exactly and all together using at most counts[l] items of each length l."""
    left, used = counts.astype(np.int64), {}

    def use(pattern: dict[int, int], times: int) -> None:
        key = tuple(sorted(pattern.items()))
        used[key] = used.get(key, 0) + times
        for length, copies in key:
            left[length] -= copies * times

    found = [(p, x) for p, x in relaxed(counts, capacity) if x > 0 and sum(a * b for a, b in p.items()) == capacity]
    for pattern, times in found:
        fits = min(int(times + 1e-6), *(int(left[length]) // copies for length, copies in pattern.items()))
        if fits > 0:
            use(pattern, fits)
    for pattern, _ in sorted(found, key=lambda x: -(x[1] % 1)):
        if all(left[length] >= copies for length, copies in pattern.items()):
            use(pattern, 1)
    for pattern, times in _filled(left, capacity):
        use(pattern, times)
    return [(dict(k), v) for k, v in sorted(used.items(), reverse=True)]


class Plan:
    """The rounded patterns as tables by length: from which rank on a pattern's items come, and where they go."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        given = np.zeros_like(counts)
        for pattern, times in rounded(counts, capacity):
            offset = 0
            for length, copies in sorted(pattern.items(), reverse=True):
                slots.setdefault(length, []).append((int(given[length]), copies, self.sequences, offset))
                given[length] += copies * times
                offset += copies * length
            self.sequences += times
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}
        self.given = given

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of items by their length and their rank in it; -1 where no pattern holds them."""
        sequence, offset = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int64)
        for own in np.unique(length).tolist():
            at = np.flatnonzero((length == own) & (rank < (self.given[own] if own < len(self.given) else 0)))
            if len(at):
                start, copies, first, base = self.slots[own][np.searchsorted(self.slots[own][:, 0], rank[at], "right") - 1].T
                nth = rank[at] - start
                sequence[at], offset[at] = first + nth // copies, base + nth % copies * own
        return sequence, offset


# --- ids of the documents ---------------------------------------------------------------------------------------------


@functools.cache
def _encoder(path: str, pattern: str):  # noqa: ANN202
    """A function text -> ids (numpy). Texts that the library can't take, or that are very long, are encoded piece by piece."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = functools.cache(lambda: Vocabulary(path, pattern))

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.frombuffer(slow().encode(text), "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def tokens(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n, crcs, ids) for each row of `docs`: its number, ids with `end` after them (little-endian, 32 bits), how many, and the
    CRC-32 of each run of `capacity` of them. A null text counts as empty. The table is written, so that its row numbers stay."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _encoder(path, pattern), np.array([end], "<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                held = [np.concatenate([encode(x.as_py() or ""), last]) for x in part.column(1)]
                crcs = [[zlib.crc32(x[i : i + capacity].tobytes()) for i in range(0, len(x), capacity)] for x in held]
                columns = [part.column(0), pa.array([len(x) for x in held], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array([x.tobytes() for x in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "crcs", "ids"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n long, crcs array<long>, ids binary")
    made, folder = made.select(F.monotonically_increasing_id().alias("row"), "id", "n", "crcs", "ids"), new_folder(docs.sparkSession, "tokens")
    made.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def _part(row: str = "row") -> Column:
    """The task that wrote a row: the high bits of its number."""
    return F.shiftright(row, 33)


def running_starts(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows(row, ...) with `name`: the sum of `value` over all rows of smaller numbers.

    Sums within the rows of a task are carried on over the tasks of a block and over the blocks of a thousand tasks, so that no task of this
    step reads more than the rows of one task of the writer, or one row of each block.
    """
    before = (Window.unboundedPreceding, -1)
    parts = rows.groupBy(_part().alias("part")).agg(F.sum(value).alias("held")).withColumn("block", F.shiftright("part", 10))
    blocks = parts.groupBy("block").agg(F.sum("held").alias("all"))
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(*before)), F.lit(0)).alias("block_start"))
    starts = parts.join(blocks, "block").select("part", (F.col("block_start") + F.coalesce(F.sum("held").over(Window.partitionBy("block").orderBy("part").rowsBetween(*before)), F.lit(0))).alias("part_start"))
    own = rows.withColumn("part", _part())
    own = own.withColumn("own_start", F.coalesce(F.sum(value).over(Window.partitionBy("part").orderBy("row").rowsBetween(*before)), F.lit(0)))
    return own.join(starts, "part").withColumn(name, F.col("part_start") + F.col("own_start")).drop("part", "part_start", "own_start")


def _cuts(start: int, length: int, edges: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(from, length, sequence, offset) of the pieces of a stretch of the stream, counted from the stretch and from the stream's first sequence."""
    out, at = [], start
    while at < start + length:
        whole = int(edges[0])  # up to here, sequences are full
        if at < whole:
            sequence, opened, closed = at // capacity, at // capacity * capacity, (at // capacity + 1) * capacity
        else:
            k = int(np.searchsorted(edges, at, "right")) - 1
            sequence, opened, closed = whole // capacity + k, int(edges[k]), int(edges[k + 1])
        stop = min(closed, start + length)
        out.append((at - start, stop - at, sequence, at - opened))
        at = stop
    return out


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of `docs`: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, doc_row and, if asked for, ids.

    All sequences are full, but for the last few, whose lengths are different powers of two; so nothing is padded. Each row of `docs` is a
    document of its own (doc_row numbers them), also where ids are null or repeat. Null and empty texts have the one
    id `end`. Items of the same length go to sequences in the order of their row numbers. An empty table has no pieces.
    """
    held = tokens(docs, path, pattern, capacity, end, id_col, text_col)
    rows = held.select("row", "n", F.floor(F.col("n") / capacity).alias("full"), (F.col("n") % capacity).cast("int").alias("rest"))
    cells = rows.where("rest > 0").groupBy("rest", _part().alias("part")).agg(F.count(F.lit(1)).alias("held"))
    cells = spill(cells, "lengths")
    counts = np.zeros(capacity, np.int64)
    for rest, n in cells.groupBy("rest").agg(F.sum("held")).collect():  # fewer rows than the capacity
        counts[rest] = n
    plan = Plan(counts, capacity)
    starts = cells.select("rest", "part", F.coalesce(F.sum("held").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_start"))
    ranked = rows.where("rest > 0").withColumn("part", _part())
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("rest", "part").orderBy("row")))
    ranked = ranked.join(starts, ["rest", "part"]).select("row", "rest", (F.col("rank_start") + F.col("nth") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(*(np.array(batch.column(k), np.int64) for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sequence), pa.array(offset)], ["row", "rest", "sequence_id", "offset"])

    placed = spill(ranked.mapInArrow(assign, "row long, rest int, sequence_id long, offset long"), "placed")
    # Whole sequences of long documents come after those of the patterns, then the stream of what no pattern holds.
    full = running_starts(rows.where("full > 0").select("row", "full"), "full", "first")
    stream = running_starts(placed.where("sequence_id < 0").select("row", "rest"), "rest", "begin")
    n_full = rows.agg(F.sum("full")).first()[0] or 0
    total = placed.where("sequence_id < 0").agg(F.sum("rest")).first()[0] or 0
    edges, tail = [total - total % capacity], total % capacity
    while tail:
        edges.append(edges[-1] + (1 << tail.bit_length() - 1))
        tail -= 1 << tail.bit_length() - 1
    edges, base = np.array(edges, np.int64), plan.sequences + n_full

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row, *x) for row, rest, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in _cuts(begin, rest, edges, capacity)]
            pieces = np.array(out, np.int64).reshape(-1, 5)
            pieces[:, 3] += base
            yield pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in pieces.T], ["row", "from", "length", "sequence_id", "offset"])

    info = held.select("row", "id", "n", "crcs")
    whole = info.join(full, "row").select("row", "id", "n", F.posexplode(F.slice("crcs", 1, F.col("full").cast("int"))).alias("k", "crc"), "first")
    whole = whole.select("row", "id", "n", (F.col("k") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("first") + F.col("k") + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "crc")
    after = F.col("n") - F.col("n") % capacity
    kept = info.join(placed.where("sequence_id >= 0"), "row").select("row", "id", "n", after.alias("start"), F.col("rest").cast("long").alias("length"), "sequence_id", "offset", F.element_at("crcs", -1).alias("crc"))
    pieces = stream.select("row", "rest", "begin").mapInArrow(cut, "row long, `from` long, length long, sequence_id long, offset long")
    pieces = held.select("row", "id", "n", "ids").join(small_side(spill(pieces, "cuts")), "row")
    part_ids = F.substring("ids", ((after + F.col("from")) * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    cut_off = pieces.select("row", "id", "n", (after + F.col("from")).alias("start"), "length", "sequence_id", "offset", F.crc32(part_ids).alias("crc"))
    out = whole.unionByName(kept).unionByName(cut_off)
    if keep_ids:
        own = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
        out = out.join(held.select("row", "ids"), "row").withColumn("ids", own)
    return out.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset", F.col("row").alias("doc_row"), *["ids"] * keep_ids
    )
