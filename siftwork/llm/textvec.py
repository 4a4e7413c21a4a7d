"""Words and word shingles of Arrow strings as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18

_rng = np.random.default_rng(20_240_101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Byte -> byte of a lower-cased word, 0 outside words: 0-9, a-z, A-Z (lower-cased) and all of a non-ASCII letter.
LOWER = np.zeros(256, np.uint8)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of strings, nulls as empty, about `most` bytes at a time."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of each word of rows that lie end to end in `data`."""
    low = LOWER[data]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    starts = np.flatnonzero(first)
    begin = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    weight = _PLACE[place & 0xFFF]
    far = np.flatnonzero(place > 0xFFF)
    weight[far] = mix(weight[far] + (place[far] >> 12).astype(np.uint64)) | np.uint64(1)
    hashes = np.add.reduceat(_BYTE[low[at]] * weight, begin)
    return mix(hashes + lengths.astype(np.uint64)), starts, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words, and where each row's begin. A row of fewer words, but not none, has one."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    held = np.minimum(counts, size)
    made = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        if j:
            made += np.where(np.repeat(held, counts) > j, padded[j : j + len(hashes)], np.uint64(0)) * _STEP[j]
        else:
            made += hashes * _STEP[0]
    keep = np.arange(len(hashes)) - np.repeat(first[:-1], counts) < np.repeat(np.maximum(counts - size + 1, np.minimum(counts, 1)), counts)
    made = mix(made[keep])
    return made, np.concatenate([[0], np.cumsum(np.maximum(counts - size + 1, np.minimum(counts, 1)))])


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    for _, data, offsets in chunks(column):
        hashes, _, rows = words(data, offsets)
        made, first = shingles(hashes, rows, len(offsets) - 1, size)
        for i in range(len(offsets) - 1):
            yield np.unique(made[first[i] : first[i + 1]])
