"""Byte-level BPE in numpy: distinct pieces of a batch are merged together, as rows of length-bucketed padded matrices.

In each round every row merges its leftmost pair of the lowest rank; pairs are looked up in a hash table and rows are
compacted by one column. Pieces beyond `LONGEST` bytes, for which rounds over a matrix would take quadratic time,
are merged by the same rule with a heap.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONGEST = 256
#: Pieces whose ids a Python worker remembers; beyond, it forgets them all.
REMEMBERED = 250_000
#: Characters of text whose pieces are held at once.
HELD = 1 << 20
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a tiktoken file: byte strings, and the rank of each pair of tokens whose bytes joined are a token."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        self._build(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(made, np.int32))
        self.known: dict[str, bytes] = {}

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self._keys[slots] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self._keys[slots[won]], self._ranks[slots[won]] = keys[won], ranks[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, ranks, slots = keys[left], ranks[left], (slots[left] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where there is none or a side is padding (-1)."""
        out = np.full(left.shape, _NONE, np.int32)
        at = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        keys = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slots, flat = self._slots(keys), out.ravel()
        while len(at):
            held = self._keys[slots]
            hit = held == keys
            flat[at[hit]] = self._ranks[slots[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & self._mask
        return flat.reshape(left.shape)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of at most `width` bytes."""
        lengths = np.array([len(p) for p in pieces])
        tokens = np.full((len(pieces), width), -1, np.int32)
        tokens[np.arange(width) < lengths[:, None]] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks, at, out = self.pair_ranks(tokens[:, :-1], tokens[:, 1:]), np.arange(len(pieces)), [b""] * len(pieces)
        while len(at):
            where = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(at), np.int64)
            best = ranks[np.arange(len(at)), where] if ranks.shape[1] else np.full(len(at), _NONE)
            for row in np.flatnonzero(best == _NONE).tolist():
                out[at[row]] = tokens[row][tokens[row] >= 0].astype("<u4").tobytes()
            on = best != _NONE
            at, tokens, ranks, where, best = at[on], tokens[on], ranks[on], where[on], best[on]
            if not len(at):
                break
            rows, columns = np.arange(len(at)), np.arange(tokens.shape[1] - 1)
            tokens[rows, where] = best
            tokens = np.take_along_axis(tokens, columns + (columns > where[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= where[:, None]), 1)
            for side in (where - 1, where):
                fits = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[fits, side[fits]] = self.pair_ranks(tokens[fits, side[fits]], tokens[fits, side[fits] + 1])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        tokens: list[int] = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(tokens), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: get(self.bytes_of[tokens[i]] + self.bytes_of[tokens[after[i]]]) if after[i] < n else None
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (found := rank(k)) is not None:
                    heapq.heappush(heap, (found, k, tokens[k], tokens[after[k]]))
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces to `known`: whole tokens at once, the others by merging."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONGEST:
                self.known[piece] = self._merge_long(raw)
            else:
                buckets.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, own in buckets.items():
            for k in range(0, len(own), 20_000):
                part = own[k : k + 20_000]
                self.known.update(zip((p for p, _ in part), self._merge_rows([raw for _, raw in part], width), strict=True))

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := set().union(*split).difference(self.known):
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, 4 bytes each; a long text is worked on in runs of its matches."""
        if len(text) <= HELD:
            return self._ids([self.pattern.findall(text)])[0]
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(self._ids([run])[0] for run in iter(lambda: list(itertools.islice(found, 100_000)), []))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; new pieces of about `HELD` characters of texts are merged together."""
        held, size = [], 0
        for text in texts:
            if size + len(text) > HELD:
                yield from self._ids(held)
                held, size = [], 0
            if len(text) > HELD:
                yield self.encode(text)
            else:
                held.append(self.pattern.findall(text))
                size += len(text)
        yield from self._ids(held)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of `docs`: the id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    Each match of `pattern` is encoded separately, without special tokens; then the ids are decoded again. Null
    texts count as empty and have no ids. Only the two named columns are read; every executor needs `path`.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                counts, shas, decoded, kept = [], [], [], []
                for ids in own.encode_all(x.as_py() or "" for x in part.column(1)):
                    counts.append(len(ids) // 4)
                    shas.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) -> (id, text): the texts of `encode_documents`."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            texts = [own.decode(x.as_py() or b"").decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, text string")
