"""Personal data: exact pattern matches, and a skip-chain conditional random field that finds their variants.

Nodes of the field are number-like and address-like runs of a text. Neighbours share a chain potential; runs with
the same letters and digits, or the same last seven digits, share a skip potential however far apart they are, each
through one hub variable for each such key, so that n repeats cost n edges. Matches of the patterns are observed;
loopy message passing gives the other nodes' labels. The potentials are smoothed counts over all documents
(piecewise training): label by shape of the run, label pairs of neighbours, label pairs of equal keys. Three of
them are then set by hand: a floor of the odds of unmatched runs, extra counts for equal keys, half the weight of the chain.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Buckets of run shapes: the size of the learnt table, whatever the input.
SHAPES = 2048
ROUNDS = 6
_OTHER = len(KINDS)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,3}[0-9])*+")
_AT = re.compile(r"@\S++|\((?:at|AT)\)\S++|\[(?:at|AT)\]\S++")
_DIGIT_OR_AT = re.compile(r"[0-9@]|\([aA][tT]\)|\[[aA][tT]\]")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; a failing match is dropped and its characters are not tried again."""
    if not _DIGIT_OR_AT.search(text):
        return []
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Field:
    """The nodes of one text: where they are, their shape bucket, observed label (-1: none), and skip keys."""

    def __init__(self, text: str, base: list[Span]) -> None:
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text) if m.end() - m.start() >= 4]
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and not text[start - 1].isspace():
                start -= 1
            end = m.end()
            while end > start and text[end - 1] in ".,;:!?)]}\"'":
                end -= 1
            if end > start:
                runs.append((start, end))
            last = m.end()
        nodes: list[tuple[int, int, int]] = [(s, e, k) for s, k, e in base]
        taken = sorted((s, e) for s, k, e in base)
        upto, i = 0, 0
        for s, e in sorted(runs):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if s < upto or i < len(taken) and taken[i][0] < e:
                continue
            nodes.append((s, e, -1))
            upto = e
        nodes.sort()
        self.start = [n[0] for n in nodes]
        self.end = [n[1] for n in nodes]
        self.seen = np.array([n[2] for n in nodes], np.int64)
        self.shape = np.zeros(len(nodes), np.int64)
        self.keys: list[list[str]] = []
        for j, (s, e, _) in enumerate(nodes):
            own = text[s:e].lower()
            plain = "".join(c for c in own.replace("(at)", "@").replace("[at]", "@") if c.isalnum() or c == "@")
            digits = "".join(c for c in plain if "0" <= c <= "9")
            self.keys.append([k for k in (("=" + plain if len(plain) >= 5 else ""), "#" + digits[-7:] if len(digits) >= 7 else "") if k])
            signs = "".join(sorted(set(own) & set("+().-@ _%")))
            failed = 12 <= len(digits) <= 19 and "." not in own and not _luhn(digits) or own.count(".") == 3 and any(int(x[:9] or 0) > 255 for x in re.sub("[^0-9.]", "", own).split("."))
            mask = f"{failed}|{min(len(digits), 20)}|{signs}|{own.count('.') if own.count('.') < 5 else 5}|{any(c.isalpha() for c in own)}|{own[0] in '+('}"
            self.shape[j] = zlib.crc32(mask.encode()) % (SHAPES // 2) + SHAPES // 2 * failed
        self.near = [j for j in range(len(nodes) - 1) if self.start[j + 1] - self.end[j] <= 40]


def _counts(text: str) -> Counter:
    """What a text adds to the tables: ("u", shape, label), ("c", label, next label), ("s", label, label of the same key)."""
    base = base_spans(text)
    out: Counter = Counter()
    if not base and not _DIGIT_OR_AT.search(text):
        return out
    field = Field(text, base)
    label = np.where(field.seen < 0, _OTHER, field.seen)
    for shape, own in zip(field.shape.tolist(), label.tolist(), strict=True):
        out["u", shape, own] += 1
    for j in field.near:
        out["c", int(label[j]), int(label[j + 1])] += 1
    last: dict[str, int] = {}
    for j, keys in enumerate(field.keys):
        for key in keys:
            if key in last:
                out["s", *sorted((int(label[j]), int(label[last[key]])))] += 1
            last[key] = j
    return out


def train(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """The log-potential tables, from counts over all texts; (SHAPES + 10) * 5 rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                total.update(_counts(x.as_py()))
        rows = [(t, a, b, n) for (t, a, b), n in total.items()]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["t", "a", "b", "n"])

    texts = docs.select(text_col).where(F.col(text_col).rlike("[0-9@]|\\([aA][tT]\\)|\\[[aA][tT]\\]"))
    table = texts.mapInArrow(run, "t string, a long, b long, n long").groupBy("t", "a", "b").agg(F.sum("n").alias("n"))
    counts = {"u": np.zeros((SHAPES, 5)), "c": np.zeros((5, 5)), "s": np.zeros((5, 5))}
    for t, a, b, n in table.collect():
        counts[t][a, b] += n
    prior = np.ones(5)
    prior[_OTHER] = 20.0
    unary = counts["u"] + prior / prior.sum() * 2
    unary /= unary.sum(1, keepdims=True)
    # A run that no pattern matches isn't proof of no entity, unless it has failed a check (the upper half of the shapes).
    unary[: SHAPES // 2] = np.maximum(unary[: SHAPES // 2], 0.05)
    unary[SHAPES // 2 :] = np.maximum(unary[SHAPES // 2 :], 1e-4)
    chain = counts["c"] + 0.5
    # A neighbour's label beyond what its frequency says: joint over product of the margins, damped.
    chain = 0.5 * np.log(chain * chain.sum() / (chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True)))
    skip = counts["s"] + counts["s"].T + 0.1 + 20 * np.eye(5)
    skip[_OTHER, :_OTHER] = skip[:_OTHER, _OTHER] = np.minimum(skip[_OTHER, :_OTHER], 0.02 * np.diag(skip)[:_OTHER])
    return {"unary": np.log(unary / unary.sum(1, keepdims=True)), "chain": chain, "skip": np.log(skip / skip.sum(1, keepdims=True))}


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def infer(field: Field, tables: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node after `rounds` rounds of loopy message passing."""
    n = len(field.seen)
    unary = tables["unary"][field.shape].copy()
    seen = np.flatnonzero(field.seen >= 0)
    unary[seen] = -30.0
    unary[seen, field.seen[seen]] = 0.0
    left = np.array(field.near, np.int64)
    hubs: dict[str, int] = {}
    pairs = [(j, hubs.setdefault(k, len(hubs))) for j, keys in enumerate(field.keys) for k in keys]
    member = np.array([p[0] for p in pairs], np.int64)
    hub = np.array([p[1] for p in pairs], np.int64)
    right_in, left_in, skip_in = np.zeros((n, 5)), np.zeros((n, 5)), np.zeros((len(pairs), 5))
    for _ in range(rounds):
        belief = unary + right_in + left_in
        np.add.at(belief, member, skip_in)
        forth, back = np.zeros((n, 5)), np.zeros((n, 5))
        if len(left):
            forth[left + 1] = _logsum((belief[left] - left_in[left])[:, :, None] + tables["chain"][None], 1)
            back[left] = _logsum((belief[left + 1] - right_in[left + 1])[:, None, :] + tables["chain"][None], 2)
        if len(pairs):
            up = _logsum((belief[member] - skip_in)[:, :, None] + tables["skip"][None], 1)
            up -= up.max(1, keepdims=True)
            held = np.zeros((len(hubs), 5))
            np.add.at(held, hub, up)
            skip_in = _logsum((held[hub] - up)[:, None, :] + tables["skip"][None], 2)
            skip_in -= skip_in.max(1, keepdims=True)
        right_in = forth - forth.max(1, keepdims=True)
        left_in = back - back.max(1, keepdims=True)
    belief = unary + right_in + left_in
    np.add.at(belief, member, skip_in)
    return np.exp(belief - _logsum(belief, 1)[:, None])


def find_spans(text: str, tables: dict[str, np.ndarray]) -> tuple[list[Span], list[Span]]:
    """(pattern matches, spans that the field adds); an added span overlaps no pattern match."""
    base = base_spans(text)
    if not base and not _DIGIT_OR_AT.search(text):
        return base, []
    field = Field(text, base)
    if not (field.seen < 0).any():
        return base, []
    odds = infer(field, tables)
    odds[field.seen >= 0] = 0
    label = odds.argmax(1)
    found = np.flatnonzero((label != _OTHER) & (odds.max(1) > 0.5))
    return base, [(field.start[j], int(label[j]), field.end[j]) for j in found.tolist()]


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the pattern matches; `spans` also has those that the field adds. Positions are
    code points, ends exclusive. Null and empty texts have none. Repeated rows are judged alike; an empty table
    trains on nothing and gives no rows. Only the two named columns are read.
    """
    tables = train(docs, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, added = [], [], [], []
            for x in batch.column(1):
                base, more = find_spans(x.as_py() or "", tables)
                counts.append([sum(k == own for _, own, _ in base) for k in range(4)])
                digests.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(base + more))
                added.append(len(more))
            by_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            columns = [batch.column(0), *by_kind, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"`{id_col}` {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
