"""Text quality without labels: a weak-label model of heuristic labellers, whose posteriors train a hashed linear scorer.

Each labeller votes good, bad or nothing on a whole text. Expectation-maximisation over how often each pattern of votes
occurs in all documents estimates every labeller's accuracy; the posterior of a text's votes is its soft label. A
linear scorer over hashed byte trigrams and measure bins is then fitted to soft labels of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.textvec import chunks, mix, words

#: Hashed features, rows of the bounded sample that the scorer is fitted to, words in a block whose variety is measured.
BUCKETS, SAMPLE, BLOCK = 1 << 13, 3000, 200
_LETTER, _UPPER, _DIGIT, _SYMBOL, _STOP, _LINE = (np.zeros(256, np.int64) for _ in range(6))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "*#$%&!|<>{}[]=+~^_\\@"]] = 1
_STOP[[ord(c) for c in ".,;:?"]] = 1
_LINE[10] = 1

#: Measures, and for each labeller: measure, good from, good to, bad below, bad above. Fixed thresholds.
MEASURES = ("words", "symbols", "upper", "digits", "stops", "length", "repeats", "variety")
LABELLERS = (
    ("words", 40, 1e9, 8, 1e18),
    ("symbols", 0, 0.01, -1, 0.03),
    ("upper", 0, 0.12, -1, 0.35),
    ("digits", 0, 0.05, -1, 0.25),
    ("stops", 0.06, 0.3, 0.02, 0.6),
    ("length", 3.5, 6.3, 2.2, 9.0),
    ("repeats", 0, 0.04, -1, 0.12),
    ("variety", 0.6, 2, 0.4, 9),
)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, MEASURES) of texts that lie end to end in `data`; texts without words measure 0 throughout."""
    n = len(offsets) - 1
    total = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    hashes, starts, rows = words(data, offsets)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    block = (np.arange(len(hashes)) - first[rows]) // BLOCK
    keys = mix(hashes ^ mix((rows * 1_000_003 + block).astype(np.uint64)))
    _, one = np.unique(keys, return_index=True)
    letters, size = total(_LETTER), np.maximum(np.diff(offsets), 1)
    safe = np.maximum(count, 1)
    inside = total((_LETTER + _DIGIT).astype(np.int64))
    made = [count, total(_SYMBOL) / size, total(_UPPER) / np.maximum(letters, 1), total(_DIGIT) / size, total(_STOP) / safe, inside / safe]
    made += [np.bincount(rows, same, n) / safe, np.bincount(rows[one], minlength=n) / safe]
    return np.where(count[:, None] > 0, np.stack(made, 1), 0.0)


def votes(measured: np.ndarray) -> np.ndarray:
    """(rows, LABELLERS): 2 good, 0 bad, 1 nothing."""
    out = np.ones((len(measured), len(LABELLERS)), np.int64)
    for j, (name, low, high, below, above) in enumerate(LABELLERS):
        x = measured[:, MEASURES.index(name)]
        out[(x >= low) & (x <= high), j] = 2
        out[(x < below) | (x > above), j] = 0
    return out


def _code(own: np.ndarray) -> np.ndarray:
    return own @ (3 ** np.arange(len(LABELLERS)))


def features(data: np.ndarray, offsets: np.ndarray, measured: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text (buckets, values): shares of hashed trigrams, and one hashed bin of each measure."""
    value = data.astype(np.uint64)
    grams = value[:-2] | value[1:-1] << np.uint64(8) | value[2:] << np.uint64(16) if len(data) > 2 else np.zeros(0, np.uint64)
    place = (mix(grams + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    bins = np.floor(np.log2(measured * 1000 + 1)).astype(np.uint64) + (np.arange(len(MEASURES), dtype=np.uint64) + np.uint64(1)) * np.uint64(1 << 32)
    bins = (mix(bins) % np.uint64(BUCKETS)).astype(np.int64)
    for i in range(len(offsets) - 1):
        own = place[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        held = np.bincount(own, minlength=BUCKETS).astype(np.float64) / max(1, len(own)) * 10
        np.add.at(held, bins[i], 0.3)
        at = np.flatnonzero(held)
        yield at, held[at]


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Expectation-maximisation over vote patterns -> the posterior that a text is good, for every possible pattern.

    Labellers are independent given the truth; a good text is what most labellers' good votes agree on at the start.
    """
    k = len(LABELLERS)
    every = (np.arange(3**k)[:, None] // 3 ** np.arange(k)) % 3
    seen = every[codes]
    good = np.clip(0.5 + (seen - 1).sum(1) / (2 * k), 0.02, 0.98)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good], 1)
        share = (weight.sum(0) + 1) / (weight.sum() + 2)
        table = np.stack([np.stack([weight[seen[:, j] == v].sum(0) for v in range(3)]) + 0.5 for j in range(k)])  # labeller, vote, truth
        table /= table.sum(1, keepdims=True)
        odds = np.log(share[1] / share[0]) + sum(np.log(table[j, every[:, j], 1] / table[j, every[:, j], 0]) for j in range(k))
        all_good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        good = all_good[codes]
    return all_good


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of sparse rows, fitted to soft labels by full-batch Adam."""
    weight, bias = np.zeros(BUCKETS), float(np.log((soft.sum() + 1) / (len(soft) - soft.sum() + 1)))
    if not len(rows):
        return weight, bias
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        logit = np.bincount(owner, weight[at] * value, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - soft) / len(rows)
        grad = np.append(np.bincount(at, error[owner] * value, BUCKETS) + 1e-5 * weight, error.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        step = rate * 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, bias


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row for each row of `docs`: the id, votes (a digit for each labeller: 2 good, 0 bad), posterior, score, kept.

    posterior is the weak-label model's, score the linear scorer's, both the chance of a good text; kept is
    score >= cut. Null and empty texts have no words and measure 0. Vote patterns (3 ** 8 at most) are counted over all
    rows; the scorer is fitted to the texts of the SAMPLE ids first by a hash, the least text of each. Equal texts score alike.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col)

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                found, n = np.unique(_code(votes(measures(data, offsets))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["code", "n"])

    counted = docs.select(text_col).mapInArrow(pattern, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    posterior = estimate(np.array([r["code"] for r in counted], np.int64), np.array([r["n"] for r in counted], float))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                measured = measures(data, offsets)
                made = list(features(data, offsets, measured))
                columns = [pa.array(_code(votes(measured))), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["code", "at", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = [(np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(value, np.float32).astype(float)) for _, at, value in sample]
        weight, bias = fit_scorer(made, posterior[[code for code, _, _ in sample]] if sample else np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = texts.select(F.col("id").alias("own")).where("own IS NOT NULL").distinct().orderBy(F.xxhash64("own"), "own").limit(SAMPLE)
    sample = texts.join(F.broadcast(picked), F.col("id") == F.col("own")).groupBy("own").agg(F.min("text").alias("text"))  # SAMPLE rows
    # One task fits the bounded sample; the driver gets the weights alone.
    fitted = sample.select("text").mapInArrow(sparse, "code long, at binary, value binary").repartition(1).mapInArrow(fit, "weight binary, bias double").first()
    weight, bias = (np.frombuffer(fitted["weight"], float), fitted["bias"]) if fitted else fit_scorer([], np.zeros(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                measured = measures(data, offsets)
                own = votes(measured)
                logit = np.array([weight[a] @ v for a, v in features(data, offsets, measured)]) + bias
                chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                columns = [batch.column(0).slice(first, len(own)), pa.array(["".join(map(str, v)) for v in own.tolist()]), pa.array(posterior[_code(own)]), pa.array(chance), pa.array(chance >= cut)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "votes", "posterior", "score", "kept"])

    return rows.mapInArrow(score, f"`{id_col}` {id_type}, votes string, posterior double, score double, kept boolean")
