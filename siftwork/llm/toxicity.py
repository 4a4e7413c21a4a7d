"""Toxicity: subword-bag embeddings, averaged over a few words, into a linear softmax; trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with its edges) and itself, hashed into one embedding table, so that
a misspelling shares most of its vectors with the word. A text is judged by its worst run of `RUN` words: the mean of
their bags goes through the softmax. Training knows only whether a text is toxic, so it alternates between picking
each text's worst run and fitting the table and the softmax together to the picked runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.textvec import LOWER, mix, words

BUCKETS, WIDTH, RUN = 1 << 15, 16, 3
GRAMS = (3, 4, 5)
#: Labelled rows of each class that are trained on at most: a bounded sample, in the order of a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def featurised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, hash of each word, word of each feature, bucket of each feature)."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate([[1], 1 + np.cumsum(lengths)])
    hashes, starts, rows = words(data, offsets)
    low = LOWER[data]
    inside = low > 0
    first = np.zeros(len(data) + 1, np.int32)
    first[starts + 1] = 1
    word_at = np.cumsum(first)[1:] - 1  # the word that a byte inside words is in
    value = _BYTE[low]
    owners, buckets = [np.arange(len(hashes))], [(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    held = np.concatenate([[0], np.cumsum(inside)])
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        middle = held[n - 1 : n - 1 + count] - held[1 : 1 + count]
        at = np.flatnonzero(middle == n - 2)
        gram = np.full(len(at), n, np.uint64)
        for j in range(n):
            gram += value[at + j] * _PLACE[j]
        owners.append(word_at[at + 1])
        buckets.append((mix(gram) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return rows, hashes, np.concatenate(owners), np.concatenate(buckets)


def _slices(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(first, texts) of about `most` bytes at a time, so that the arrays of features stay small."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= most:
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _vocabulary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, number of each word, buckets of the distinct words' features, how many each of those has)."""
    rows, held, names, features, sizes = [], [], np.zeros(0, np.uint64), [], []
    for at, part in _slices(texts):
        own_rows, hashes, owner, bucket = featurised(part)
        rows.append((own_rows + at).astype(np.int32))
        held.append(hashes)
        found, first = np.unique(hashes, return_index=True)
        first = first[~np.isin(found, names)]
        names = np.concatenate([names, hashes[first]])
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        lo, size = np.searchsorted(owner, first), np.searchsorted(owner, first, "right") - np.searchsorted(owner, first)
        features.append(bucket[order][np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(np.int32))
        sizes.append(size)
    order = np.argsort(names)
    numbers = [order[np.searchsorted(names, h, sorter=order)].astype(np.int32) for h in held]
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(features), np.concatenate(sizes)


def _run_means(scores: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, first word, row) of each run of RUN words in a row; a shorter row is one run."""
    counts = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(counts)])
    runs = np.where(counts > 0, np.maximum(counts - RUN + 1, 1), 0)
    owner = np.repeat(np.arange(n_rows), runs)
    start = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + begin[:-1][owner]
    size = np.minimum(counts[owner], RUN)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[start + size] - total[start]) / size, start, owner


class Model:
    """The trained table and softmax, folded into one weight for each bucket, and the calibration of a text's worst run."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weight, self.bias, self.slope, self.offset = weight.astype(np.float32), bias, slope, offset

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The highest logit among each text's runs; minus infinity for a text without words."""
        out = np.full(len(texts), -np.inf)
        for at, part in _slices(texts):
            rows, hashes, owner, bucket = featurised(part)
            if len(hashes):
                scores = np.bincount(owner, self.weight[bucket], len(hashes)) / np.bincount(owner, minlength=len(hashes))
                means, _, own = _run_means(scores, rows, len(part))
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[at + own[heads]] = np.maximum.reduceat(means, heads) + self.bias
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        worst = self.worst(texts)
        odds = self.slope * np.where(np.isfinite(worst), worst, 0) + self.offset
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.0)


def _warm_scores(inverse: np.ndarray, rows: np.ndarray, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """A first score of each distinct word: smoothed log-odds of the shares of toxic and clean texts that hold it."""
    pairs = np.unique(inverse.astype(np.int64) * len(toxic) + rows)
    word, text = pairs // len(toxic), pairs % len(toxic)
    yes = np.bincount(word[toxic[text] == 1], minlength=n_words)
    no = np.bincount(word[toxic[text] == 0], minlength=n_words)
    return np.log((yes + 0.5) / (max(1, toxic.sum()) + 1)) - np.log((no + 1.0) / (max(1, (1 - toxic).sum()) + 2))


def fit(texts: list[bytes], labels: list[int], rounds: int = 4, steps: int = 40, rate: float = 0.05) -> Model:
    """Fits table and softmax on four fifths of the texts, and the calibration on the rest. Deterministic."""
    toxic = np.array(labels, np.int64)
    if len(toxic) < 20 or toxic.min() == toxic.max():
        share = (toxic.sum() + 1) / (len(toxic) + 20)
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    rows, inverse, features, sizes = _vocabulary(texts)
    pointer = np.concatenate([[0], np.cumsum(sizes)])
    own = np.arange(len(toxic)) % 5 != 0
    rng = np.random.default_rng(5)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    score, tick = _warm_scores(inverse, rows, np.where(own, toxic, 2), len(sizes)), 0
    for _ in range(rounds):
        means, start, at = _run_means(score[inverse], rows, len(toxic))
        best = np.lexsort((-means, at))
        worst = best[np.append(True, at[best][1:] != at[best][:-1])]
        more = rng.choice(len(means), min(len(means), 2 * len(worst)), False)  # runs of clean texts at random
        picked = np.concatenate([worst, more[toxic[at[more]] == 0]])
        picked = picked[own[at[picked]]]
        target = toxic[at[picked]]
        size = np.minimum(np.bincount(rows, minlength=len(toxic))[at[picked]], RUN)
        flat = np.repeat(start[picked] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        used, place = np.unique(inverse[flat], return_inverse=True)
        run_of = np.repeat(np.arange(len(picked)), size)
        feat_size = sizes[used]
        feats = features[np.repeat(pointer[used] - np.concatenate([[0], np.cumsum(feat_size)[:-1]]), feat_size) + np.arange(feat_size.sum())]
        word_starts = np.concatenate([[0], np.cumsum(feat_size)[:-1]])
        by_bucket = np.argsort(feats, kind="stable")
        touched, bucket_starts = np.unique(feats[by_bucket], return_index=True)
        word_of = np.repeat(np.arange(len(used)), feat_size)[by_bucket]
        by_word = np.argsort(place, kind="stable")
        place_starts = np.searchsorted(place[by_word], np.arange(len(used)))
        run_starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        for _ in range(steps):
            tick += 1
            vectors = np.add.reduceat(table[feats], word_starts, 0) / feat_size[:, None]
            bags = np.add.reduceat(vectors[place], run_starts, 0) / size[:, None]
            logits = bags @ soft + bias
            logits -= logits.max(1, keepdims=True)
            odds = np.exp(logits)
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(target)), target] -= 1
            odds /= len(target)
            to_bags = (odds @ soft.T) / size[:, None]
            to_words = np.add.reduceat(to_bags[run_of][by_word], place_starts, 0) / feat_size[:, None]
            to_table = np.zeros_like(table)
            to_table[touched] = np.add.reduceat(to_words[word_of], bucket_starts, 0)
            for value, grad, (mean, square) in zip((table, soft, bias), (to_table + 1e-6 * table, bags.T @ odds + 1e-4 * soft, odds.sum(0)), moments, strict=True):
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                value -= rate * (mean / (1 - 0.9**tick)) / (np.sqrt(square / (1 - 0.99**tick)) + 1e-8)
        folded = table @ (soft[:, 1] - soft[:, 0])
        score = np.add.reduceat(folded[features], pointer[:-1]) / sizes
    model = Model(folded, float(bias[1] - bias[0]), 1.0, 0.0)
    model.slope, model.offset = _calibrate(model.worst([t for t, o in zip(texts, own, strict=True) if not o]), toxic[~own])
    return model


def _calibrate(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and offset of a logistic curve through held-back texts, by damped Newton steps."""
    logit, label = logit[np.isfinite(logit)], label[np.isfinite(logit)]
    if not len(logit):
        return 1.0, 0.0
    centre, spread = logit.mean(), logit.std() + 1e-6
    x = np.stack([(logit - centre) / spread, np.ones(len(logit))], 1)
    w = np.array([1.0, np.log((label.sum() + 1) / (len(label) - label.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - label) + 0.05 * (w - np.array([1.0, 0.0])))
    slope = max(w[0], 0.05) / spread
    return float(slope), float(w[1] - slope * centre)


def held_out(id_col: str):  # noqa: ANN201
    """True for rows that no label may be learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of a bounded sample of the labelled rows that aren't held out (see SAMPLE_TOXIC, SAMPLE_CLEAN).

    An id with several labels counts as toxic if one says so; of several texts of an id the least is learnt from. Null ids,
    and null labels, teach nothing. With fewer than 20 rows, or one class only, every text with words has the same score.
    """
    rows = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("own")).agg(F.max(label_col).cast("int").alias("y")).where("y IS NOT NULL")
    picked = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = rows.where(F.col("y") == value).orderBy(F.xxhash64("own"), "own").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(picked), F.col("id") == F.col("own")).groupBy("own", "y").agg(F.min("t").alias("t"))  # SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
        own = fit([t.encode() for _, _, t in rows], [y for _, y, _ in rows])
        numbers = [pa.array([x], pa.float64()) for x in (own.bias, own.slope, own.offset)]
        yield pa.RecordBatch.from_arrays([pa.array([own.weight.tobytes()], pa.binary()), *numbers], ["weight", "bias", "slope", "offset"])

    # One task: the sample is bounded, and the driver gets the folded table only.
    row = found.select("own", "y", "t").repartition(1).mapInArrow(run, "weight binary, bias double, slope double, offset double").first()
    if row is None:
        return fit([], [])
    return Model(np.frombuffer(row["weight"], np.float32), row["bias"], row["slope"], row["offset"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row for each row of `docs`: the id, held_out, score (0 to 1), predicted (1 if score >= cut). Whole texts.

    Null and empty texts, and others without words, score 0. Only the text enters a score.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts, scores, size = [], [], 0
            for x in batch.column(2):
                text = (x.as_py() or "").encode()
                texts.append(text)
                size += len(text)
                if size > 1 << 19:
                    scores.append(own.score(texts))
                    texts, size = [], 0
            scores.append(own.score(texts) if texts else np.zeros(0))
            score = np.concatenate(scores)
            columns = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "score", "predicted"])

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_col)
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of `docs` that score below `cut`, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                score = own.score([(x.as_py() or "").encode() for x in part.column(place)])
                yield part.filter(pa.array(score < cut))

    return docs.mapInArrow(run, docs.schema)
