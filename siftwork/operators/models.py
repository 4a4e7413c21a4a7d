"""Triage of items by vectors and sources: ridge weights from a Gram matrix, source priors, calibration by Newton steps, AUC."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.ranks import quantile, ranked
from siftwork.sources.shared import small_side, spill

#: Penalty of the weights; pseudo-counts of a source's prior; its share beside the vector's score; least spread, and most spreads a term counts. Fixed values.
RIDGE, PRIOR_STRENGTH, PRIOR_WEIGHT, MIN_SPREAD, CLIP = 3.0, 5.0, 0.5, 0.05, 3.0
#: Share of the rows, by time, that the weights are fitted on; Newton steps at most, and the step that ends them. Fixed values.
TRAIN, STEPS, STILL = 0.7, 25, 1e-6


@dataclass(frozen=True)
class Triage:
    weights: np.ndarray
    linear_mean: float
    linear_std: float
    prior_mean: float
    prior_std: float
    base: float
    a: float
    b: float


def unit(v: Column) -> Column:
    """A vector of length 1, as doubles; a null vector of zeros."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (norm + 1e-9))


def gram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """rows(x array<double>, y) -> (X'X, X'y) with a constant beside x: each task adds up its rows, and the tasks' cells are summed by Spark."""
    size = rows.select(F.max(F.size("x"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 2, size + 2))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten(), float).reshape(batch.num_rows, size)
                full = np.hstack([x, np.ones((len(x), 1)), np.array(batch.column(1), float)[:, None]])
                total += full.T @ full
        i, j = np.triu_indices(size + 2)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    cells = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size + 2, size + 2))
    for i, j, v in cells.collect():  # (size + 2)^2 / 2 rows, whatever the input
        out[i, j] = out[j, i] = v
    return out[:-1, :-1], out[:-1, -1]


def ridge(rows: DataFrame, penalty: float = RIDGE) -> np.ndarray:
    """Weights of x and of a constant that fit 2y - 1 best, less `penalty` times their squares."""
    a, b = gram(rows.select("x", (2 * F.col("y") - 1).alias("y")))
    return np.linalg.solve(a + penalty * np.eye(len(a)), b)


def platt(scored: DataFrame) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(-(a s + b))) for scored(s, y): each Newton step is one aggregate of five sums."""
    a, b = 1.0, 0.0
    for _ in range(STEPS):
        p = 1 / (1 + F.exp(-(a * F.col("s") + b)))
        w, g = p * (1 - p), p - F.col("y")
        sums = scored.agg(F.sum(g * F.col("s")), F.sum(g), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w)).first()
        gs, g0, hss, hs, h0 = (x or 0.0 for x in sums)
        step = np.linalg.solve(np.array([[hss, hs], [hs, h0]]) + 1e-6 * np.eye(2), np.array([gs, g0]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < STILL:
            break
    return float(a), float(b)


def ordinal_auc(scored: DataFrame, tie: str = "id") -> float:
    """The area under the ROC curve of scored(s, y, id) from the ordinal ranks of the positives, equal scores by id; 0.5 if a class is missing."""
    placed = ranked(scored.select("s", "y", tie), ["s", tie], "place")
    n1, n0, total = placed.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1), F.sum(F.when(F.col("y") == 1, F.col("place")))).first()
    return float((total - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else 0.5


def _dot(x: Column, weights: np.ndarray) -> Column:
    held = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    return F.aggregate(F.zip_with(x, held, lambda a, b: a * b), F.lit(float(weights[-1])), lambda s, v: s + v)


def priors(rows: DataFrame) -> tuple[DataFrame, float]:
    """((source, prior), base): the share of wanted rows of each source, drawn towards that of all; 0.6 if there are none."""
    n, wanted = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    base = float(wanted) / n if n else 0.6
    own = rows.groupBy("source").agg(((F.sum("y") + PRIOR_STRENGTH * base) / (F.count(F.lit(1)) + PRIOR_STRENGTH)).alias("prior"))
    return own, base


def train(rows: DataFrame) -> tuple[Triage, DataFrame]:
    """rows(id, x, y, source, at) -> the model, and the scored rows (id, s, y, held_out): the oldest TRAIN fit the weights, the others the calibration.

    x holds as many numbers in each row; rows with a null in x, y or at take no part. Spreads are those of the rows that fit.
    """
    held = rows.where("x IS NOT NULL AND y IS NOT NULL AND at IS NOT NULL AND NOT exists(x, v -> v IS NULL)").select("id", unit(F.col("x")).alias("x"), F.col("y").cast("double").alias("y"), "source", F.col("at").cast("double").alias("at"))
    held = spill(held, "triage")
    cut = quantile(held.select(F.col("at").alias("x")), TRAIN)
    if cut is None:
        raise ValueError("no rows to fit on")
    held = held.withColumn("held_out", F.col("at") >= cut)
    weights = ridge(held.where("NOT held_out"))
    sources, base = priors(held)
    scored = held.select("id", "y", "source", "held_out", _dot(F.col("x"), weights).alias("linear")).join(small_side(sources), "source", "left").fillna(base, ["prior"])
    scored = spill(scored, "triage")
    fit = scored.where("NOT held_out").agg(F.avg("linear"), F.stddev_pop("linear"), F.avg("prior"), F.stddev_pop("prior")).first()
    mean, std, prior_mean, prior_std = (x or 0.0 for x in fit)
    model = Triage(weights, mean, max(std, MIN_SPREAD), prior_mean, max(prior_std, MIN_SPREAD), base, 1.0, 0.0)
    scored = spill(scored.select("id", "y", "held_out", combined(F.col("linear"), F.col("prior"), model).alias("s")), "triage")
    a, b = platt(scored.where("held_out"))
    return Triage(weights, mean, model.linear_std, prior_mean, model.prior_std, base, a, b), scored


def combined(linear: Column, prior: Column, model: Triage) -> Column:
    clip = lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x))
    return clip((linear - model.linear_mean) / model.linear_std) + PRIOR_WEIGHT * clip((prior - model.prior_mean) / model.prior_std)


def probability(score: Column, model: Triage) -> Column:
    return 1 / (1 + F.exp(-(model.a * score + model.b)))
