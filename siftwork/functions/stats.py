"""Small-sample statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noise_variance(history: Column) -> Column:
    """Half the mean squared step of an array of counts; 0 for fewer than two."""
    steps = F.transform(F.sequence(F.lit(1), F.size(history) - 1), lambda i: F.pow(F.element_at(history, i + 1) - F.element_at(history, i), F.lit(2)))
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(history) >= 2, total / (2 * (F.size(history) - 1))).otherwise(F.lit(0.0))


def mean_of(history: Column) -> Column:
    return F.when(F.size(history) > 0, F.aggregate(history, F.lit(0.0), lambda a, x: a + x) / F.size(history)).otherwise(F.lit(0.0))


def count_z(current: Column, history: Column) -> Column:
    """Distance of a count from its history's mean, in units of the noise, the Poisson or one, whichever is largest."""
    return (current - mean_of(history)) / F.sqrt(F.greatest(noise_variance(history), mean_of(history), F.lit(1.0)))


def rate_z(observed: Column, expected: Column) -> Column:
    return (observed - expected) / F.sqrt(F.greatest(expected, F.lit(1.0)))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; 0 where a side is empty or the pooled share is 0 or 1."""
    pooled = (x1 + x2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (pooled > 0) & (pooled < 1), (x1 / n1 - x2 / n2) / error).otherwise(F.lit(0.0))


def zero_chance(n: Column, rate: Column) -> Column:
    """Chance of no hit in n draws at a rate (clipped to 0 .. 1)."""
    return F.pow(1 - F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)), n)


def shrunk_share(x: Column, n: Column, prior: Column, weight: float = 10.0) -> Column:
    return (x + weight * prior) / (n + weight)


def change_percent(count: Column, previous: Column) -> Column:
    """Change in percent, one decimal; null without a previous count."""
    return F.when(previous > 0, F.round((count - previous) * 100.0 / previous, 1))


#: Reports from which a topic is judged, sources that a new or surging one needs, and the z and move of each state. Fixed values.
LEAST_COUNT, LEAST_SOURCES, SURGE_Z, SURGE_MOVE, RISE_Z, FALL_Z = 3, 2, 2.0, 1.5, 1.0, -1.0


def lifecycle(current: Column, history: Column, z: Column, sources: Column, seen_before: Column | None = None) -> Column:
    """new, surging, rising, falling or steady, from a count, its earlier counts, its z and its sources; null if too quiet to say.

    `seen_before` tells of earlier counts that aren't in the history, as of windows that are compared up to the same hour.
    """
    mean, enough, several = mean_of(history), current >= LEAST_COUNT, sources >= LEAST_SOURCES
    fresh = mean == 0 if seen_before is None else ~seen_before
    return (
        F.when(enough & fresh & several, "new")
        .when(enough & fresh, "steady")
        .when(enough & (z >= SURGE_Z) & (current >= mean * SURGE_MOVE) & several, "surging")
        .when(enough & (z >= RISE_Z), "rising")
        .when((mean >= LEAST_COUNT) & (z <= FALL_Z), "falling")
        .when(enough, "steady")
    )
