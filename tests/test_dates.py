"""Times that articles may have, by the cases of the survey's fixtures."""

import datetime as dt

from pyspark.sql import functions as F
from siftwork.functions import dates

SEEN = dt.datetime(2026, 10, 26, 23, 30)
#: (told, minutes that the source is ahead of UTC) -> what is kept.
CASES = [
    (SEEN + dt.timedelta(minutes=5), 0, SEEN + dt.timedelta(minutes=5)),
    (dt.datetime(1970, 1, 1), 0, None),
    (dt.datetime(2026, 10, 27, 8, 9, 31), 540, dt.datetime(2026, 10, 26, 23, 9, 31)),
    (SEEN + dt.timedelta(days=3), 540, None),
    (SEEN + dt.timedelta(hours=2), 0, None),
    (dt.datetime(2026, 10, 27), 0, dt.datetime(2026, 10, 27)),
    (dt.datetime(2026, 10, 27), 540, dt.datetime(2026, 10, 27)),
    (dt.datetime(2026, 10, 27, 15), 540, dt.datetime(2026, 10, 27, 15)),
    (dt.datetime(2026, 10, 28), 0, None),
    (None, 0, None),
]


def test_plausible_times(spark):
    rows = [(i, told, SEEN, shift) for i, (told, shift, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, told timestamp_ntz, seen timestamp_ntz, shift int")
    found = {r.i: r.at for r in df.select("i", dates.plausible(F.col("told"), F.col("seen"), F.col("shift")).alias("at")).collect()}
    assert [found[i] for i in range(len(CASES))] == [want for _, _, want in CASES]
