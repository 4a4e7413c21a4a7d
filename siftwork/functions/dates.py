"""Times that sources state, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds, not seconds, from here on. Fixed value.
EPOCH_MS = 100_000_000_000
#: Spellings of times besides ISO 8601 that are tried in turn. Fixed values.
FORMATS = ("dd MMM yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")


def plausible(told: Column, seen: Column, shift_minutes: Column) -> Column:
    """`told` if it can be an article's time; less the source's offset if it is its wall clock read as UTC; else null.

    Nothing before 1990 or later than a quarter of an hour after it was seen; a bare day (midnight at the source or in UTC) may be a day ahead.
    """
    minutes = lambda n: F.make_dt_interval(mins=n)
    latest, local = seen + F.expr("INTERVAL 15 MINUTES"), told + minutes(shift_minutes)
    back = told - minutes(shift_minutes)
    midnight = lambda t: t == F.date_trunc("day", t).cast("timestamp_ntz")
    bare_day = (midnight(local) | midnight(told)) & (told <= seen + F.expr("INTERVAL 1 DAY"))
    return F.when(told < F.lit("1990-01-01").cast("timestamp_ntz"), None).when((told <= latest) | bare_day, told).when((shift_minutes > 0) & (back <= latest), back)


def parsed(told: Column) -> Column:
    """A time from ISO 8601, one of FORMATS, or seconds or milliseconds since 1970; null if none fits."""
    number = F.when(told.rlike(r"^\d{9,14}$"), F.expr("0L") + told.try_cast("long"))
    epoch = F.timestamp_millis(F.when(number > EPOCH_MS, number).otherwise(number * 1000)).cast("timestamp_ntz")
    return F.coalesce(epoch, F.when(told.rlike(r"^\d{4}-\d{2}-\d{2}"), told.try_cast("timestamp_ntz")), *[F.try_to_timestamp(told, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])
