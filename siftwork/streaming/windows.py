"""Event-time streams of items: windowed counts under a watermark, and an append-only ledger by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an item may come: the longest gap between two reports of one event.
LATENESS = "2 days"


def windowed_kpis(stream: DataFrame, length: str = "1 day", at: str = "occurred_at") -> DataFrame:
    """Items and summed value in each tumbling window and track; items later than LATENESS are dropped."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, LATENESS)
    found = timed.groupBy(F.window(at, length).alias("w"), "track").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("value"), 4).alias("value"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "track", "items", "value")


def first_seen(stream: DataFrame, key: str, at: str = "occurred_at") -> DataFrame:
    """The first row of each key within LATENESS: state is dropped behind the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, LATENESS).dropDuplicatesWithinWatermark([key])


def ledger_writer(path: str, key: str, content: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows of a batch whose content differs from the latest that the ledger has of the key.

    A key that goes back to an earlier content is appended again. Of several rows of a key in a batch the one with the least
    content counts. A batch that is run again after a failure finds its own rows and adds none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(key).agg(F.min(content).alias(content)).select(key, content, F.lit(batch_id).cast("long").alias("batch"))
        try:
            known = spark.read.parquet(path).where(F.col("batch") <= batch_id).groupBy(key).agg(F.max_by(content, "batch").alias(content))
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            fresh = fresh.join(known, [key, content], "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
