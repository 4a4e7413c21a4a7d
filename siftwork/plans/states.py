"""The query of siftwork.streaming.states; what a source has come to depends on each event before, so there is no DuckDB twin: tests hold it against a loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.plans.registry import query
from siftwork.sources.adapters import items
from siftwork.streaming import states


@query("source_states")
def _(spark, d):
    """Events as what happens to sources: checks of the next stages, fetches that succeed or fail, now and then a pause, a resumption or a reset."""
    k = F.col("k")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    kind = F.when(k % 40 == 7, "pause").when(k % 40 == 8, "resume").when(k % 97 == 5, "reset").when(k % 3 == 0, "check").when(k % 3 == 1, "success").otherwise("failure")
    rows = items(spark, d).select(
        (F.col("source") % 50).alias("source"), F.col("occurred_at").cast("timestamp").alias("at"), F.col("item_id").alias("seq"), kind.alias("kind"), pick(states.STAGES[1:5], k).alias("stage"),
        (k % 5 != 0).alias("passed"), pick(("timeout", "parse", "blocked_mime", "config_error"), k).alias("code"), (k % 4 < 2).alias("retryable"),
    )
    return states.latest(states.histories(rows)).withColumn("next_due", F.date_format("next_due", "yyyy-MM-dd HH:mm:ss")).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
