"""The content model over the driver tables: items, snapshots, deals and taxonomy nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The four tracks, from research to the news. Fixed values.
TRACKS = ("research_ip", "oss", "community", "news")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row for each item: events as reports of sources, with field, theme, story and keywords from their payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("item_id"),
        F.col("ts").cast("timestamp_ntz").alias("occurred_at"),
        F.col("user_id").cast("long").alias("source"),
        F.col("event_type").alias("track"),
        "value",
        k.alias("k"),
        (k % 5).alias("field"),
        (k % 20).alias("theme"),
        (F.col("user_id") * 100 + k).cast("long").alias("story"),
        F.array_distinct(F.array(k % 10, k % 7 + 10, k % 13 + 20)).alias("keywords"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deals: actor and its nation, day, kind, amount."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
        .join(F.broadcast(nations), customers["c_nationkey"] == nations["n_nationkey"])  # 25 rows at every scale
        .select(
            F.col("o_orderkey").alias("deal_id"),
            F.col("o_custkey").alias("actor"),
            F.col("n_name").alias("nation"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_orderpriority").alias("kind"),
            F.col("o_totalprice").cast("double").alias("amount"),
        )
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves of a region > nation > customer tree: leaf, path of ancestors and itself, depth."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    tree = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer")
    return customers.join(F.broadcast(tree), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("leaf"),
        F.array(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey")).alias("path"),
        F.lit(3).alias("depth"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: item, title, text, region, outlet, track, time, relevance, story (null for one in five)."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("item_id"),
        F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 80).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("lang").alias("region"),
        F.col("source").alias("outlet"),
        F.element_at(F.array(*map(F.lit, TRACKS)), (F.floor(doc / 3) % 4 + 1).cast("int")).alias("track"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id * 37 % 1440 as int))").alias("occurred_at"),
        (F.col("n_chars") % 101).alias("relevance"),
        F.when(doc % 5 != 0, F.floor(doc / 4)).alias("story"),
    )
