"""Graphs derived from the driver's tables: undirected, simple, integer weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.operators.graph import symmetric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: parts and their suppliers on all lines; both arc directions."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    weight = 1 + (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 20
    return symmetric(lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"), weight.cast("int").alias("weight")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3: all customers and suppliers with their nations, nations with their
    regions; sparse, a tree for each region."""
    kinds = [
        ("nation", F.col("n_nationkey") + 100, F.col("n_regionkey")),
        ("supplier", F.col("s_suppkey") + 1_000_000, F.col("s_nationkey") + 100),
        ("customer", F.col("c_custkey") + 10_000_000, F.col("c_nationkey") + 100),
    ]
    out = None
    for name, a, b in kinds:
        rows = table(spark, sf_dir, name).select(a.cast("long").alias("src"), b.cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return symmetric(out.select("src", "dst", (1 + F.col("src") * 7 % 20).cast("int").alias("weight")))


def user_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: users whose purchases follow one another in (ts, event_id) order.

    The successor is found inside time buckets of one hour; the last purchase of
    a bucket takes the first of the next bucket that has any, so no window runs
    over all events.
    """
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        "ts", "event_id", "user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour")
    )
    firsts = bought.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    # Hours are few: the table of their first purchases grows with time, not events.
    hours = firsts.withColumn("before", F.lag("hour").over(Window.orderBy("hour"))).select(F.col("before").alias("hour"), F.col("first").alias("after"))
    inside = Window.partitionBy("hour").orderBy("ts", "event_id")
    pairs = bought.withColumn("next", F.lead("user_id").over(inside)).join(hours, "hour", "left")
    pairs = pairs.select("user_id", F.coalesce("next", "after").alias("next")).where("next IS NOT NULL AND user_id != next")
    a, b = F.least("user_id", "next"), F.greatest("user_id", "next")
    pairs = pairs.select(a.alias("a"), b.alias("b")).distinct()
    return symmetric(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), (1 + (F.col("a") * 31 + F.col("b") * 17) % 20).cast("int").alias("weight")))
