"""Vertices renumbered by importance: larger degree first, then smaller id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators.graph import degrees
from hopweave.plans.tables import numbered


def ranks(spark: SparkSession, edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """id, degree, rank; self-loops count towards the degree."""
    found = degrees(edges, isolated).withColumnRenamed("v", "id")
    return numbered(spark, found, [F.desc("degree"), F.col("id")], "rank").withColumn("rank", F.col("rank").cast("int"))


def ranked_edges(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """Arcs between ranks, without self-loops."""
    a = ranked.select(F.col("id").alias("src"), F.col("rank").alias("a"))
    b = ranked.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    return edges.where("src != dst").join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def carry(flags: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per-vertex flags (id, flag) moved to ranks."""
    return ranked.join(flags, "id", "left").select("rank", "flag")
