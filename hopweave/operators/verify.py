"""Differential checks of the index against exact search, and index statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators import exact, query

LABEL_BYTES = 16  # four 32-bit numbers


def random_queries(n_vertices: int, sources: int, terminals: int, k: int, spark: SparkSession, seed: int = 7) -> DataFrame:
    """qid, s, t, h: ``sources`` x ``terminals`` queries from a keyed hash, so a
    seed always gives the same ones on any number of partitions."""
    pick = lambda salt, *by: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *by), F.lit(n_vertices)).cast("int")
    q = spark.range(sources * terminals).withColumnRenamed("id", "qid")
    h = F.pmod(F.xxhash64(F.lit(seed), F.lit(2), F.col("qid")), F.lit(k + 1)).cast("int")
    return q.select("qid", pick(0, F.floor(F.col("qid") / terminals)).alias("s"), pick(1, F.col("qid")).alias("t"), h.alias("h"))


def mismatches(spark: SparkSession, queries: DataFrame, labels: DataFrame, edges: DataFrame, k: int, of_hubs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row: queries, how many index distances differ from exact ones, how
    many index paths do not weigh their distance."""
    index = query.distances(queries, labels, k)
    truth = exact.distances(spark, query.clamped(queries, k).withColumn("h", F.col("hh")).drop("hh"), edges, k)
    weights = query.path_check(queries, query.paths(spark, queries, labels, k, of_hubs=of_hubs), edges)
    both = index.join(truth.select("qid", F.col("distance").alias("truth")), "qid").join(weights, "qid")
    wrong = lambda c: F.count(F.when(c, 1))
    return both.agg(
        F.count(F.lit(1)).alias("n_queries"), wrong(F.col("distance") != F.col("truth")).alias("n_distance"),
        wrong(F.col("distance") != F.col("path_weight")).alias("n_path"),
    )


def index_stats(before: DataFrame, after: DataFrame, n_vertices: int) -> DataFrame:
    """One row: labels before and after cleaning, ratio removed, labels per
    vertex, bytes."""
    a = before.agg(F.count(F.lit(1)).alias("labels_before"))
    b = after.agg(F.count(F.lit(1)).alias("labels_after"))
    both = a.join(b)
    return both.select(
        "labels_before", "labels_after", (1 - F.col("labels_after") / F.col("labels_before")).alias("removed"),
        (F.col("labels_after") / n_vertices).alias("per_vertex"), (F.col("labels_after") * LABEL_BYTES).alias("bytes"),
    )


def labels_per_hop(labels: DataFrame) -> DataFrame:
    return labels.groupBy("hop").agg(F.count(F.lit(1)).alias("n"))
