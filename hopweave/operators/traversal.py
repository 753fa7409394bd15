"""Whole-graph algorithms that graph configuration files can name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators.graph import degrees
from hopweave.plans.tables import discard, land


def _relaxed(spark: SparkSession, edges: DataFrame, source: int, unit: bool) -> DataFrame:
    """v, dist by rounds: only vertices that got nearer are extended."""
    weight = F.lit(1) if unit else F.col("weight")
    best = new = land(spark, spark.createDataFrame([(source, 0)], "v long, dist long"), "near", True)
    while not new.isEmpty():
        reached = new.join(edges, F.col("v") == F.col("src")).groupBy(F.col("dst").cast("long").alias("v")).agg(F.min(F.col("dist") + weight).cast("long").alias("to"))
        nearer = reached.join(best, "v", "left").where("dist IS NULL OR to < dist").select("v", F.col("to").alias("dist"))
        before, seen = new, best
        new = land(spark, nearer, "near-new", True)
        best = land(spark, best.join(new.select("v"), "v", "left_anti").unionByName(new), "near", True)
        discard(spark, before)
        if seen is not before:
            discard(spark, seen)
    return best


def bfs(spark: SparkSession, edges: DataFrame, source: int) -> DataFrame:
    """v, dist in edges."""
    return _relaxed(spark, edges, source, True)


def sssp(spark: SparkSession, edges: DataFrame, source: int) -> DataFrame:
    """v, dist in weight."""
    return _relaxed(spark, edges, source, False)


def wcc(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """v, comp: smallest vertex of the component, by minima over neighbours and
    over the component found so far."""
    comp = land(spark, edges.select(F.col("src").alias("v")).distinct().withColumn("comp", F.col("v")), "comp")
    while True:
        near = edges.join(comp.withColumnRenamed("v", "dst"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("comp").alias("m"))
        hooked = comp.join(near, "v").select("v", "comp", F.least("comp", "m").alias("to"))
        # A component follows its best member, then its new number's own.
        root = hooked.groupBy("comp").agg(F.min("to").alias("to"))
        after = comp.join(root, "comp").select("v", F.col("to").alias("comp"), F.col("comp").alias("old"))
        after = land(spark, after, "comp")
        moved = not after.where("comp != old").isEmpty()
        discard(spark, comp)
        comp = after.select("v", "comp")
        comp._landed_path = after._landed_path
        if not moved:
            return comp


def pagerank(spark: SparkSession, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """v, score after a fixed number of rounds; scores sum to one."""
    out = land(spark, degrees(edges), "degrees")
    n = out.count()
    score = out.select("v", F.lit(1.0 / n).alias("score"))
    for _ in range(rounds):
        before = score
        share = score.join(out, "v").select(F.col("v").alias("src"), (F.col("score") / F.col("degree")).alias("share"))
        got = edges.join(share, "src").groupBy(F.col("dst").alias("v")).agg(F.sum("share").alias("in"))
        score = land(spark, out.join(got, "v", "left").select("v", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("score")), "score", True)
        discard(spark, before)
    return score
