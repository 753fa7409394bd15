"""Exact hop-bounded distances and paths, without an index: the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators import walks
from hopweave.operators.query import guarded
from hopweave.plans.tables import land


def layers(spark: SparkSession, edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """s, v, hop, dist, parent: the lightest walk of exactly ``hop`` edges from
    each of ``sources(s)``, of equally light ones that of the smallest parent."""
    last = sources.select(F.col("s").cast("int").alias("s")).distinct()
    last = last.select("s", F.col("s").alias("v"), F.lit(0).alias("hop"), F.lit(0).alias("dist"), F.col("s").alias("parent"))
    out = last = land(spark, last, "walk0", narrow=True)
    for hop in range(1, k + 1):
        gone = last.select("s", "v", "dist").join(edges, F.col("v") == F.col("src"))
        best = gone.groupBy("s", F.col("dst").alias("v")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).cast("int").alias("dist"), F.col("src").alias("parent"))).alias("x"))
        last = land(spark, best.select("s", F.col("v").cast("int").alias("v"), F.lit(hop).alias("hop"), "x.dist", F.col("x.parent").cast("int").alias("parent")), f"walk{hop}")
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out


def hop_distances(spark: SparkSession, edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """s, t, dist: least distance with at most ``k`` edges to all reached t.  Where
    the arcs can be broadcast, pairs are made and kept where their source lies."""
    if made := walks.plan(edges, k) if k > 0 else None:
        found = walks.states(made, walks.dealt(spark, made, sources.select("s").distinct().withColumn("low", F.lit(0)), k), k)
        return found.select("s", F.col("v").alias("t"), walks.distance(F.col("x")).alias("dist"))
    return layers(spark, edges, sources, k).groupBy("s", F.col("v").alias("t")).agg(F.min("dist").alias("dist"))


def distances(spark: SparkSession, queries: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """qid, s, t, h, distance, hops: fewest edges among the lightest walks.

    Walks of more than half of ``k`` edges are joined in the middle, from s forwards
    and from t backwards: only the halves are landed, of which hardly any reach as
    far as walks of ``k`` edges from all sources.
    """
    half = -(-k // 2)
    there = layers(spark, edges, queries.select("s"), half).select("s", F.col("v").alias("mid"), F.col("hop").alias("hop1"), F.col("dist").alias("d1"))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    back = layers(spark, turned, queries.select(F.col("t").alias("s")), k - half).select(F.col("s").alias("t"), F.col("v").alias("mid"), F.col("hop").alias("hop2"), F.col("dist").alias("d2"))
    met = queries.join(back, "t").join(there, ["s", "mid"]).where(((F.col("hop2") == 0) | (F.col("hop1") == half)) & (F.col("hop1") + F.col("hop2") <= F.col("h")))
    best = met.groupBy("qid").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("dist"), (F.col("hop1") + F.col("hop2")).alias("hop"))).alias("x"))
    found = queries.join(best, "qid", "left")
    return found.select("qid", "s", "t", "h", guarded(F.col("x.dist")).alias("distance"), F.coalesce("x.hop", F.lit(0)).cast("int").alias("hops"))


def paths(spark: SparkSession, queries: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """qid, step, a, b: a lightest walk with fewest edges, by parents per hop."""
    walks = layers(spark, edges, queries.select("s"), k)
    met = queries.where("s != t").join(walks.select("s", F.col("v").alias("t"), "hop", "dist"), ["s", "t"]).where("hop <= h")
    best = met.groupBy("qid", "s", "t").agg(F.min(F.struct("dist", "hop")).alias("x"))
    at = best.select("qid", "s", F.col("t").alias("v"), F.col("x.hop").alias("hop")).where("hop > 0")
    steps = None
    for _ in range(k):
        here = land(spark, at.join(walks.select("s", "v", "hop", "parent"), ["s", "v", "hop"]), "walk-back", narrow=True)
        step = here.select("qid", F.col("hop").alias("step"), F.col("parent").alias("a"), F.col("v").alias("b"))
        steps = step if steps is None else steps.unionByName(step)
        at = here.where("hop > 1").select("qid", "s", F.col("parent").alias("v"), (F.col("hop") - 1).alias("hop"))
        if at.isEmpty():
            break
    return steps
