"""Batches of queries (qid, s, t, h) answered from the label index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.tables import land

UNREACHABLE = 2_147_483_647


def clamped(queries: DataFrame, k: int) -> DataFrame:
    """``h`` cut to the index's bound as ``hh``."""
    return queries.withColumn("hh", F.least(F.col("h"), F.lit(k)))


def guarded(found: Column) -> Column:
    """A distance by the rules: h < 0 none, s = t zero, h = 0 none, else found."""
    none = F.lit(UNREACHABLE)
    return F.when(F.col("h") < 0, none).when(F.col("s") == F.col("t"), 0).when(F.col("h") == 0, none).otherwise(F.coalesce(found, none)).cast("int")


def _real(queries: DataFrame, k: int) -> DataFrame:
    return clamped(queries, k).where("h > 0 AND s != t")


def ends(queries: DataFrame, k: int) -> DataFrame:
    """v: the queries' ends, whose labels alone ``meetings`` joins."""
    return _real(queries, k).select(F.explode(F.array("s", "t")).alias("v")).distinct()


def at_ends(queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Labels of the queries' ends."""
    return labels.join(ends(queries, k), "v", "left_semi")


def meetings(queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Per query the best common hub, as ``best``: (d, hub, hop1, d1, hop2, d2),
    the least of these in that order.  Labels of no query's end are left out before
    they are joined."""
    real = _real(queries, k)
    labels = at_ends(queries, labels, k)
    a = labels.select(F.col("v").alias("s"), "hub", F.col("hop").alias("hop1"), F.col("dist").alias("d1"))
    b = labels.select(F.col("v").alias("t"), "hub", F.col("hop").alias("hop2"), F.col("dist").alias("d2"))
    met = real.join(a, "s").where("hop1 <= hh").join(b, ["t", "hub"]).where("hop1 + hop2 <= hh")
    best = F.min(F.struct((F.col("d1") + F.col("d2")).alias("d"), "hub", "hop1", "d1", "hop2", "d2"))
    return met.groupBy("qid").agg(best.alias("best"))


def distances(queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """qid, s, t, h, distance."""
    found = queries.join(meetings(queries, labels, k), "qid", "left")
    return found.select("qid", "s", "t", "h", guarded(F.col("best.d")).alias("distance"))


def paths(
    spark: SparkSession, queries: DataFrame, labels: DataFrame, k: int, edges: DataFrame | None = None, of_hubs: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """qid, step, a, b: the edges of a best path from s to t in order, at most h
    of them.  No rows where s = t or t is out of reach.

    From both ends the labels of the best hub are followed back to it: by stored
    parents, or, given ``edges``, without them, to the smallest neighbour whose
    label has one hop and the edge's weight less.  At most ``k`` rounds.

    Where ``of_hubs`` makes all labels of ``hubs(hub)``, ``labels`` need only have
    those ``at_ends``, and the whole index need not be landed.
    """
    best = queries.select("qid", "s", "t").join(meetings(queries, labels, k), "qid").select("qid", "s", "t", "best.*")
    best = land(spark, best, "path-ends", narrow=True)
    # Ways only lead over labels of the best hubs.
    hubs = best.select("hub").distinct()
    labels = land(spark, of_hubs(hubs) if of_hubs else labels.join(hubs, "hub", "left_semi"), "path-labels", narrow=True)
    side = lambda name, v, hop, d: best.select("qid", F.lit(name).alias("side"), F.col(v).alias("v"), "hub", F.col(hop).alias("hop"), F.col(d).alias("dist"))
    walk = side("s", "s", "hop1", "d1").unionByName(side("t", "t", "hop2", "d2")).where("hop > 0")
    steps = None
    for _ in range(k):
        if edges is None:
            at = walk.join(labels.select("v", "hub", "hop", "parent"), ["v", "hub", "hop"])
            weights = labels.select(F.col("v").alias("parent"), "hub", F.col("hop").alias("near"), F.col("dist").alias("rest"))
            at = at.join(weights, ["parent", "hub"]).where("near = hop - 1").withColumnRenamed("parent", "next")
        else:
            near = labels.select(F.col("v").alias("dst"), "hub", F.col("hop").alias("near"), F.col("dist").alias("rest"))
            at = walk.join(edges, F.col("v") == F.col("src")).join(near, ["dst", "hub"]).where("near = hop - 1 AND rest = dist - weight")
            at = at.groupBy("qid", "side", "v", "hub", "hop").agg(F.min(F.struct(F.col("dst").alias("next"), "rest")).alias("x")).select("qid", "side", "v", "hub", "hop", "x.*")
        at = land(spark, at.select("qid", "side", "v", "hub", "hop", "next", "rest"), "path-steps", narrow=True)
        steps = at if steps is None else steps.unionByName(at)
        walk = at.where("hop > 1").select("qid", "side", F.col("next").alias("v"), "hub", (F.col("hop") - 1).alias("hop"), F.col("rest").alias("dist"))
        if walk.isEmpty():
            break
    steps = steps.join(best.select("qid", "hop1", "hop2"), "qid")
    number = F.when(F.col("side") == "s", F.col("hop1") - F.col("hop") + 1).otherwise(F.col("hop1") + F.col("hop"))
    a = F.when(F.col("side") == "s", F.col("v")).otherwise(F.col("next"))
    b = F.when(F.col("side") == "s", F.col("next")).otherwise(F.col("v"))
    return steps.select("qid", number.cast("int").alias("step"), a.alias("a"), b.alias("b"))


def path_check(queries: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, path_weight, hops: the sum of the path's edge weights.  Without an
    edge: 0 where s = t, else unreachable."""
    weighed = steps.join(edges, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")))
    sums = weighed.groupBy("qid").agg(F.sum("weight").cast("int").alias("w"), F.count(F.lit(1)).alias("n"))
    none = F.when((F.col("h") >= 0) & (F.col("s") == F.col("t")), 0).otherwise(UNREACHABLE)
    return queries.join(sums, "qid", "left").select("qid", F.coalesce("w", none).cast("int").alias("path_weight"), F.coalesce("n", F.lit(0)).cast("long").alias("hops"))
