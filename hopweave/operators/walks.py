"""Lightest walks of bounded length from many sources, without a shuffle of steps.

The sources are dealt out once; the arcs, one packed list a vertex, go to every
task.  A round takes each pair (s, v) whose walk got lighter in the last round over
all arcs of v and keeps the least of each (s, dst): all of it where s lies, so that
neither steps nor pairs are written between rounds.

A pair's state is one number, and the least number wins: distance, then 0 if an
earlier round had it, then 0 if a walk of that weight passes a vertex below s,
then the last vertex before v.

Walked backwards from labelled vertices (``labels_at``), so that labels lie by vertex
and not by hub, the state has the least vertex passed in place of the last two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.tables import TIDY, settings

#: Arcs up to which all of them are broadcast, 8 bytes each.
MOST_ARCS = 4_000_000
#: Steps a task is meant to make.
STEPS = 2_000_000

NEW, CLEAR, PARENT, LOW = 1 << 31, 1 << 30, (1 << 30) - 1, (1 << 32) - 1


@dataclass
class Plan:
    arcs: DataFrame  # src, list: packed (dst, weight), first -1 for staying
    back: DataFrame  # the same of all arcs turned round
    n_arcs: int
    top: int  # largest vertex
    steps: list[int]  # walks of 1 .. k edges from all vertices


def plan(edges: DataFrame, k: int) -> Plan | None:
    """How to walk ``edges(src, dst, weight)`` between ranks; None where there are
    too many arcs to broadcast, or numbers that a state has no room for."""
    seen = edges.agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"), F.max(F.greatest("src", "dst")).alias("top"), F.min(F.least("src", "dst")).alias("least"))
    x = seen.first()
    if not x["n"] or x["n"] > MOST_ARCS or x["low"] <= 0 or x["high"] * k > 2_147_483_647 or x["top"] > PARENT or x["least"] < 0:
        return None
    packed = lambda dst: F.shiftleft(F.col(dst).cast("long"), 32).bitwiseOR(F.col("weight").cast("long"))
    lists = lambda src, dst: edges.groupBy(F.col(src).cast("int").alias("src")).agg(F.concat(F.array(F.lit(-1).cast("long")), F.collect_list(packed(dst))).alias("list"))
    degree = edges.groupBy(F.col("src").alias("u")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    sums, more = [degree.agg(F.sum("w").alias("w"))], degree
    for _ in range(k - 1):
        more = edges.join(more, F.col("dst") == F.col("u")).groupBy(F.col("src").alias("u")).agg(F.sum("w").alias("w"))
        sums.append(more.agg(F.sum("w").alias("w")))
    with settings(edges.sparkSession, TIDY):
        total = sums[0].withColumn("h", F.lit(0))
        for h, one in enumerate(sums[1:], 1):
            total = total.unionByName(one.withColumn("h", F.lit(h)))
        steps = [int(r["w"]) for r in sorted(total.select("h", "w").collect(), key=lambda r: r["h"])]
    return Plan(lists("src", "dst"), lists("dst", "src"), x["n"], x["top"], steps)


def distance(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _round(state: DataFrame, arcs: DataFrame, last: Column | None, passed: bool = False) -> DataFrame:
    x, s, v, a = F.col("x"), F.col("s"), F.col("v"), F.col("a")
    is_new = x.bitwiseAND(F.lit(NEW)) != 0
    stay = F.array(F.lit(-1).cast("long"))
    out = state.join(F.broadcast(arcs), v == F.col("src"), "left")
    out = out.select("s", "low", "v", "x", F.explode(F.when(is_new & F.col("list").isNotNull(), F.col("list")).otherwise(stay)).alias("a"))
    dst = F.when(a == -1, v).otherwise(F.shiftright(a, 32).cast("int"))
    if passed:
        rest = F.least(x.bitwiseAND(F.lit(PARENT)), v.cast("long"))
    else:
        rest = F.when(v >= s, x.bitwiseAND(F.lit(CLEAR))).otherwise(F.lit(0).cast("long")).bitwiseOR(v.cast("long"))
    gone = F.shiftleft(F.shiftright(x, 32) + a.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(F.lit(NEW)).bitwiseOR(rest)
    out = out.select("s", "low", dst.alias("v"), F.when(a == -1, x.bitwiseAND(F.lit(~NEW))).otherwise(gone).alias("x"))
    out = out.where(v >= F.col("low"))
    if last is not None:
        out = out.where(last)
    return out.groupBy("s", "low", "v").agg(F.min("x").alias("x"))


def dealt(spark: SparkSession, made: Plan, sources: DataFrame, rounds: int, most: int | None = None) -> DataFrame:
    """``sources(s, low)`` over so many tasks that each makes about STEPS steps, but not
    many more than ``most``, the number of sources where it is known."""
    tasks = made.steps[rounds - 1] // STEPS + 1
    tasks = max(spark.sparkContext.defaultParallelism, tasks if most is None else min(tasks, most))
    return sources.select(F.col("s").cast("int").alias("s"), F.col("low").cast("int").alias("low")).repartition(tasks, "s")


def states(made: Plan, sources: DataFrame, rounds: int, last: Column | None = None) -> DataFrame:
    """s, low, v, x after so many rounds from ``sources(s, low)`` as dealt, over
    vertices from ``low`` on; of the last round only what ``last`` takes."""
    state = sources.select("s", "low", F.col("s").alias("v"), F.lit(NEW | CLEAR).cast("long").alias("x"))
    for i in range(1, rounds + 1):
        state = _round(state, made.arcs, last if i == rounds else None)
    return state


def labels(spark: SparkSession, made: Plan, sources: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """v, hub, hop, dist, parent: each of ``sources(s, low)`` at itself, and the pairs
    whose lightest walk of so many edges is lighter than any shorter one and none of
    whose lightest walks passes a vertex below the hub."""
    x, s, hubs = F.col("x"), F.col("s"), dealt(spark, made, sources, k, most)
    # Not the same column as v and hub: so Spark sees that all branches lie by hub.
    out = hubs.select(F.greatest("s", "low").alias("v"), s.alias("hub"), F.lit(0).alias("hop"), F.lit(0).alias("dist"), s.alias("parent"))
    for hop in range(1, k + 1):
        found = states(made, hubs, hop, F.col("v") > s).where(x.bitwiseAND(F.lit(NEW | CLEAR)) == NEW | CLEAR)
        found = found.select("v", s.alias("hub"), F.lit(hop).alias("hop"), distance(x).alias("dist"), x.bitwiseAND(F.lit(PARENT)).cast("int").alias("parent"))
        out = out.unionByName(found)
    return out


def labels_at(spark: SparkSession, made: Plan, sources: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """v, hub, hop, dist: all labels of the vertices ``sources(s)``, without groups.  A
    label's lightest walks lead from v back to the hub and pass no vertex below it, so
    the labels of a vertex are made, and lie, in one place."""
    x, s, v = F.col("x"), F.col("s"), F.col("v")
    ends = dealt(spark, made, sources.select("s", F.lit(0).alias("low")), k, most)
    out = ends.select(s.alias("v"), F.greatest("s", "low").alias("hub"), F.lit(0).alias("hop"), F.lit(0).alias("dist"))
    for hop in range(1, k + 1):
        state = ends.select("s", "low", s.alias("v"), F.lit(NEW | PARENT).cast("long").alias("x"))
        for i in range(1, hop + 1):
            state = _round(state, made.back, v < s if i == hop else None, passed=True)
        found = state.where((x.bitwiseAND(F.lit(NEW)) != 0) & (x.bitwiseAND(F.lit(PARENT)) > v))
        out = out.unionByName(found.select(s.alias("v"), v.alias("hub"), F.lit(hop).alias("hop"), distance(x).alias("dist")))
    return out
