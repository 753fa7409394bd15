"""Vertex groups: ranges, communities of bounded size, merging and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.tables import discard, land, numbered


def by_range(ranked: DataFrame, n_groups: int) -> DataFrame:
    """v, grp: ranks cut in ``n_groups`` runs of ceil(V / n_groups)."""
    size = ranked.agg(F.ceil(F.count(F.lit(1)) / n_groups).alias("size"))
    return ranked.crossJoin(F.broadcast(size)).select(F.col("rank").alias("v"), F.floor(F.col("rank") / F.col("size")).cast("int").alias("grp"))


def communities(spark: SparkSession, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """v, label: synchronous label propagation.  Every round a vertex takes the
    most frequent label of its neighbours, of equally frequent ones the smallest;
    labels start as the vertices themselves."""
    labels = edges.select(F.col("src").alias("v")).distinct().withColumn("label", F.col("v"))
    for i in range(rounds):
        votes = edges.join(labels.withColumnRenamed("v", "dst"), "dst").groupBy(F.col("src").alias("v"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("v").agg(F.max(F.struct("n", (-F.col("label")).alias("low"))).alias("x"))
        after = land(spark, best.select("v", (-F.col("x.low")).alias("label")), "labels", True)
        if i:
            discard(spark, labels)
        labels = after
    return labels


def bounded(spark: SparkSession, labels: DataFrame, most: int) -> DataFrame:
    """v, label, part: communities over ``most`` vertices split in runs by id.  The
    places in the order of (label, v) less a community's first one are the places in
    it, so a single huge community is not one task's either."""
    placed = numbered(spark, labels.select("v", "label"), [F.col("label"), F.col("v")], "at")
    first = placed.groupBy("label").agg(F.min("at").alias("first"))
    return placed.join(first, "label").select("v", "label", F.floor((F.col("at") - F.col("first")) / most).cast("int").alias("part"))


def merge_small(spark: SparkSession, parts: DataFrame, most: int) -> DataFrame:
    """v, grp: best fit.  The largest open group again and again takes in the
    largest other one that still fits; then it is closed.  Ties: smaller key.

    Only (group, size) pairs come to the driver; they are as many as there are
    communities, not vertices.
    """
    sizes = parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    by_size: dict[int, list] = {}
    for r in sorted(sizes, key=lambda r: (r["label"], r["part"]), reverse=True):
        by_size.setdefault(r["n"], []).append((r["label"], r["part"]))
    out, number = [], 0

    def largest(limit: int):
        fit = [n for n in by_size if n <= limit and by_size[n]]
        return max(fit, default=None)

    while (n := largest(max(by_size, default=0))) is not None:
        members, filled = [by_size[n].pop()], n
        while (k := largest(most - filled)) is not None:
            members.append(by_size[k].pop())
            filled += k
        out += [(label, part, number) for label, part in members]
        number += 1
    mapping = spark.createDataFrame(out, "label long, part int, grp int")
    return parts.join(mapping, ["label", "part"]).select("v", "grp")


def by_degree(groups: DataFrame, degrees: DataFrame) -> DataFrame:
    """grp, degree, place: groups by total degree, largest first, then number."""
    total = groups.join(degrees, "v").groupBy("grp").agg(F.sum("degree").alias("degree"))
    return numbered(groups.sparkSession, total, [F.desc("degree"), F.col("grp")], "place").withColumn("place", F.col("place").cast("int"))


def largest(groups: DataFrame, floor: int) -> DataFrame:
    """One row: the size bound after raising it to the largest group, and the
    number of groups."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.greatest(F.max("n"), F.lit(floor)).alias("bound"), F.count(F.lit(1)).alias("n_groups"))
