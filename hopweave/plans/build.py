"""From an edge list to a checked index, with the metrics of each stage."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators import exact, labels, partitioning, query, ranking, verify
from hopweave.plans.tables import land


@dataclass
class Index:
    ranks: DataFrame  # id, degree, rank
    edges: DataFrame  # arcs between ranks
    labels: DataFrame
    k: int
    metrics: dict[str, float] = field(default_factory=dict)

    def ask(self, queries: DataFrame, id_space: str = "rank") -> DataFrame:
        """Distances of queries (qid, s, t, h); ``id_space`` "original" takes the
        ids of the input graph.  Unknown ids are unreachable."""
        if id_space == "rank":
            return query.distances(queries, self.labels, self.k)
        r = self.ranks.select("id", "rank")
        a, b = r.select(F.col("id").alias("s"), F.col("rank").alias("rs")), r.select(F.col("id").alias("t"), F.col("rank").alias("rt"))
        # Unknown ids become ranks that no vertex has, different on both sides.
        named = queries.join(a, "s", "left").join(b, "t", "left")
        inner = named.select("qid", F.coalesce("rs", F.lit(-1)).alias("s"), F.coalesce("rt", F.lit(-2)).alias("t"), "h")
        return query.distances(inner, self.labels, self.k).select("qid", "distance").join(queries, "qid").select("qid", "s", "t", "h", "distance")


def build(
    spark: SparkSession, edges: DataFrame, k: int, most: int | None = None, isolated: DataFrame | None = None, ranges: int | None = None,
) -> Index:
    """Rank and generate; with ``most``, by communities of at most that many
    vertices, with ``ranges``, by so many ranges of ranks, and clean the union to the
    minimal set.  All give the same index; groups bound what one generation looks
    at."""
    took: dict[str, float] = {}
    began = time.time()

    def lap(name: str) -> None:
        nonlocal began
        took[name], began = round(time.time() - began, 3), time.time()

    ranks = land(spark, ranking.ranks(spark, edges, isolated), "ranks")
    arcs = land(spark, ranking.ranked_edges(edges, ranks), "ranked")
    vertices = ranks.select(F.col("rank").alias("v"))
    lap("rank_s")
    if most is None and ranges is None:
        made = land(spark, labels.generate(spark, arcs, vertices, k), "index")
        lap("generate_s")
        took["labels_before"] = took["labels_after"] = made.count()
        return Index(ranks, arcs, made, k, took)
    if ranges is not None:
        groups = land(spark, partitioning.by_range(ranks, ranges), "groups")
    else:
        wide = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")
        parts = partitioning.bounded(spark, partitioning.communities(spark, wide), most)
        groups = land(spark, partitioning.merge_small(spark, parts, most), "groups")
        # Vertices without edges are in no community: a group of their own.
        groups = vertices.join(groups, "v", "left").select("v", F.coalesce("grp", F.lit(-1)).alias("grp"))
    lap("partition_s")
    superset = land(spark, labels.generate(spark, arcs, groups, k), "superset")
    lap("generate_s")
    made = land(spark, labels.clean(superset), "index")
    lap("clean_s")
    took["labels_before"], took["labels_after"] = superset.count(), made.count()
    return Index(ranks, arcs, made, k, took)


def check(spark: SparkSession, index: Index, queries: DataFrame) -> dict[str, int]:
    """Mismatches of index distances and paths against exact search."""
    return verify.mismatches(spark, queries, index.labels, index.edges, index.k).first().asDict()


def check_queries(spark: SparkSession, index: Index, queries: DataFrame, exact_first: int = 100) -> dict[str, float]:
    """The check of a file's queries (qid, s, t, h), with seconds of each part.

    All queries' index paths must weigh their index distance; the ``exact_first``
    first ones' distances must be those of exact search.
    """
    took: dict[str, float] = {}
    held: dict[str, DataFrame] = {}

    def timed(name: str, df: DataFrame) -> None:
        began = time.time()
        held[name] = land(spark, df, name)
        took[f"{name}_s"] = round(time.time() - began, 3)

    first = query.clamped(queries.where(F.col("qid") < exact_first), index.k).withColumn("h", F.col("hh")).drop("hh")
    timed("query_dis", query.distances(queries, index.labels, index.k))
    timed("query_path", query.path_check(queries, query.paths(spark, queries, index.labels, index.k), index.edges))
    timed("exact_dis", exact.distances(spark, first, index.edges, index.k))
    timed("exact_path", query.path_check(first, exact.paths(spark, first, index.edges, index.k), index.edges))
    answers = held["query_dis"].select("qid", "distance")
    weights = answers.join(held["query_path"], "qid").where("distance != path_weight").count()
    truth = held["exact_dis"].select("qid", F.col("distance").alias("truth")).join(held["exact_path"].select("qid", F.col("path_weight").alias("walked")), "qid")
    wrong = answers.join(truth, "qid").where("distance != truth OR truth != walked").count()
    return took | {"query_num": answers.count(), "n_distance": wrong, "n_path": weights}
