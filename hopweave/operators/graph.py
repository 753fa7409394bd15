"""Graph storage as an arc table: ``edges(src, dst, weight)``, both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.plans.tables import numbered


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of undirected edges (src, dst, weight)."""
    turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return pairs.select("src", "dst", "weight").unionByName(turned)


def upsert(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Add or replace undirected edges; ``changes(src, dst, weight, seq)``, the
    largest ``seq`` of a pair wins."""
    new = last_of_pairs(changes, directed=False)
    return edges.join(new, ["src", "dst"], "left_anti").select("src", "dst", "weight").unionByName(new)


def remove(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the undirected ``pairs(src, dst)``; absent ones are no error."""
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(both, ["src", "dst"], "left_anti")


def isolate(edges: DataFrame, vertex: int) -> DataFrame:
    """Without all edges at a vertex."""
    return edges.where((F.col("src") != vertex) & (F.col("dst") != vertex))


def exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with ``found``."""
    marked = edges.select("src", "dst", F.lit(True).alias("found"))
    return pairs.join(marked, ["src", "dst"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def weight_of(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with ``weight``, null where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left")


def neighbour_by_weight(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(v, weight)`` with the smallest neighbour at that weight, or -1."""
    best = edges.groupBy(F.col("src").alias("v"), "weight").agg(F.min("dst").alias("neighbour"))
    return wanted.join(best, ["v", "weight"], "left").withColumn("neighbour", F.coalesce("neighbour", F.lit(-1)))


def neighbours(edges: DataFrame) -> DataFrame:
    """v, list: sorted (dst, weight) of every vertex."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("list"))


def vertices(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """v of all vertices; ``isolated(v)`` adds those without edges."""
    found = edges.select(F.col("src").alias("v"))
    return (found.unionByName(isolated.select("v")) if isolated is not None else found).distinct()


def degrees(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """v, degree."""
    found = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    if isolated is None:
        return found
    return vertices(edges, isolated).join(found, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def counts(edges: DataFrame) -> DataFrame:
    """One row: n vertices, m undirected edges, arcs."""
    n = F.count_distinct("src").alias("n")
    return edges.agg(n, F.count(F.when(F.col("src") <= F.col("dst"), 1)).alias("m"), F.count(F.lit(1)).alias("arcs"))


def csr_offsets(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """v, start, degree: the compressed-row form, arcs in (src, dst) order."""
    ids = edge_ids(spark, edges)
    return ids.groupBy(F.col("src").alias("v")).agg(F.min("edge_id").alias("start"), F.count(F.lit(1)).alias("degree"))


def edge_ids(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Arcs with ``edge_id``, their place in (src, dst) order."""
    return numbered(spark, edges, [F.col("src"), F.col("dst")], "edge_id")


def reverse_ids(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edge_id, inv: each arc's and its opposite's."""
    ids = edge_ids(spark, edges).select("edge_id", "src", "dst")
    other = ids.select(F.col("edge_id").alias("inv"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ids.join(other, ["src", "dst"]).select("edge_id", "inv")


def asymmetric(edges: DataFrame) -> DataFrame:
    """Arcs whose opposite is missing; empty for a valid graph."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def encode_names(spark: SparkSession, names: DataFrame, order: list[str]) -> DataFrame:
    """name, id: dense ids of the distinct names of ``names(name, *order)``, in the
    order in which they are first seen."""
    first = names.groupBy("name").agg(F.min(F.struct(*order)).alias("seen"))
    return numbered(spark, first, [F.col("seen")], "id").select("name", "id")


def named_edges(links: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``links(src, dst, ...)`` between names as arcs between their ids."""
    a = dictionary.select(F.col("name").alias("src"), F.col("id").alias("src_id"))
    b = dictionary.select(F.col("name").alias("dst"), F.col("id").alias("dst_id"))
    rest = [c for c in links.columns if c not in ("src", "dst")]
    return links.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *rest)


def last_of_pairs(arcs: DataFrame, directed: bool = True) -> DataFrame:
    """Of repeated arcs (src, dst, weight, seq) the last; undirected ones repeat in
    either direction, and the result has both."""
    if directed:
        return arcs.groupBy("src", "dst").agg(F.max_by("weight", "seq").alias("weight"))
    last = arcs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("weight", "seq").alias("weight"))
    return symmetric(last.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")).distinct()
