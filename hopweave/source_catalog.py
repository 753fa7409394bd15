"""Registered queries of files: written from the fixture graphs, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators import graph, ranking
from hopweave.plans.tables import land, shared_dir
from hopweave.sources import edge_lists, fixtures


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _text(rows: DataFrame, order: list[str], path: str) -> str:
    """Write column ``value`` in an order, as a folder of files that sort by it."""
    rows.orderBy(*order).select("value").write.text(path)
    return path


def _dense(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Arcs of G2 between ranks, and the number of vertices."""
    edges = land(spark, fixtures.user_succession(spark, sf), "g2")
    ranks = land(spark, ranking.ranks(spark, edges), "ranks")
    return land(spark, ranking.ranked_edges(edges, ranks), "ranked"), ranks.count()


def source_edge_list(spark: SparkSession, sf: str) -> DataFrame:
    """An edge list file written and read."""
    arcs, n = _dense(spark, sf)
    path = _place(spark, "g.e")
    edge_lists.write_edge_list(arcs, n, path)
    return edge_lists.read_edge_list(spark, path)[0]


def source_edge_list_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices that an edge list file's header promises."""
    arcs, n = _dense(spark, sf)
    path = _place(spark, "g.e")
    edge_lists.write_edge_list(arcs.where("src < 3"), n, path)
    return edge_lists.read_edge_list(spark, path)[1]


def source_tagged_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A tagged edge list with other lines in between and every edge twice, the
    second time turned and three heavier."""
    arcs, n = _dense(spark, sf)
    once = arcs.where("src < dst")
    line = lambda a, b, w: F.concat_ws(" ", F.lit("Edge"), a, b, w)
    rows = once.select(F.lit(1).alias("a"), "src", "dst", line("src", "dst", "weight").alias("value"))
    rows = rows.unionByName(once.select(F.lit(2).alias("a"), "src", "dst", line("dst", "src", F.col("weight") + 3).alias("value")))
    rows = rows.unionByName(once.select(F.lit(3).alias("a"), "src", "dst", F.concat_ws(" ", F.lit("Note"), "src", "dst", "weight").alias("value")))
    head = spark.createDataFrame([(0, 0, 0, f"|V|= {n}")], "a int, src int, dst int, value string")
    return edge_lists.read_tagged_edges(spark, _text(head.unionByName(rows), ["a", "src", "dst"], _place(spark, "t.e")))[0]


def source_columnar_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour counts and weight sums of a graph saved and loaded."""
    path = _place(spark, "g.parquet")
    edge_lists.write_graph(fixtures.part_supplier(spark, sf), path)
    return edge_lists.read_graph(spark, path).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def source_query_file(spark: SparkSession, sf: str) -> DataFrame:
    """A query file of customers by number, up to its first bad line."""
    c = fixtures.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = c.select("c_custkey", F.concat_ws(" ", "c_custkey", "c_nationkey", F.col("c_custkey") % 5).alias("value"))
    bad = spark.createDataFrame([(101, "bad line"), (102, "")], "c_custkey long, value string")
    rows = rows.unionByName(bad).withColumn("kind", F.col("value").startswith("bad"))
    return edge_lists.read_queries(spark, _text(rows, ["c_custkey", "kind"], _place(spark, "q.txt")))


def _named_files(spark: SparkSession, sf: str) -> str:
    """A folder with a graph of names: nations in the vertex file; edges from nations
    to regions, which are not in it, and from nations to the next ones, some again
    and turned with another weight or without any."""
    folder = _place(spark, "named")
    n, r = fixtures.table(spark, sf, "nation"), fixtures.table(spark, sf, "region")
    blank = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    n = n.select("n_nationkey", blank("n_name").alias("name"), "n_regionkey")
    r = r.select("r_regionkey", F.concat(F.lit("R_"), blank("r_name")).alias("region"))
    _text(n.select("n_nationkey", F.col("name").alias("value")), ["n_nationkey"], f"{folder}/g.v")
    links = n.join(r, n.n_regionkey == r.r_regionkey)
    first = links.select(F.lit(1).alias("a"), "n_nationkey", F.concat_ws(" ", "name", "region", F.concat(F.col("n_nationkey") + 1, F.lit(".9"))).alias("value"))
    again = links.where("n_nationkey % 3 = 0").select(F.lit(2).alias("a"), "n_nationkey", F.concat_ws(" ", "region", "name", F.col("n_nationkey") + 50).alias("value"))
    bare = links.where("n_nationkey % 4 = 0").select(F.lit(3).alias("a"), "n_nationkey", F.concat_ws(" ", "name", "region").alias("value"))
    _text(first.unionByName(again).unionByName(bare), ["a", "n_nationkey"], f"{folder}/g.e")
    settings = [
        "# a graph", "", "graph.g.vertex-file = g.v", "graph.g.edge-file = g.e", "graph.g.directed = false", "graph.g.algorithms = bfs, wcc, sssp",
        "graph.g.edge-properties.names = weight", "graph.g.bfs.source-vertex = CHINA", "graph.g.sssp.source-vertex = CHINA", "graph.g.sssp.weight-property = weight",
        "graph.g.cdlp.max-iterations = 7", "graph.g.pr.damping-factor = 0.75", "graph.g.pr-num-iterations = 4", "no setting",
    ]
    first = n.where("n_nationkey = 0").first()["name"]
    rows = spark.createDataFrame([(i, x.replace("CHINA", first)) for i, x in enumerate(settings)], "i int, value string")
    _text(rows.coalesce(1), ["i"], f"{folder}/g.properties")
    return folder


def source_config(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of a configuration file, with its field's type."""
    config = edge_lists.read_config(spark, f"{_named_files(spark, sf)}/g.properties")
    shown = lambda x: ",".join(x) if isinstance(x, list) else str(x)
    return spark.createDataFrame([(k, type(v).__name__, shown(v)) for k, v in vars(config).items()], "setting string, kind string, value string")


def _loaded(spark: SparkSession, sf: str) -> edge_lists.NamedGraph:
    folder = _named_files(spark, sf)
    return edge_lists.load_named_graph(spark, f"{folder}/g.properties", folder)


def source_named_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded(spark, sf).names


def source_named_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded(spark, sf).arcs


def source_named_algorithms(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth-first distances and weighted ones from the sources that the
    configuration names."""
    found = edge_lists.run_algorithms(spark, _loaded(spark, sf))
    return found["bfs"].select("v", F.col("dist").alias("edges")).join(found["sssp"].select("v", "dist"), "v")


def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines of metrics appended to one place."""
    arcs, n = _dense(spark, sf)
    path = _place(spark, "metrics")
    for k in (2, 3):
        edge_lists.append_metrics(spark, {"k": k, "vertices": n, "arcs": arcs.count()}, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def source_run_details(spark: SparkSession, sf: str) -> DataFrame:
    arcs, n = _dense(spark, sf)
    path = _place(spark, "details")
    edge_lists.write_details(spark, {"upper_k": 3, "label_size_before_canonical_repair": arcs.count(), "label_size_after_canonical_repair": n, "time_total": 0.5}, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def source_random_graph(spark: SparkSession, sf: str) -> DataFrame:
    """What a random graph of as many vertices and four times as many edges as there
    are customers must have."""
    n = fixtures.table(spark, sf, "customer").count()
    arcs = land(spark, edge_lists.read_or_generate(spark, None, n, 4 * n), "random")
    right = (F.col("src") != F.col("dst")) & F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1) & F.col("weight").between(1, 100)
    once = arcs.agg(F.count(F.lit(1)).alias("arcs"), F.count(F.when(right, 1)).alias("right"), F.count_distinct("src", "dst").alias("distinct"))
    return once.crossJoin(graph.asymmetric(arcs).agg(F.count(F.lit(1)).alias("one_way")))


QUERIES = {
    "source_edge_list": source_edge_list,
    "source_edge_list_vertices": source_edge_list_vertices,
    "source_tagged_edges": source_tagged_edges,
    "source_columnar_graph": source_columnar_graph,
    "source_query_file": source_query_file,
    "source_config": source_config,
    "source_named_vertices": source_named_vertices,
    "source_named_graph": source_named_graph,
    "source_named_algorithms": source_named_algorithms,
    "source_metrics": source_metrics,
    "source_run_details": source_run_details,
    "source_random_graph": source_random_graph,
}

NAMED = """
n AS (SELECT n_nationkey AS k, replace(n_name, ' ', '_') AS name, 'R_' || replace(r_name, ' ', '_') AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT 1 AS a, k, name AS x, region AS y, k + 1 AS weight FROM n UNION ALL SELECT 2, k, region, name, k + 50 FROM n WHERE k % 3 = 0
      UNION ALL SELECT 3, k, name, region, 1 FROM n WHERE k % 4 = 0),
s AS (SELECT replace(n_name, ' ', '_') AS name, 0 AS a, n_nationkey AS k, 0 AS z FROM nation UNION ALL SELECT x, a, k, 0 FROM l UNION ALL SELECT y, a, k, 1 FROM l),
d AS (SELECT name, row_number() OVER (ORDER BY min((a, k, z))) - 1 AS id FROM s GROUP BY name),
w AS (SELECT p.id AS src, q.id AS dst, weight, row_number() OVER (PARTITION BY least(p.id, q.id), greatest(p.id, q.id) ORDER BY a DESC, k DESC) AS r
      FROM l JOIN d p ON p.name = x JOIN d q ON q.name = y),
arcs AS (SELECT src, dst, CAST(weight AS INTEGER) AS weight FROM w WHERE r = 1 UNION ALL SELECT dst, src, CAST(weight AS INTEGER) FROM w WHERE r = 1)"""


def oracles(dense: str, parts: str) -> dict[str, str]:
    """SQL of the queries; ``dense`` defines e and rk of G2, ``parts`` e0 of G1."""
    details = ["hop_constrained_case_info:", *(f"{k}=0" for k in edge_lists.DETAILS)]
    given = {"upper_k": "'upper_k=3'", "time_total": "'time_total=0.500000'"}
    given |= {"label_size_before_canonical_repair": "'label_size_before_canonical_repair=' || (SELECT count(*) FROM e)"}
    given |= {"label_size_after_canonical_repair": "'label_size_after_canonical_repair=' || (SELECT count(*) FROM rk)"}
    lines = " UNION ALL ".join(f"SELECT {given.get(x.split('=')[0], repr(x))} AS line" for x in details)
    config = [
        ("vertex_file", "str", "g.v"), ("edge_file", "str", "g.e"), ("vertices", "int", "0"), ("edges", "int", "0"), ("directed", "bool", "False"),
        ("weighted", "bool", "True"), ("algorithms", "list", "bfs,wcc,sssp"), ("sssp_weighted", "bool", "True"), ("cdlp_iterations", "int", "7"),
        ("pr_iterations", "int", "4"), ("pr_damping", "float", "0.75"),
    ]
    rows = ", ".join(map(str, config))
    source = "(SELECT replace(n_name, ' ', '_') FROM nation WHERE n_nationkey = 0)"
    return {
        "source_edge_list": f"WITH {dense} SELECT src, dst, weight FROM e",
        "source_edge_list_vertices": f"WITH {dense} SELECT rank AS v FROM rk",
        "source_tagged_edges": f"WITH {dense} SELECT src, dst, CAST(weight + 3 AS INTEGER) AS weight FROM e",
        "source_columnar_graph": f"WITH {parts} SELECT src AS v, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM e0 GROUP BY src",
        "source_query_file": """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS qid, CAST(c_custkey AS INTEGER) AS s, CAST(c_nationkey AS INTEGER) AS t,
            CAST(c_custkey % 5 AS INTEGER) AS h FROM customer WHERE c_custkey <= 101""",
        "source_config": f"""SELECT * FROM (VALUES {rows}) t(setting, kind, value) UNION ALL SELECT 'bfs_source', 'str', {source} UNION ALL SELECT 'sssp_source', 'str', {source}""",
        "source_named_vertices": f"WITH {NAMED} SELECT name, id FROM d",
        "source_named_graph": f"WITH {NAMED} SELECT src, dst, weight FROM arcs",
        "source_named_algorithms": f"""WITH RECURSIVE {NAMED}, r(v, edges, dist, seen) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL
            SELECT arcs.dst, r.edges + 1, r.dist + arcs.weight, list_append(seen, arcs.dst) FROM r JOIN arcs ON arcs.src = r.v WHERE NOT list_contains(seen, arcs.dst))
            SELECT v, min(edges) AS edges, min(dist) AS dist FROM r GROUP BY v""",
        "source_metrics": f"WITH {dense} SELECT 'k: ' || k || ', vertices: ' || (SELECT count(*) FROM rk) || ', arcs: ' || (SELECT count(*) FROM e) AS line FROM (VALUES (2), (3)) t(k)",
        "source_run_details": f"WITH {dense} {lines}",
        "source_random_graph": 'SELECT 8 * n AS arcs, 8 * n AS "right", 8 * n AS "distinct", 0::BIGINT AS one_way FROM (SELECT count(*) AS n FROM customer)',
    }
