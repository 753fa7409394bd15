"""Files of graphs, queries and results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators import partitioning, traversal
from hopweave.operators.graph import encode_names, last_of_pairs, named_edges, symmetric, upsert
from hopweave.plans.tables import land, numbered

EMPTY = "src int, dst int, weight int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, value of a text file or a folder of them, ``seq`` in the files' order."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(at.alias("seq"), "value")


def _arcs(spark: SparkSession, rows: DataFrame) -> DataFrame:
    number = lambda c: c.try_cast("double").try_cast("int")  # noqa: E731  weights are written as decimals and cut
    pairs = rows.select("seq", F.get("p", F.lit(0)).try_cast("int").alias("src"), F.get("p", F.lit(1)).try_cast("int").alias("dst"), number(F.get("p", F.lit(2))).alias("weight"))
    return upsert(spark.createDataFrame([], EMPTY), pairs)


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Arcs and vertices(v) of an ``.e`` file: a header line ``|V| = n``, then
    lines ``u v w``.  Lines that are not three tokens between single spaces are
    skipped, the last of repeated edges counts, vertices are 0 .. n - 1."""
    lines = _lines(spark, path)
    header = lines.where(F.col("value").startswith("|V|")).agg(F.min(F.struct("seq", "value")).alias("x")).select("x.value").where("value IS NOT NULL").first()
    if header is None:
        raise ValueError(f"{path}: no header '|V| = n'")
    n = int(header["value"].split("=")[1])
    rows = lines.where(~F.col("value").startswith("|")).select("seq", F.split("value", " ").alias("p")).where(F.size("p") == 3)
    rows = rows.where(F.forall("p", lambda x: x.rlike(r"^-?[0-9]+(\.[0-9]+)?$")))
    return _arcs(spark, rows), spark.range(n).select(F.col("id").cast("int").alias("v"))


def read_tagged_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of a file with lines ``|V|= n`` and ``Edge u v w``."""
    lines = _lines(spark, path)
    n = int(lines.where(F.col("value").startswith("|V|=")).first()["value"].split("=")[1])
    rows = lines.select("seq", F.split("value", " ").alias("t")).where((F.element_at("t", 1) == "Edge") & (F.size("t") == 4))
    return _arcs(spark, rows.select("seq", F.slice("t", 2, 3).alias("p"))), spark.range(n).select(F.col("id").cast("int").alias("v"))


def write_edge_list(edges: DataFrame, n_vertices: int, path: str) -> None:
    """An ``.e`` folder: header, then each undirected edge once.  The header's
    part sorts first; a graph without edges has only the header."""
    spark = edges.sparkSession
    once = edges.where("src < dst")
    m = once.count()
    head = spark.createDataFrame([(0, 0, f"|V| = {n_vertices}"), (1, 0, f"|E|= {m}"), (2, 0, "")], "a long, b long, value string")
    body = once.select((F.col("src") + 3).cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.concat_ws(" ", "src", "dst", F.format_string("%.10f", F.col("weight").cast("double"))).alias("value"))
    head.unionByName(body).orderBy("a", "b").select("value").write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Columnar form, the counterpart of a binary adjacency file."""
    edges.write.mode("overwrite").parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, s, t, h of white-space separated triples, until the first line that
    is not three whole numbers."""
    rows = numbered(spark, _lines(spark, path).where(F.trim("value") != ""), [F.col("seq")], "qid")
    rows = rows.withColumn("p", F.split(F.trim("value"), r"\s+"))
    good = (F.size("p") == 3) & F.forall("p", lambda x: x.rlike(r"^-?[0-9]+$"))
    bad = rows.where(~good).agg(F.min("qid")).first()[0]
    rows = rows if bad is None else rows.where(F.col("qid") < bad)
    return rows.select("qid", *[F.get("p", F.lit(i)).try_cast("int").alias(c) for i, c in enumerate("sth")])


@dataclass
class GraphConfig:
    """What a ``.properties`` file of a graph says."""

    vertex_file: str = ""
    edge_file: str = ""
    vertices: int = 0
    edges: int = 0
    directed: bool = False
    weighted: bool = False
    algorithms: list[str] = field(default_factory=list)
    bfs_source: str = ""
    sssp_source: str = ""
    sssp_weighted: bool = False
    cdlp_iterations: int = 10
    pr_iterations: int = 10
    pr_damping: float = 0.85


# The last part of a setting's name, its field and how its value is read.
SETTINGS = {
    "vertex-file": ("vertex_file", str),
    "edge-file": ("edge_file", str),
    "vertices": ("vertices", int),
    "edges": ("edges", int),
    "directed": ("directed", lambda x: x != "false"),
    "names": ("weighted", lambda x: x == "weight"),
    "algorithms": ("algorithms", lambda x: [a for a in x.split(", ") if a in ("bfs", "cdlp", "pr", "sssp", "wcc")]),
    "cdlp-max-iterations": ("cdlp_iterations", int),
    "max-iterations": ("cdlp_iterations", int),
    "pr-damping-factor": ("pr_damping", float),
    "damping-factor": ("pr_damping", float),
    "pr-num-iterations": ("pr_iterations", int),
    "num-iterations": ("pr_iterations", int),
    "sssp-weight-property": ("sssp_weighted", lambda x: x == "weight"),
    "weight-property": ("sssp_weighted", lambda x: x == "weight"),
}


def read_config(spark: SparkSession, path: str) -> GraphConfig:
    """Lines ``a.b.key = value``; blank lines, comments and other lines are skipped.
    The part after the last dot names the setting; a source vertex belongs to the
    algorithm before it, breadth-first search or else shortest paths."""
    config = GraphConfig()
    for row in spark.read.text(path).collect():  # a few lines
        line = row["value"].strip()
        if line.startswith("#") or line.count(" = ") != 1:
            continue
        name, value = line.split(" = ")
        *ahead, key = name.split(".")
        if key == "source-vertex" and ahead:
            setattr(config, "bfs_source" if ahead[-1] == "bfs" else "sssp_source", value)
        elif key in SETTINGS and ahead:
            attribute, read = SETTINGS[key]
            setattr(config, attribute, read(value))
    return config


def read_named_graph(spark: SparkSession, vertex_path: str, edge_path: str, directed: bool) -> tuple[DataFrame, DataFrame]:
    """Arcs between ids and the dictionary (name, id).

    Vertex lines are names, edge lines ``src dst [weight]``; a missing weight is 1, a
    decimal one is cut.  Ids follow the order in which names are first seen, in the
    vertex file, then in the edge file, whose ends need not be in the vertex file.
    Of repeated edges the last counts; undirected ones repeat in either direction.
    """
    listed = _lines(spark, vertex_path).select("seq", F.trim("value").alias("name")).where("name != ''")
    p = F.split(F.trim("value"), r"\s+")
    links = _lines(spark, edge_path).select("seq", p.alias("p")).where(F.size("p") >= 2).select(
        F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst"), F.coalesce(F.get("p", F.lit(2)).try_cast("double").try_cast("int"), F.lit(1)).alias("weight"), "seq"
    )
    seen = listed.select("name", F.lit(0).alias("file"), "seq", F.lit(0).alias("end"))
    for end, c in enumerate(("src", "dst")):
        seen = seen.unionByName(links.select(F.col(c).alias("name"), F.lit(1).alias("file"), "seq", F.lit(end).alias("end")))
    names = encode_names(spark, seen, ["file", "seq", "end"])
    return last_of_pairs(named_edges(links, names), directed), names


@dataclass
class NamedGraph:
    config: GraphConfig
    arcs: DataFrame
    names: DataFrame  # name, id
    sources: dict[str, int] = field(default_factory=dict)  # ids of the source vertices by algorithm


def load_named_graph(spark: SparkSession, config_path: str, folder: str) -> NamedGraph:
    """The graph that a ``.properties`` file describes, its files below ``folder``.
    Source vertices of the algorithms named must be names of the vertex file."""
    config = read_config(spark, config_path)
    vertex_path = f"{folder}/{config.vertex_file}"
    arcs, names = read_named_graph(spark, vertex_path, f"{folder}/{config.edge_file}", config.directed)
    graph = NamedGraph(config, land(spark, arcs, "named-arcs"), land(spark, names, "names"))
    listed = spark.read.text(vertex_path).select(F.trim("value").alias("name"))
    for algorithm, name in (("bfs", config.bfs_source), ("sssp", config.sssp_source)):
        if algorithm in config.algorithms:
            found = graph.names.where(F.col("name") == name).join(listed, "name", "left_semi").first()
            if found is None:
                raise ValueError(f"source vertex {name!r} of {algorithm} is not in {config.vertex_file}")
            graph.sources[algorithm] = found["id"]
    return graph


def run_algorithms(spark: SparkSession, graph: NamedGraph) -> dict[str, DataFrame]:
    """Results of the algorithms that the configuration names, by its parameters."""
    config, arcs = graph.config, graph.arcs
    runs = {
        "bfs": lambda: traversal.bfs(spark, arcs, graph.sources["bfs"]),
        "sssp": lambda: (traversal.sssp if config.sssp_weighted else traversal.bfs)(spark, arcs, graph.sources["sssp"]),
        "wcc": lambda: traversal.wcc(spark, arcs if not config.directed else symmetric(arcs)),
        "pr": lambda: traversal.pagerank(spark, arcs, config.pr_iterations, config.pr_damping),
        "cdlp": lambda: partitioning.communities(spark, arcs, config.cdlp_iterations),
    }
    return {name: runs[name]() for name in config.algorithms}


def random_graph(spark: SparkSession, n: int, m: int, low: int = 1, high: int = 100, seed: int = 1) -> DataFrame:
    """Arcs of ``m`` distinct undirected edges between n vertices, weights from
    ``low`` to ``high``.  Pairs are numbered and the m smallest keyed hashes
    taken, so a seed always gives the same graph; m pairs of all need a sort of
    all pairs, so draws go on in rounds of 2 m random pairs where pairs are many.
    """
    pairs = n * (n - 1) // 2
    if m > pairs:
        raise ValueError(f"{n} vertices have {pairs} pairs, not {m}")
    size = pairs
    draws = spark.range(size).select(F.col("id").alias("p"))
    if pairs > 8 * m:
        draws = spark.range(4 * m + 64).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(pairs)).alias("p")).distinct()
    draws = numbered(spark, draws, [F.xxhash64(F.lit(seed + 1), F.col("p")), F.col("p")], "place").where(F.col("place") < m)
    # Pair p is (a, b), b < a, of the triangular numbering p = a (a - 1) / 2 + b
    a0 = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    below = lambda a: F.call_function("div", a * (a - 1), F.lit(2))
    a = F.when(below(a0) > F.col("p"), a0 - 1).when(below(a0 + 1) <= F.col("p"), a0 + 1).otherwise(a0)
    drawn = draws.select(a.cast("int").alias("src"), (F.col("p") - below(a)).cast("int").alias("dst"), (low + F.pmod(F.xxhash64(F.lit(seed + 2), "p"), F.lit(high - low + 1))).cast("int").alias("weight"))
    return symmetric(drawn)


def read_or_generate(spark: SparkSession, path: str | None, n: int = 5000, m: int = 30000) -> DataFrame:
    return read_edge_list(spark, path)[0] if path else random_graph(spark, n, m)


def append_metrics(spark: SparkSession, metrics: dict[str, float], path: str) -> None:
    """One result line of ``key: value`` pairs."""
    line = ", ".join(f"{k}: {v}" for k, v in metrics.items())
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


# Lines of a run details file.
DETAILS = [
    "thread_num", "upper_k", "use_2023WWW_generation", "use_canonical_repair", "time_initialization", "time_generate_labels", "time_sortL",
    "time_canonical_repair", "time_total", "max_bit_size", "max_run_time_seconds", "label_size_before_canonical_repair",
    "label_size_after_canonical_repair", "canonical_repair_remove_label_ratio", "compute_label_bit_size()",
]


def write_details(spark: SparkSession, details: dict[str, float], path: str) -> None:
    """The details of a run, a line for each, those that are not given as 0."""
    shown = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    lines = ["hop_constrained_case_info:", *(f"{k}={shown(details.get(k, 0))}" for k in DETAILS)]
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
