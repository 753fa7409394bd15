"""The hop-constrained 2-hop label index.

A label (v, hub, hop, dist, parent) says that a way of ``hop`` edges and weight
``dist`` leads from ``hub`` to ``v``, all of whose other vertices rank below the
hub (have larger numbers), and that no label of fewer hops and no pair of labels
over a better hub does as well.  The set of these labels is unique; parents are
the smallest of equally good ones.

Generation is semi-naive and synchronous by hops.  Where walks of k edges are not
many more than arcs, as on graphs without great hubs, labels are read off the lightest
walks, made where their hub lies (``walks``).  Else only the labels of the last hop are
extended and candidates meet the labels so far; each hop is one declarative plan,
landed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.operators import walks
from hopweave.plans.tables import land

#: Walks of k edges for each arc up to which labels are read off walks.
WALKS_PER_ARC = 4096
#: Labels of at most half the hops up to which ``clean`` broadcasts them, 40 bytes each.
MOST_SHORT = 2_000_000
#: Labels a task of ``clean`` is meant to take.
LABELS_A_TASK = 100_000
COLUMNS = ["v", "hub", "hop", "dist", "parent"]


def initial(vertices: DataFrame) -> DataFrame:
    """Self labels of ``vertices(v, grp)``."""
    v = F.col("v").cast("int")
    return vertices.select(v.alias("v"), v.alias("hub"), F.lit(0).alias("hop"), F.lit(0).alias("dist"), v.alias("parent"), F.col("grp").cast("int").alias("grp"))


def expand(frontier: DataFrame, edges: DataFrame, hop: int) -> DataFrame:
    """Candidates of the next hop: every label over every arc to a vertex that
    ranks below its hub, the lightest (then the smallest parent) of each pair."""
    reached = frontier.select("v", "hub", "dist", "grp").join(edges, (F.col("v") == F.col("src")) & (F.col("hub") < F.col("dst")))
    best = reached.groupBy(F.col("dst").alias("v"), "hub").agg(
        F.min(F.struct((F.col("dist") + F.col("weight")).cast("int").alias("dist"), F.col("src").cast("int").alias("parent"))).alias("x"), F.first("grp").alias("grp")
    )
    return best.select(F.col("v").cast("int").alias("v"), "hub", F.lit(hop).alias("hop"), "x.dist", "x.parent", "grp")


def uncovered(candidates: DataFrame, labels: DataFrame, hop: int) -> DataFrame:
    """Candidates that labels of fewer hops do not replace.

    A candidate (v, hub, d) goes when the same pair has a label of at most d, or
    labels (v, mid) and (hub, mid) of together at most ``hop`` hops weigh at most
    d.  The join starts from candidates: their vertex's labels, then, by both
    keys, the hub's.
    """
    shorter = labels.groupBy("v", "hub").agg(F.min("dist").alias("seen"))
    left = candidates.join(shorter, ["v", "hub"], "left").where("seen IS NULL OR seen > dist").drop("seen")
    mine = labels.where("hop > 0").select(F.col("v").alias("av"), F.col("hub").alias("mid"), F.col("hop").alias("ah"), F.col("dist").alias("ad"), F.col("grp").alias("ag"))
    hubs = labels.where("hop > 0").select(F.col("v").alias("bv"), F.col("hub").alias("bmid"), F.col("hop").alias("bh"), F.col("dist").alias("bd"), F.col("grp").alias("bg"))
    half = left.join(mine, (F.col("v") == F.col("av")) & (F.col("grp") == F.col("ag")) & (F.col("mid") < F.col("hub")) & (F.col("ad") < F.col("dist")))
    whole = half.join(
        hubs, (F.col("hub") == F.col("bv")) & (F.col("mid") == F.col("bmid")) & (F.col("ag") == F.col("bg"))
        & (F.col("ah") + F.col("bh") <= hop) & (F.col("ad") + F.col("bd") <= F.col("dist")), "left_semi",
    )
    return left.join(whole.select("v", "hub").distinct(), ["v", "hub"], "left_anti")


def generate(spark: SparkSession, edges: DataFrame, vertices: DataFrame, k: int, with_group: bool = False) -> DataFrame:
    """All labels of up to ``k`` hops.

    ``edges(src, dst, weight)`` between ranks; ``vertices(v)`` or, to generate
    group by group, ``vertices(v, grp)``: labels then only meet labels of hubs of
    the same group, and the result is a superset that ``clean`` reduces.
    """
    found, _ = generate_by_hub(spark, edges, vertices, k, with_group)
    if not with_group or "grp" in found.columns:
        return found
    groups = (vertices if "grp" in vertices.columns else vertices.withColumn("grp", F.lit(0))).select(F.col("v").cast("int").alias("hub"), F.col("grp").cast("int").alias("grp"))
    return found.join(groups, "hub").select(*COLUMNS, "grp")


def generate_by_hub(spark: SparkSession, edges: DataFrame, vertices: DataFrame, k: int, with_group: bool = False) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All labels, and what gives those of ``hubs(hub)``: labels read off walks are
    made for these hubs alone, so that nobody has to land all of them."""
    if found := _walked(edges, vertices, k):
        made, sources = found
        of_hubs = lambda hubs: walks.labels(spark, made, sources.join(hubs.select(F.col("hub").alias("s")), "s", "left_semi"), k)
        return walks.labels(spark, made, sources, k), of_hubs
    found = _by_frontier(spark, edges, vertices, k, with_group)
    return found, lambda hubs: found.join(hubs, "hub", "left_semi").select(found.columns)


def generate_by_vertex(spark: SparkSession, edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """v, hub, hop, dist: the labels of ``generate`` from ``vertices(v)``, without
    parents.  Those read off walks are made where their vertex lies and need not be
    shuffled to be taken by vertex."""
    if found := _walked(edges, vertices, k):
        return walks.labels_at(spark, found[0], found[1], k)
    return _by_frontier(spark, edges, vertices, k).select("v", "hub", "hop", "dist")


def of_some(spark: SparkSession, edges: DataFrame, vertices: DataFrame, k: int) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """What gives all labels of given vertices ``ends(v)``, as v, hub, hop, dist, and
    what gives those of ``hubs(hub)``, with parents.  Labels read off walks are made for
    these alone, from either side; no other label is made."""
    if walked := _walked(edges, vertices, k):
        made, sources = walked

        def some(make: Callable[..., DataFrame], wanted: DataFrame) -> DataFrame:
            wanted = wanted.toDF("s").distinct()
            return make(spark, made, sources.join(wanted, "s", "left_semi"), k, wanted.count())

        return lambda ends: some(walks.labels_at, ends), lambda hubs: some(walks.labels, hubs)
    found = _by_frontier(spark, edges, vertices, k)
    at = lambda ends: found.join(ends, "v", "left_semi").select("v", "hub", "hop", "dist")
    return at, lambda hubs: found.join(hubs, "hub", "left_semi").select(found.columns)


def _walked(edges: DataFrame, vertices: DataFrame, k: int) -> tuple[walks.Plan, DataFrame] | None:
    """How to walk and the sources, where labels are read off walks."""
    made = walks.plan(edges, k) if k > 0 else None
    if made and made.steps[-1] <= WALKS_PER_ARC * made.n_arcs and (sources := _hubs(vertices, made)) is not None:
        return made, sources
    return None


def _hubs(vertices: DataFrame, made: walks.Plan) -> DataFrame | None:
    """s, low: every vertex and the first of its group, whose hubs' labels only meet
    those of walks over vertices from there on.  None unless the vertices are
    all ranks from 0 on and the groups ranges of them."""
    by = vertices.select(F.col("v").cast("int").alias("s"), (F.col("grp").cast("int") if "grp" in vertices.columns else F.lit(0)).alias("grp"))
    sizes = by.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("d"), F.min("s").alias("low"), F.max("s").alias("high"))
    run = (F.col("n") == F.col("d")) & (F.col("high") - F.col("low") + 1 == F.col("n")) & F.col("grp").isNotNull()
    x = sizes.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.bool_and(run).alias("runs")).first()
    if not x["runs"] or x["low"] != 0 or x["high"] + 1 != x["n"] or made.top > x["high"]:
        return None
    if "grp" not in vertices.columns:
        return by.select("s", F.lit(0).alias("low"))
    return by.join(sizes.select("grp", "low"), "grp").select("s", "low")


def _by_frontier(spark: SparkSession, edges: DataFrame, vertices: DataFrame, k: int, with_group: bool = False) -> DataFrame:
    """``generate`` by extending labels, for any graph and any groups."""
    grouped = "grp" in vertices.columns
    frontier = land(spark, initial(vertices if grouped else vertices.withColumn("grp", F.lit(0))), "hop0")
    labels = frontier
    for hop in range(1, k + 1):
        found = expand(frontier, edges, hop)
        frontier = land(spark, uncovered(found, labels, hop).select(*COLUMNS, "grp"), f"hop{hop}", narrow=True)
        if frontier.isEmpty():
            break
        labels = labels.unionByName(frontier)
    return labels if with_group else labels.select(*COLUMNS)


def clean(labels: DataFrame) -> DataFrame:
    """The minimal index from any superset of it that ``generate`` returns.

    A label (v, hub, h, d) goes when its hub has a label (hub, mid, i, e) with
    0 < i < h and v a label of mid of at most h - i hops and d - e, or when v has
    a label of the same hub with fewer hops and at most d.

    One of the two halves of such a way has at most half of all hops.  These short
    labels are broadcast where they are few, and every label meets those of its own
    hub: on the vertex's side with v dealt out, then on the hub's.
    """
    sizes = {r["hop"]: r["count"] for r in labels.groupBy("hop").count().collect()}
    k, n = max(sizes, default=0), sum(sizes.values())
    if k < 1 or sum(m for hop, m in sizes.items() if 0 < hop <= k // 2) > MOST_SHORT:
        return _clean_by_joins(labels)
    short = labels.where((F.col("hop") > 0) & (F.col("hop") <= k // 2))
    x = F.struct(F.col("v").alias("y"), F.col("hop").alias("i"), F.col("dist").alias("e"))
    lists = short.groupBy(F.col("hub").alias("key")).agg(F.concat(F.array(_stay()), F.collect_list(x)).alias("list"))
    tasks = max(labels.sparkSession.sparkContext.defaultParallelism, n // LABELS_A_TASK + 1)
    real = labels.where("hop > 0")
    rows = lambda df, x, y, half, check: df.select(F.col(x).alias("x"), F.col(y).alias("y"), "hop", "dist", "parent", F.lit(half).alias("half"), F.lit(check).alias("check"))
    one = _unreplaced(rows(real, "v", "hub", True, True), lists, k, tasks, F.col("a.y") < F.col("x"))
    one = one.select(F.col("x").alias("v"), F.col("y").alias("hub"), "hop", "dist", "parent")
    # Labels of k hops, most of all, are half of no way.
    both = rows(one, "hub", "v", False, True).unionByName(rows(real.where(F.col("hop") < k), "v", "hub", True, False))
    two = _unreplaced(both, lists, k, tasks, F.col("a.y") > F.col("x"))
    own = labels.where("hop = 0").select("v", "hub", "hop", "dist", "parent").distinct()
    return own.unionByName(two.select(F.col("y").alias("v"), F.col("x").alias("hub"), "hop", "dist", "parent"))


def _stay() -> Column:
    return F.struct(F.lit(-1).alias("y"), F.lit(0).alias("i"), F.lit(0).alias("e"))


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` by x, written as three numbers and not as seven."""
    half, check, long = F.col("half").cast("int"), F.col("check").cast("int"), lambda c: F.col(c).cast("long")
    kind = F.shiftleft(long("hop"), 2).bitwiseOR(F.shiftleft(half, 1)).bitwiseOR(check)
    out = rows.select("x", F.shiftleft(long("y"), 32).bitwiseOR(kind).alias("p"), F.shiftleft(long("dist"), 32).bitwiseOR(long("parent")).alias("q")).repartition(tasks, "x")
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit(walks.LOW)).cast("int")
    bit = lambda at: F.col("p").bitwiseAND(F.lit(at)) != 0
    hop = F.shiftright(low("p"), 2)
    return out.select("x", high("p").alias("y"), hop.alias("hop"), high("q").alias("dist"), low("q").alias("parent"), bit(2).alias("half"), bit(1).alias("check"))


def _unreplaced(rows: DataFrame, lists: DataFrame, k: int, tasks: int, side: Column) -> DataFrame:
    """x, y, hop, dist, parent: of ``rows`` to ``check`` those that no ``half``
    (x, mid) with a short label (a.y, mid) of ``lists`` replaces, by hops and
    distance.  All of an x is in one place; what halves reach is not shuffled."""
    a, hop, dist = F.col("a"), F.col("hop"), F.col("dist")
    met = _dealt(rows, tasks).join(F.broadcast(lists), F.when(F.col("half") & (hop < k), F.col("y")) == F.col("key"), "left")
    met = met.select("x", "y", "hop", "dist", "parent", "check", F.explode(F.coalesce("list", F.array(_stay()))).alias("a"))
    mine = a["y"] == -1
    met = met.where((mine & F.col("check")) | (~mine & side & (hop + a["i"] <= k)))
    met = met.select("x", F.when(mine, F.col("y")).otherwise(a["y"]).alias("y"), (hop + a["i"]).alias("hop"), (dist + a["e"]).alias("dist"), "parent", mine.alias("mine"))
    label = F.shiftleft(dist.cast("long"), 32).bitwiseOR(F.col("parent").cast("long"))
    least = [F.min(F.when(F.col("mine") & (hop == h), label)).alias(f"l{h}") for h in range(1, k + 1)]
    least += [F.min(F.when(~F.col("mine") & (hop <= h), dist)).alias(f"c{h}") for h in range(1, k + 1)]
    best = met.groupBy("x", "y").agg(*least)
    far = lambda c: F.coalesce(c.cast("long"), F.lit(1 << 40))
    found = []
    for h in range(1, k + 1):
        d = F.shiftright(f"l{h}", 32)
        open_ = F.col(f"l{h}").isNotNull() & (far(F.col(f"c{h}")) > d)
        for i in range(1, h):
            open_ &= far(F.shiftright(f"l{i}", 32)) > d
        found.append(F.when(open_, F.struct(F.lit(h).alias("hop"), d.cast("int").alias("dist"), F.col(f"l{h}").bitwiseAND(F.lit(walks.LOW)).cast("int").alias("parent"))))
    return best.select("x", "y", F.explode(F.array(*found)).alias("z")).where("z IS NOT NULL").select("x", "y", "z.hop", "z.dist", "z.parent")


def _clean_by_joins(labels: DataFrame) -> DataFrame:
    """``clean`` by joins, for any number of short labels."""
    a = labels.select(F.col("v").alias("av"), F.col("hub").alias("ahub"), F.col("hop").alias("ah"), F.col("dist").alias("ad")).distinct()
    b = labels.where("hop > 0").select(F.col("v").alias("bv"), F.col("hub").alias("mid"), F.col("hop").alias("bh"), F.col("dist").alias("bd")).distinct()
    real = labels.where("hop > 0").select("v", "hub", "hop", "dist")
    same = real.join(a, (F.col("v") == F.col("av")) & (F.col("hub") == F.col("ahub")) & (F.col("ah") < F.col("hop")) & (F.col("ad") <= F.col("dist")), "left_semi")
    half = real.join(b, (F.col("hub") == F.col("bv")) & (F.col("bh") < F.col("hop")) & (F.col("bd") <= F.col("dist")))
    over = half.join(
        a, (F.col("v") == F.col("av")) & (F.col("mid") == F.col("ahub")) & (F.col("ah") <= F.col("hop") - F.col("bh")) & (F.col("ad") + F.col("bd") <= F.col("dist")), "left_semi"
    ).select("v", "hub", "hop", "dist")
    gone = same.unionByName(over).select("v", "hub", "hop").distinct()
    kept = labels.join(gone, ["v", "hub", "hop"], "left_anti")
    return kept.groupBy("v", "hub", "hop").agg(F.min(F.struct("dist", "parent")).alias("x")).select("v", "hub", "hop", "x.dist", "x.parent")


def prefix_minimum(labels: DataFrame, k: int) -> DataFrame:
    """v, hub, hop_le, dist: the least distance with at most ``hop_le`` hops, for
    every bound from the label's own up to ``k``."""
    until = F.coalesce(F.lead("hop").over(Window.partitionBy("v", "hub").orderBy("hop")) - 1, F.lit(k))
    best = F.min("dist").over(Window.partitionBy("v", "hub").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0))
    rows = labels.where(F.col("hop") <= k).select("v", "hub", "hop", best.alias("dist"), until.alias("until"))
    return rows.select("v", "hub", F.explode(F.sequence("hop", "until")).alias("hop_le"), "dist")


def per_vertex(labels: DataFrame, fields: tuple[str, ...] = ("hub", "hop", "dist", "parent"), placed: bool = False) -> DataFrame:
    """v, list: each vertex's labels sorted by hub, hop, distance.  Rows are dealt
    out before they are collected, as short lists take more room than rows; those
    that lie by vertex (``generate_by_vertex``) stay, given ``placed``."""
    rows = labels.select("v", *fields)
    return (rows if placed else rows.repartition("v")).groupBy("v").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("list"))
