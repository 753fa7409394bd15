"""Walks dealt out by their source against the methods for any graph."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hopweave import catalog
from hopweave.operators import exact, graph, labels, partitioning, query, verify, walks
from hopweave.plans import tables


def ranks(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("v"))


def arcs(spark, seed, n, m, heaviest):
    rng = random.Random(seed)
    rows = [(a, b, rng.randint(1, heaviest)) for a, b in rng.sample([(a, b) for a in range(n) for b in range(a)], m)]
    return graph.symmetric(spark.createDataFrame(rows, "src int, dst int, weight int"))


def exchanges_of_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(\w+#\d+, \w+#\d+.*", plan)


@pytest.mark.parametrize("k", [1, 3, 4])
def test_hop_distances_write_no_steps_and_equal_layers(spark, k):
    e = tables.land(spark, arcs(spark, 5, 40, 90, 4), "arcs")
    sources = ranks(spark, 42).withColumnRenamed("v", "s")
    before = list(tables.LANDED)
    got = exact.hop_distances(spark, e, sources, k)
    assert tables.LANDED == before
    slow = exact.layers(spark, e, sources, k).groupBy("s", F.col("v").alias("t")).agg(F.min("dist").alias("dist"))
    assert got.columns == ["s", "t", "dist"] and got.dtypes == slow.dtypes
    assert sorted(got.collect()) == sorted(slow.collect())
    assert not exchanges_of_pairs(got)


@pytest.mark.parametrize("seed,heaviest,ranges", [(1, 2, None), (2, 20, None), (3, 3, 5), (4, 1, 3)])
def test_labels_of_walks_equal_those_by_frontier(spark, seed, heaviest, ranges):
    e = tables.land(spark, arcs(spark, seed, 40, 100, heaviest), "arcs")
    v = ranks(spark, 41)
    if ranges:
        v = partitioning.by_range(v.withColumnRenamed("v", "rank"), ranges)
    before = list(tables.LANDED)
    got = labels.generate(spark, e, v, 4)
    assert tables.LANDED == before  # no hop is landed
    assert sorted(got.collect()) == sorted(labels._by_frontier(spark, e, v, 4).collect())


def test_other_vertices_groups_and_weights_take_the_general_method(spark):
    e = tables.land(spark, arcs(spark, 6, 12, 30, 4), "arcs")
    mixed = ranks(spark, 12).withColumn("grp", F.col("v") % 3)
    for v in (mixed, ranks(spark, 12).where("v > 2")):
        assert sorted(labels.generate(spark, e, v, 3).collect()) == sorted(labels._by_frontier(spark, e, v, 3).collect())
    for weight in (0, -1, 2_000_000_000):
        assert walks.plan(e.withColumn("weight", F.lit(weight)), 3) is None
    assert walks.plan(e.limit(0), 3) is None


def test_queries_join_only_labels_they_need(spark):
    e = tables.land(spark, arcs(spark, 7, 40, 100, 4), "arcs")
    made = tables.land(spark, labels.generate(spark, e, ranks(spark, 40), 3), "index")
    asked = spark.createDataFrame([(0, 3, 9, 3), (1, 30, 31, 2)], "qid long, s int, t int, h int")
    for given in (None, e):
        steps = query.paths(spark, asked, made, 3, given)
        path = next(p for p in reversed(tables.LANDED) if "/path-labels-" in p)
        hubs = [r.hub for r in query.meetings(asked, made, 3).select("best.hub").distinct().collect()]
        assert sorted(spark.read.parquet(path).select(*made.columns).collect()) == sorted(made.where(F.col("hub").isin(hubs)).collect())
        weights = {r.qid: r.path_weight for r in query.path_check(asked, steps, e).collect()}
        truth = {r.qid: r.distance for r in exact.distances(spark, asked, e, 3).collect()}
        assert weights == truth == {r.qid: r.distance for r in query.distances(asked, made, 3).collect()}


@pytest.mark.parametrize("seed,heaviest,k", [(8, 3, 4), (9, 20, 3), (10, 1, 5), (11, 4, 1)])
def test_clean_meets_short_labels_and_shuffles_none_of_what_they_reach(spark, seed, heaviest, k):
    e = tables.land(spark, arcs(spark, seed, 40, 90, heaviest), "arcs")
    groups = ranks(spark, 40).withColumn("grp", F.col("v") % 4)
    superset = tables.land(spark, labels.generate(spark, e, groups, k), "superset")
    got = labels.clean(superset)
    want = sorted(labels.generate(spark, e, ranks(spark, 40), k).collect())
    assert sorted(got.collect()) == want == sorted(labels._clean_by_joins(superset).collect())
    assert not exchanges_of_pairs(got.where("hop > 0"))


def test_prefix_minimum_takes_labels_where_their_hub_lies(spark):
    e = tables.land(spark, arcs(spark, 12, 40, 100, 4), "arcs")
    made = labels.generate(spark, e, ranks(spark, 41), 3)
    got = labels.prefix_minimum(made, 3)
    assert not exchanges_of_pairs(got)
    least = {}
    for r in labels._by_frontier(spark, e, ranks(spark, 41), 3).collect():
        for h in range(r.hop, 4):
            least[r.v, r.hub, h] = min(r.dist, least.get((r.v, r.hub, h), r.dist))
    assert sorted(got.collect()) == sorted((*key, d) for key, d in least.items())


@pytest.mark.parametrize("query_of", [catalog.query_path_check, catalog.query_path_parentless, catalog.verify_mismatches])
def test_paths_and_checks_land_no_index(spark, sf, query_of):
    before = set(tables.LANDED)
    query_of(spark, sf).collect()
    made = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(tables.LANDED) - before}
    assert "end-labels" in made and "index" not in made


@pytest.mark.parametrize("walked", [True, False])
def test_labels_of_given_hubs_and_paths_over_them(spark, monkeypatch, walked):
    if not walked:
        monkeypatch.setattr(labels, "WALKS_PER_ARC", 0)
    e = tables.land(spark, arcs(spark, 13, 40, 100, 4), "arcs")
    made, of_hubs = labels.generate_by_hub(spark, e, ranks(spark, 40), 3)
    some = spark.createDataFrame([(2,), (17,), (99,)], "hub int")
    assert sorted(of_hubs(some).select(made.columns).collect()) == sorted(made.where("hub IN (2, 17)").collect())
    asked = spark.createDataFrame([(i, i * 7 % 40, i * 13 % 40, i % 4) for i in range(40)], "qid long, s int, t int, h int")
    ends = tables.land(spark, query.at_ends(asked, made, 3), "end-labels")
    x = verify.mismatches(spark, asked, ends, e, 3, of_hubs).first()
    assert (x.n_queries, x.n_distance, x.n_path) == (40, 0, 0)
    whole = [sorted(query.paths(spark, asked, made, 3, given).collect()) for given in (None, e)]
    assert whole == [sorted(query.paths(spark, asked, ends, 3, given, of_hubs).collect()) for given in (None, e)]


def partitions_between(df):
    """Exchanges above the walks: none where what is collected stays where it was made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange (hashpartitioning\([^)]*\)[^\n]*)", plan) if "v#" in x or "hub#" in x]


@pytest.mark.parametrize("seed,heaviest,k", [(14, 1, 3), (15, 3, 4), (16, 20, 3), (17, 4, 1)])
def test_labels_by_vertex_equal_those_by_frontier_and_lists_shuffle_none(spark, seed, heaviest, k):
    e = tables.land(spark, arcs(spark, seed, 40, 100, heaviest), "arcs")
    one_way = tables.land(spark, e.where("(src * 7 + dst) % 3 != 0"), "arcs")
    for arcs_of in (e, one_way):
        got = labels.generate_by_vertex(spark, arcs_of, ranks(spark, 41), k)
        want = sorted(labels._by_frontier(spark, arcs_of, ranks(spark, 41), k).select(got.columns).collect())
        assert sorted(got.collect()) == want
    lists = labels.per_vertex(labels.generate_by_vertex(spark, e, ranks(spark, 41), k), ("hub", "hop", "dist"), placed=True)
    assert not partitions_between(lists)
    by_v = {}
    for r in sorted(labels.generate_by_vertex(spark, e, ranks(spark, 41), k).collect()):
        by_v.setdefault(r.v, []).append((r.hub, r.hop, r.dist))
    assert {r.v: [tuple(x) for x in r.list] for r in lists.collect()} == by_v


def test_sorted_labels_are_not_shuffled(spark, sf):
    assert not partitions_between(catalog.labels_sorted(spark, sf))


@pytest.mark.parametrize("walked", [True, False])
def test_labels_of_given_vertices_alone(spark, monkeypatch, walked):
    if not walked:
        monkeypatch.setattr(labels, "WALKS_PER_ARC", 0)
    e = tables.land(spark, arcs(spark, 18, 40, 100, 4), "arcs")
    whole = tables.land(spark, labels._by_frontier(spark, e, ranks(spark, 41), 3), "index")
    of_ends, of_hubs = labels.of_some(spark, e, ranks(spark, 41), 3)
    some = spark.createDataFrame([(3,), (40,), (3,), (99,), (31,)], "v int")
    assert sorted(of_ends(some).collect()) == sorted(whole.where("v IN (3, 31, 40)").select("v", "hub", "hop", "dist").collect())
    assert sorted(of_hubs(some.toDF("hub")).select(whole.columns).collect()) == sorted(whole.where("hub IN (3, 31, 40)").collect())


def walked_from(spark, sf, monkeypatch, query_of):
    """Whether any walks were made from more vertices than two queries' ends and hubs."""
    asked = spark.createDataFrame([(0, 3, 14, 3), (1, 9, 14, 2)], "qid long, s int, t int, h int")
    monkeypatch.setattr(catalog, "batch", lambda *_: asked)
    dealt, most = walks.dealt, []
    monkeypatch.setattr(walks, "dealt", lambda spark, made, sources, *rest: most.append(sources.count()) or dealt(spark, made, sources, *rest))
    got = query_of(spark, sf).collect()
    return got, most


def test_paths_walk_from_the_queries_ends_and_their_hubs_alone(spark, sf, monkeypatch):
    got, most = walked_from(spark, sf, monkeypatch, catalog.query_path_parentless)
    e = catalog.ranked(spark, catalog.g2(spark, sf))[1]
    truth = {r.qid: r.distance for r in exact.distances(spark, catalog.batch(), e, 3).collect()}
    assert {r.qid: r.path_weight for r in got} == truth
    assert max(most) <= 3  # of 15 vertices


def test_mismatches_walk_from_the_queries_ends_and_their_hubs_alone(spark, sf, monkeypatch):
    got, most = walked_from(spark, sf, monkeypatch, catalog.verify_mismatches)
    assert [(r.n_queries, r.n_distance, r.n_path) for r in got] == [(2, 0, 0)]
    assert max(most) <= 3  # of 15 vertices


def test_clean_deals_out_no_label_that_is_neither_checked_nor_half_of_a_way(spark, monkeypatch):
    e = tables.land(spark, arcs(spark, 19, 40, 90, 4), "arcs")
    superset = tables.land(spark, labels.generate(spark, e, ranks(spark, 40).withColumn("grp", F.col("v") % 4), 3), "superset")
    unreplaced, dealt = labels._unreplaced, []
    monkeypatch.setattr(labels, "_unreplaced", lambda rows, *rest: dealt.append(rows) or unreplaced(rows, *rest))
    got = labels.clean(superset)
    assert sorted(got.collect()) == sorted(labels.generate(spark, e, ranks(spark, 40), 3).collect())
    assert len(dealt) == 2
    for rows in dealt:
        assert rows.where("NOT check AND hop = 3").isEmpty() and not rows.where("hop = 3").isEmpty()
    assert "AS p#" in got._jdf.queryExecution().executedPlan().toString()  # packed before they are dealt out


@pytest.mark.parametrize("query_of", [catalog.label_pack_unpack, catalog.labels_generate_grouped])
def test_labels_read_once_are_neither_landed_nor_shuffled(spark, sf, query_of):
    before = set(tables.LANDED)
    got = query_of(spark, sf)
    got.collect()
    made = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(tables.LANDED) - before}
    assert made == {"g2", "numbered", "ranks", "ranked"}
    assert not exchanges_of_pairs(got) and not partitions_between(got)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4])
def test_exact_distances_join_halves_of_walks_and_equal_whole_ones(spark, monkeypatch, k):
    both = arcs(spark, 23, 30, 60, 3)
    loops = spark.createDataFrame([(0, 3, 1), (3, 3, 1), (5, 1, 2)], "src int, dst int, weight int")
    asked = spark.range(900).selectExpr("id AS qid", "CAST(id DIV 30 AS INT) AS s", "CAST(id % 30 AS INT) AS t", "CAST(id % 7 AS INT) - 1 AS h")
    for e in (both, both.where("src < dst").unionByName(loops)):
        e = tables.land(spark, e, "arcs")
        reach, layers = [], exact.layers
        with monkeypatch.context() as m:
            m.setattr(exact, "layers", lambda spark, edges, sources, k: reach.append(k) or layers(spark, edges, sources, k))
            got = exact.distances(spark, asked, e, k).collect()
        assert reach == [(k + 1) // 2, k // 2]  # no walk of all k edges is landed
        best = {}
        for r in layers(spark, e, asked.select("s"), k).collect():
            best.setdefault((r.s, r.v), []).append((r.dist, r.hop))
        for r in got:
            dist, hops = min((x for x in best.get((r.s, r.t), []) if x[1] <= r.h), default=(query.UNREACHABLE, 0))
            if r.h == 0 or r.s == r.t:
                dist = 0 if r.s == r.t and r.h >= 0 else query.UNREACHABLE
            assert (r.distance, r.hops) == (dist, hops)
        assert len(got) == 900
