"""Small random graphs against plain Python, and the edge cases of files."""

import random

import pytest
from pyspark.sql import functions as F

from hopweave.operators import exact, graph, labels, partitioning, query, ranking, traversal, verify
from hopweave.sources import edge_lists

UNREACHABLE = query.UNREACHABLE


def random_edges(rng, n, m):
    pairs = rng.sample([(a, b) for a in range(n) for b in range(a)], m)
    return {(a, b): rng.randint(1, 6) for a, b in pairs}


def table(spark, pairs):
    rows = [(a, b, w) for (a, b), w in pairs.items()]
    return graph.symmetric(spark.createDataFrame(rows, "src int, dst int, weight int"))


def walks(n, pairs, k):
    """d[h][s][t]: least weight with at most h edges."""
    arcs = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    d = [{s: {s: 0} for s in range(n)}]
    for _ in range(k):
        after = {s: dict(x) for s, x in d[-1].items()}
        for s in range(n):
            for a, b, w in arcs:
                if a in d[-1][s]:
                    after[s][b] = min(after[s].get(b, UNREACHABLE), d[-1][s][a] + w)
        d.append(after)
    return d


def canonical(n, d, k):
    out = {(v, v, 0, 0) for v in range(n)}
    for h in range(1, k + 1):
        for hub in range(n):
            for v, w in d[h][hub].items():
                if hub < v and w < d[h - 1][hub].get(v, UNREACHABLE):
                    better = any(d[i][hub].get(mid, UNREACHABLE) + d[h - i][mid].get(v, UNREACHABLE) <= w for mid in range(hub) for i in range(1, h))
                    if not better:
                        out.add((v, hub, h, w))
    return out


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 2)])
def test_index_is_canonical_and_answers_all_queries(spark, seed, k):
    rng = random.Random(seed)
    n = 9
    pairs = random_edges(rng, n, 14)
    edges = table(spark, pairs)
    vertices = spark.range(n).select(F.col("id").cast("int").alias("v"))
    d = walks(n, pairs, k)
    made = labels.generate(spark, edges, vertices, k)
    want = canonical(n, d, k)
    assert {(r.v, r.hub, r.hop, r.dist) for r in made.collect()} == want
    grouped = vertices.withColumn("grp", F.col("v") % 3)
    superset = labels.generate(spark, edges, grouped, k)
    assert want <= {(r.v, r.hub, r.hop, r.dist) for r in superset.collect()}
    assert {(r.v, r.hub, r.hop, r.dist) for r in labels.clean(superset).collect()} == want
    rows = [(i, s, t, h) for i, (s, t, h) in enumerate((s, t, h) for s in range(n) for t in range(n) for h in range(-1, k + 2))]
    q = spark.createDataFrame(rows, "qid long, s int, t int, h int")
    got = {r.qid: r.distance for r in query.distances(q, made, k).collect()}
    for qid, s, t, h in rows:
        truth = UNREACHABLE if h < 0 else d[min(h, k)][s].get(t, UNREACHABLE)
        assert got[qid] == truth, (s, t, h)
    for found in (query.paths(spark, q, made, k), query.paths(spark, q, made, k, edges)):
        steps = {}
        for r in found.collect():
            steps.setdefault(r.qid, []).append((r.step, r.a, r.b))
        for qid, s, t, h in rows:
            way = sorted(steps.get(qid, []))
            if s != t and got[qid] != UNREACHABLE:
                assert way[0][1] == s and way[-1][2] == t and len(way) <= min(h, k) and all(x[2] == y[1] for x, y in zip(way, way[1:]))
                assert sum(pairs.get((a, b), pairs.get((b, a))) for _, a, b in way) == got[qid]
            else:
                assert not way
    r = verify.mismatches(spark, q.where("h >= 0"), made, edges, k).first()
    assert (r.n_distance, r.n_path) == (0, 0)


def test_isolated_vertices_large_weights_and_no_edges(spark):
    edges = table(spark, {(1, 0): 900, (2, 1): 900})
    vertices = spark.range(4).select(F.col("id").cast("int").alias("v"))
    made = labels.generate(spark, edges, vertices, 3)
    q = spark.createDataFrame([(0, 0, 2, 2), (1, 0, 3, 3), (2, 3, 3, 0)], "qid long, s int, t int, h int")
    assert [r.distance for r in query.distances(q, made, 3).orderBy("qid").collect()] == [1800, UNREACHABLE, 0]
    empty = spark.createDataFrame([], "src int, dst int, weight int")
    assert labels.generate(spark, empty, vertices, 3).count() == 4
    assert exact.hop_distances(spark, empty, vertices.withColumnRenamed("v", "s"), 2).count() == 4


def test_graph_tables(spark):
    e = table(spark, {(1, 0): 3, (2, 0): 4})
    changed = graph.upsert(e, spark.createDataFrame([(0, 1, 5, 1), (1, 0, 6, 2), (3, 2, 7, 1)], "src int, dst int, weight int, seq int"))
    assert {(r.src, r.dst, r.weight) for r in changed.collect()} == {(0, 1, 6), (1, 0, 6), (2, 0, 4), (0, 2, 4), (2, 3, 7), (3, 2, 7)}
    assert graph.remove(e, spark.createDataFrame([(0, 1), (8, 9)], "src int, dst int")).count() == 2
    assert graph.isolate(e, 0).count() == 0
    assert graph.counts(e).first()[:] == (3, 2, 4)
    assert graph.asymmetric(e).isEmpty()
    ranks = {r.id: r.rank for r in ranking.ranks(spark, e, spark.createDataFrame([(9,)], "v int")).collect()}
    assert ranks == {0: 0, 1: 1, 2: 2, 9: 3}


def test_merge_small_is_best_fit(spark):
    rows = [(v, label, 0) for label, n in ((1, 6), (2, 4), (3, 3), (4, 1)) for v in range(label * 100, label * 100 + n)]
    parts = spark.createDataFrame(rows, "v long, label long, part int")
    merged = partitioning.merge_small(spark, parts, 10)
    sizes = sorted(r["count"] for r in merged.groupBy("grp").count().collect())
    assert sizes == [4, 10]


def test_traversals(spark):
    e = table(spark, {(1, 0): 1, (2, 1): 1, (2, 0): 5, (4, 3): 2})
    assert {r.v: r.dist for r in traversal.bfs(spark, e, 0).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r.v: r.dist for r in traversal.sssp(spark, e, 0).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.v: r.comp for r in traversal.wcc(spark, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert abs(sum(r.score for r in traversal.pagerank(spark, e).collect()) - 1) < 1e-9


def test_edge_list_files(spark, tmp_path):
    (tmp_path / "g.e").write_text("|V| = 5\n|E|= 9\n\n0 1 2.9\n1 0 3\n1 2 4 \n2 3 7\n4 4 1\n")
    e, v = edge_lists.read_edge_list(spark, str(tmp_path / "g.e"))
    assert v.count() == 5
    assert {(r.src, r.dst, r.weight) for r in e.collect()} == {(0, 1, 3), (1, 0, 3), (2, 3, 7), (3, 2, 7), (4, 4, 1)}
    (tmp_path / "t.e").write_text("|V|= 3\nEdge 0 1 2\nnote 1 2 3\nEdge 1 2 5\n")
    assert edge_lists.read_tagged_edges(spark, str(tmp_path / "t.e"))[0].count() == 4
    edge_lists.write_edge_list(e, 5, str(tmp_path / "out.e"))
    back, n = edge_lists.read_edge_list(spark, str(tmp_path / "out.e"))
    assert {(r.src, r.dst, r.weight) for r in back.collect()} == {(0, 1, 3), (1, 0, 3), (2, 3, 7), (3, 2, 7)} and n.count() == 5
    (tmp_path / "q.txt").write_text("0 1 2\n\n3 4 5\nstop\n6 7 8\n")
    assert [tuple(r) for r in edge_lists.read_queries(spark, str(tmp_path / "q.txt")).orderBy("qid").collect()] == [(0, 0, 1, 2), (1, 3, 4, 5)]


def test_config_and_named_graph(spark, tmp_path):
    lines = "# x\n\ngraph.g.vertex-file = g.v\ngraph.g.edge-file = n.e\ngraph.g.directed = false\ngraph.g.algorithms = bfs, pr, sssp, cdlp, wcc\n"
    lines += "graph.g.bfs.source-vertex = 10\ngraph.g.sssp.source-vertex = 9\ngraph.g.pr.damping-factor = 0.9\ngraph.g.sssp.weight-property = weight\ngraph.g.cdlp.max-iterations = 2\nbad line\n"
    (tmp_path / "g.properties").write_text(lines)
    c = edge_lists.read_config(spark, str(tmp_path / "g.properties"))
    assert (c.vertex_file, c.directed, c.bfs_source, c.sssp_source, c.pr_damping, c.sssp_weighted, c.cdlp_iterations) == ("g.v", False, "10", "9", 0.9, True, 2)
    (tmp_path / "g.v").write_text("10\n9\nc\n")
    (tmp_path / "n.e").write_text("10 9 5\nc 9\nnew 10 2.7\n9 10 7\nc c 3\n")
    g = edge_lists.load_named_graph(spark, str(tmp_path / "g.properties"), str(tmp_path))
    assert {r.name: r.id for r in g.names.collect()} == {"10": 0, "9": 1, "c": 2, "new": 3}
    assert {(r.src, r.dst, r.weight) for r in g.arcs.collect()} == {(0, 1, 7), (1, 0, 7), (2, 1, 1), (1, 2, 1), (3, 0, 2), (0, 3, 2), (2, 2, 3)}
    found = edge_lists.run_algorithms(spark, g)
    assert {r.v: r.dist for r in found["bfs"].collect()} == {0: 0, 1: 1, 2: 2, 3: 1}
    assert {r.v: r.dist for r in found["sssp"].collect()} == {1: 0, 2: 1, 0: 7, 3: 9}
    assert found["wcc"].select("comp").distinct().count() == 1 and found["pr"].count() == found["cdlp"].count() == 4
    arcs, _ = edge_lists.read_named_graph(spark, str(tmp_path / "g.v"), str(tmp_path / "n.e"), True)
    assert {(r.src, r.dst, r.weight) for r in arcs.collect()} == {(0, 1, 5), (2, 1, 1), (3, 0, 2), (1, 0, 7), (2, 2, 3)}
    (tmp_path / "g.properties").write_text(lines.replace("= 10", "= new"))
    with pytest.raises(ValueError):
        edge_lists.load_named_graph(spark, str(tmp_path / "g.properties"), str(tmp_path))


def test_run_details(spark, tmp_path):
    edge_lists.write_details(spark, {"upper_k": 5, "time_total": 1.5}, str(tmp_path / "d"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "d")).collect()]
    assert lines[0] == "hop_constrained_case_info:" and "upper_k=5" in lines and "time_total=1.500000" in lines and len(lines) == 16


def test_random_graph(spark):
    e = edge_lists.random_graph(spark, 50, 100)
    assert graph.counts(e).first().m == 100 and e.select("src", "dst").distinct().count() == 200
    assert edge_lists.random_graph(spark, 10, 45).count() == 90
    with pytest.raises(ValueError):
        edge_lists.random_graph(spark, 3, 4)


def test_streamed_queries(spark, tmp_path):
    from hopweave.streaming.live_queries import answer_stream

    edges = table(spark, {(1, 0): 2, (2, 1): 3})
    made = labels.generate(spark, edges, spark.range(3).select(F.col("id").cast("int").alias("v")), 2)
    spark.createDataFrame([(1, 0, 2, 2), (2, 0, 2, 1)], "qid long, s int, t int, h int").write.parquet(str(tmp_path / "in"))
    answer_stream(spark, str(tmp_path / "in"), made, 2, str(tmp_path / "out"), "t")
    assert {r.qid: r.distance for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 5, 2: UNREACHABLE}


def test_command_line_builds_and_checks(spark, tmp_path):
    from hopweave.__main__ import main

    rng = random.Random(6)
    pairs = random_edges(rng, 12, 20)
    (tmp_path / "g.e").write_text("|V| = 13\n\n" + "".join(f"{a} {b} {w}\n" for (a, b), w in pairs.items()))
    (tmp_path / "q.txt").write_text("0 5 3\n2 2 1\n0 12 3\n")
    d = walks(13, pairs, 3)
    made = []
    for name, extra in (("plain", []), ("grouped", ["--g-max", "4"]), ("ranges", ["--ranges", "3"])):
        out = str(tmp_path / name)
        assert main([str(tmp_path / "g.e"), "3", out, "--queries", str(tmp_path / "q.txt"), *extra]) == 0
        made.append({(r.v, r.hub, r.hop, r.dist) for r in spark.read.parquet(f"{out}/labels").collect()})
        assert "labels_after" in spark.read.text(f"{out}/metrics").first()[0]
    assert made[0] == made[1] == made[2]
    out = str(tmp_path / "original")
    assert main([str(tmp_path / "g.e"), "3", out, "--queries", str(tmp_path / "q.txt"), "--ids", "original"]) == 0
    got = [r.distance for r in spark.read.parquet(f"{out}/answers").orderBy("qid").collect()]
    assert got == [d[3][0].get(5, UNREACHABLE), 0, UNREACHABLE]
