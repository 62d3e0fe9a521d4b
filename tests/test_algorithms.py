"""Hand-computed algorithm cases, and kernels against loops."""

import math

import numpy as np
import pytest

from loomgraph import queries
from loomgraph.algorithms import iterative, kernels, registry, similarity
from loomgraph.model import GraphError, PropertyGraph


def pairs(spark, edges):
    return spark.createDataFrame([(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges], "a string, b string, w double")


def got(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


TRIANGLES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]


def test_pagerank_sums_to_one_and_agrees(spark):
    p = pairs(spark, [*TRIANGLES, ("a", "g"), ("a", "b")])
    loop = {r["id"]: r["score"] for r in iterative.pagerank(p, tolerance=1e-9, max_iter=25).collect()}
    kernel = {r["id"]: r["score"] for r in kernels.run_kernel(p, lambda x: kernels.pagerank(x, 0.85, 25, 1e-9), "id string, score double").collect()}
    assert abs(sum(loop.values()) - 1) < 1e-9 and all(abs(loop[k] - kernel[k]) < 1e-9 for k in loop)


def test_ppr_push_bounds(spark):
    p = pairs(spark, [("a", "b", 1.0), ("a", "c", 0.5), ("b", "a"), ("c", "a")])
    k = {r["id"]: r["score"] for r in kernels.run_kernel(p, lambda x: kernels.ppr(x, {"a": 1.0}, epsilon=1e-7), "id string, score double").collect()}
    r = {x["id"]: x["score"] for x in iterative.ppr_rounds(p, {"a": 1.0}, epsilon=1e-7).collect()}
    assert k["b"] / k["c"] == pytest.approx(2.0, rel=1e-3) and k["a"] > k["b"]
    assert all(abs(k[i] - r[i]) < 1e-5 for i in k)


def test_components(spark):
    p = pairs(spark, [("b", "a"), ("b", "c"), ("x", "y"), ("z", "z")])
    want = {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}
    assert got(iterative.components(p), "id", "component") == want
    assert got(kernels.run_kernel(p, kernels.components, "id string, component string"), "id", "component") == want
    assert [r["size"] for r in iterative.component_list(iterative.components(p)).collect()] == [3, 2, 1]


def test_communities_kernel_equals_loop(spark):
    p = pairs(spark, TRIANGLES)
    loop = got(iterative.label_propagation(p), "id", "community")
    assert loop == got(kernels.run_kernel(p, kernels.label_propagation, "id string, community int"), "id", "community")


def test_leiden_finds_triangles_and_is_connected(spark):
    import pandas as pd

    out = kernels.leiden(pd.DataFrame(TRIANGLES, columns=["a", "b"]))
    c = dict(zip(out["id"], out["community"]))
    assert c["a"] == c["b"] == c["c"] != c["d"] == c["e"] == c["f"]
    rng = np.random.default_rng(3)
    e = pd.DataFrame([(f"n{i:02d}", f"n{j:02d}") for i, j in rng.integers(0, 40, (90, 2)) if i != j], columns=["a", "b"])
    label = dict(zip(*(kernels.leiden(e, seed=s)[k] for k in ("id", "community")))) if (s := 7) else {}
    for k in set(label.values()):
        inside = e[(e["a"].map(label) == k) & (e["b"].map(label) == k)]
        members = [x for x in label if label[x] == k]
        assert len(members) == 1 or kernels.components(inside)["component"].nunique() == 1 and len(kernels.components(inside)) == len(members)


def test_modularity(spark):
    p = pairs(spark, TRIANGLES)
    l = spark.createDataFrame([(x, int(x > "c")) for x in "abcdef"], "id string, community int")
    assert iterative.modularity(p, l).first()[0] == pytest.approx(2 * (6 / 14 - (7 / 14) ** 2))


def test_betweenness_of_a_path(spark):
    p = pairs(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert got(kernels.betweenness(p), "id", "score") == {("a", 0.0), ("b", 3.0), ("c", 4.0), ("d", 3.0), ("e", 0.0)}
    assert got(kernels.betweenness(p, sample_size=5), "id", "score") == got(kernels.betweenness(p), "id", "score")
    assert len(kernels.sample_pivots(10, 4, 1)) == 4 == len(set(kernels.sample_pivots(10, 4, 1)))


def _pair_counts(edges):
    """Betweenness by counting the shortest paths of all pairs."""
    nodes = sorted({v for e in edges for v in e})
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} - {v} for v in nodes}
    dist, ways = {}, {}
    for s in nodes:
        dist[s, s], ways[s, s], line = 0, 1, [s]
        for v in line:
            for u in near[v]:
                if (s, u) not in dist:
                    dist[s, u], ways[s, u] = dist[s, v] + 1, 0
                    line.append(u)
                if dist[s, u] == dist[s, v] + 1:
                    ways[s, u] += ways[s, v]
    on = lambda s, v, t: (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t]
    return {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s, t in dist if s < t and v not in (s, t) and on(s, v, t)) for v in nodes}


@pytest.mark.parametrize("fold_edges", [0, 100_000])
def test_betweenness_of_trees_and_cycles(spark, monkeypatch, fold_edges):
    monkeypatch.setattr(kernels, "FOLD_EDGES", fold_edges, raising=False)
    rng = np.random.default_rng(7)
    tree = [(f"t{int(rng.integers(0, k)):02d}", f"t{k:02d}") for k in range(1, 25)]
    edges = [*tree, ("t03", "t17"), ("t17", "t03"), ("t05", "t20"), ("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("x", "y"), ("y", "x"), ("z", "z"), ("q1", "q2"), ("q2", "q3"), ("q3", "q4"), ("q4", "q1"), ("q1", "r1"), ("r1", "r2")]
    got = {r["id"]: r["score"] for r in kernels.betweenness(pairs(spark, edges)).collect()}
    assert got == pytest.approx(_pair_counts(edges))


def test_betweenness_of_a_large_star_searches_nothing(spark, monkeypatch):
    monkeypatch.setattr(kernels, "brandes", None)
    n = 130_000
    p = spark.range(n).selectExpr("'leaf' || id AS a", "'hub' || id % 2 AS b", "1.0D AS w").unionByName(pairs(spark, [("hub0", "top"), ("hub1", "top")]))
    scores = kernels.betweenness(p).filter("score > 0")
    half = n // 2
    assert got(scores, "id", "score") == {("top", float((half + 1) ** 2)), *((f"hub{k}", float(half * (half - 1) // 2 + half * (half + 2))) for k in (0, 1))}


def test_cut_points(spark):
    p = pairs(spark, [*TRIANGLES, ("f", "g"), ("g", "f"), ("z", "z")])
    out = got(kernels.per_component(p, kernels.cut_points, "kind string, a string, b string"), "kind", "a", "b")
    assert out == {("articulation", "c", None), ("articulation", "d", None), ("articulation", "f", None), ("bridge", "c", "d")}


def test_strong_components_and_orders(spark):
    p = pairs(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    scc = kernels.run_kernel(p, kernels.strong_components, "id string, component int")
    assert got(scc, "id", "component") == {("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 2)}
    assert got(kernels.condensation(p, scc), "a", "b") == {(0, 1), (1, 2)}
    assert [r["component"] for r in kernels.condensation_order(p, scc).orderBy("position").collect()] == [0, 1, 2]
    q = pairs(spark, [("b", "d"), ("a", "d"), ("d", "c")])
    assert [r["id"] for r in kernels.run_kernel(q, kernels.topological_sort, "position int, id string").orderBy("position").collect()] == ["a", "b", "d", "c"]
    assert got(iterative.topological_levels(q), "id", "level") == {("a", 0), ("b", 0), ("d", 1), ("c", 2)}
    with pytest.raises(ValueError):
        iterative.topological_levels(p)


def test_similarity_and_links(spark):
    p = pairs(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "z")])
    out = {(r["node1"], r["node2"]): r["similarity"] for r in similarity.node_similarity(p).collect()}
    assert out["a", "b"] == out["b", "a"] == pytest.approx(2 / 3) and ("a", "c") not in out
    assert {(r["node1"], r["node2"]): r["similarity"] for r in similarity.node_similarity(p, "overlap").collect()}["a", "b"] == 1.0
    w = spark.createDataFrame([("a", "b"), ("a", "c"), ("q", "r")], "node1 string, node2 string")
    r = {(x["node1"], x["node2"]): x for x in similarity.link_prediction(p, w).collect()}
    assert r["a", "b"]["common_neighbors"] == 2 and r["a", "b"]["adamic_adar"] == pytest.approx(2 / math.log(2)) and r["a", "b"]["resource_allocation"] == pytest.approx(1.0)
    assert r["q", "r"]["common_neighbors"] == 0


def test_dijkstra_kernel(spark):
    import pandas as pd

    e = pd.DataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5)], columns=["a", "b", "w"])
    assert kernels.dijkstra(e, "a", "c")["id"].tolist() == ["a", "b", "c"]
    assert kernels.dijkstra(e, "a", "c", 1)["id"].tolist() == [] or kernels.dijkstra(e, "a", "c", 1)["id"].tolist() == ["a", "c"]


def test_morphology(spark):
    n = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "id string, features array<double>")
    e = spark.createDataFrame([("a", "b", "Touched_To"), ("a", "c", "FACED_TO"), ("b", "a", "other")], "a string, b string, type string")
    out = {r["id"]: r["features"] for r in iterative.morphology_pass(n, e).collect()}
    assert out == {"a": [1.0, 0.0], "b": [0.5, 1.0], "c": [1.0, 0.0]}
    seg = spark.createDataFrame([("s", "p", "q"), ("t", "q", "r"), ("u", "x", "y")], "id string, a string, b string")
    assert got(iterative.dual_graph(seg), "a", "b") == {("s", "t"), ("t", "s")}


def test_dual_graph_gives_each_pair_once_without_dealing_pairs(spark):
    lines = [("p", 1, 2), ("q", 2, 1), ("r", 1, 2), ("s", 2, None), ("t", 5, 5), ("u", None, 5), ("v", None, None)]
    for rows in (lines, [*lines, ("r", 1, 2), ("u", 7, 1), ("t", 7, 7), (None, 1, 2)]):
        ends = {k: {x for i, *ab in rows if i == k for x in ab if x is not None} for k, *_ in rows if k}
        dual = iterative.dual_graph(spark.createDataFrame(rows, "id string, a long, b long"))
        assert sorted(map(tuple, dual.collect())) == sorted((x, y) for x in ends for y in ends if x != y and ends[x] & ends[y])
        plan = dual._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]  # nothing above the join


def test_registry(spark):
    g = PropertyGraph.local(spark, [{"id": x, "labels": ["N"], "properties": {"k": 1}} for x in "abc"], [{"from_id": "a", "to_id": "b", "type": "T"}, {"from_id": "b", "to_id": "c", "type": "T"}])
    assert registry.call(g, "pagerank", top_k=1).first()["id"] == "c"
    assert registry.call(g, "pagerank", "stats").first()["sum"] == pytest.approx(1.0)
    assert registry.call(g, "pagerank", "estimate")["edge_count"] == 2
    out = registry.call(g, "components", "mutate", property="comp")
    assert {r["prop_tokens"]["comp"] for r in out.live_nodes.collect()} == {"str:a"}
    for bad in (("pagerank", "fly", {}), ("ppr", "stream", {}), ("pagerank", "stream", {"x": 1}), ("nope", "stream", {})):
        with pytest.raises(GraphError):
            registry.call(g, bad[0], bad[1], **bad[2])
    assert {"pagerank", "leiden", "ppr"} <= {o["name"] for o in registry.catalog()}
    assert [r["id"] for r in registry.call(g, "shortest_path", source="a", target="c").orderBy("step").collect()] == ["a", "b", "c"]


def test_personalised_pagerank_beyond_the_kernel(spark, monkeypatch):
    p = pairs(spark, [("a", "b", 1.0), ("a", "c", 0.5), ("b", "a"), ("c", "a"), ("c", "d")])
    kernel = {r["id"]: r["score"] for r in kernels.personalised(p, {"a": 1.0, "x": 1.0}, epsilon=1e-7).collect()}
    loop = {r["id"]: r["score"] for r in kernels.personalised(p, {"a": 1.0, "x": 1.0}, epsilon=1e-7, limit=3).collect()}
    assert set(kernel) == set(loop) == {"a", "b", "c", "d", "x"} and all(abs(kernel[i] - loop[i]) < 1e-5 for i in "abcx")
    monkeypatch.setattr(kernels, "KERNEL_EDGES", 3)
    none = spark.createDataFrame([], "id string, labels array<string>, properties string")
    g = PropertyGraph.of(none, spark.createDataFrame([(f"e{k}", x, y, "T") for k, (x, y) in enumerate(TRIANGLES)], "id string, from_id string, to_id string, type string"))
    assert registry.call(g, "ppr", seeds={"a": 1.0}).count() == 6
    assert got(registry.call(g, "scc"), "id", "component") == {*((v, 0) for v in "abc"), *((v, 1) for v in "def")}


def test_strong_components_loop_equals_kernel(spark):
    rng = np.random.default_rng(4)
    p = pairs(spark, [(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, 40, (55, 2))] + [("z1", "z2"), ("z2", "z3")])
    want = {tuple(r) for r in kernels.strong_components(p.toPandas()).itertuples(index=False)}
    assert got(iterative.strong_components(p), "id", "component") == want


def test_queries_over_whole_tables(spark, tmp_path):
    """Long conversations, late orders, high nations."""
    last = {1: 3, 40: 2, 250: 4, 251: 0}
    spark.createDataFrame([(c, t, "user", "x") for c, n in last.items() for t in range(n + 1)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = [(10, 1, 1, 5), (10, 2, 2, 6), (9000, 1, 1, 6), (9000, 2, 3, 7), (9001, 1, 3, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nations = [(k, k * 7 % 25) for k in range(60)]
    spark.createDataFrame(nations, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    turn = lambda c, t: f"turn:{c:08d}:{t:04d}"
    turns = [(c, t, n) for c, n in last.items() if n for t in range(n + 1)]
    assert got(run("topological_levels"), "id", "level") == {(turn(c, t), t) for c, t, _ in turns}
    assert got(run("betweenness"), "id", "score") == {(turn(c, t), float(t * (n - t))) for c, t, n in turns}
    assert got(run("cut_points"), "kind", "a") == {("articulation", turn(c, t)) for c, t, n in turns if 0 < t < n} | {("bridge", turn(c, t)) for c, t, n in turns if t < n}
    assert {r["id"] for r in run("leiden").collect()} == {turn(c, t) for c, t, _ in turns}
    assert got(run("morphology_dual"), "a", "b") == {(f"{x[0]}/{x[1]}", f"{y[0]}/{y[1]}") for x in lines for y in lines if x[:2] != y[:2] and (x[0] == y[0] or x[3] == y[3])}
    parts = {s: {l[3] for l in lines if l[2] == s} for s in (1, 2, 3)}
    want = {(f"supplier:{s}", f"supplier:{t}", round(len(parts[s] & parts[t]) / len(parts[s] | parts[t]), 6)) for s in parts for t in parts if s != t and parts[s] & parts[t]}
    assert got(run("node_similarity"), "node1", "node2", "similarity") == want
    ends = [x for k, n in nations for x in (k % 4, n % 4)]
    inner = sum(2 * (k % 4 == n % 4) for k, n in nations)
    assert run("modularity").first()[0] == pytest.approx(inner / len(ends) - sum((ends.count(c) / len(ends)) ** 2 for c in range(4)), abs=1e-8)
