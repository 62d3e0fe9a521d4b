"""Stored indexes, plug-ins, resident graphs, numbering, logs of queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.algorithms import kernels, registry
from loomgraph.iterate import first_rows, numbered
from loomgraph.model import GraphError, PropertyGraph
from loomgraph.operators import commands, fulltext, memory, spatial, vector
from loomgraph.sources import readers, store
from loomgraph.streaming import cache, observe, rooms
from loomgraph.versioning import crdt, snapshot


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_numbering_and_long_reports(spark):
    values = random.Random(0).sample(range(1000), 500)
    df = spark.createDataFrame([(v % 7, v) for v in values], "a int, b int").repartition(5)
    got = {(r["a"], r["b"]): r["_n"] for r in numbered(df, "a", F.desc("b")).collect()}
    assert got == {x: k + 1 for k, x in enumerate(sorted(got, key=lambda x: (x[0], -x[1])))}
    assert numbered(df.limit(0), "a").count() == 0
    long = spark.range(100_300).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("x"), "id").orderBy("x", "id")
    want = [tuple(r) for r in long.collect()][3:100_103]
    assert [tuple(r) for r in first_rows(long, 100_100, 3).collect()] == want


def test_postings_upsert_and_remove(spark):
    docs = [("a", "red fox red"), ("b", "blue fox"), ("c", "red whale the the"), ("d", ""), ("e", None)]
    df = lambda x: spark.createDataFrame(x, "id string, text string")
    index = fulltext.Postings.build(df(docs))
    same = lambda i, texts, q="red fox": rows(i.search(q, None)) == rows(fulltext.search(df(texts), q, None)) != []
    assert same(index, docs)
    index = index.upsert(df([("a", "green"), ("f", "fox fox red")]))
    now = [("a", "green"), *docs[1:], ("f", "fox fox red")]
    assert same(index, now) and same(index, now, "green")
    index = index.remove(spark.createDataFrame([("b",), ("zz",)], "id string"))
    now = [x for x in now if x[0] != "b"]
    assert same(index, now) and index.search("blue").count() == 0 and index.search("the").count() == 0 and index.n == 5
    for k in range(10):  # steps are merged on the way
        index = index.upsert(df([("g", f"red w{k}")]))
    assert same(index, [*now, ("g", "red w9")]) and index.steps < fulltext.Postings.MERGE_AFTER


def test_one_vector_is_indexed(spark):
    g = PropertyGraph.local(spark, [{"id": x, "labels": ["V"], "properties": {"e": v}} for x, v in (("a", [1.0, 0.0]), ("b", [0.0, 1.0]))] + [{"id": "c", "labels": ["V"]}, {"id": "d"}], [])
    g = vector.designate(g, "V", "e", 2)
    near = lambda g: [r["id"] for r in vector.vector_search(g, [1.0, 0.2], 3, "V", "e").collect()]
    assert near(g) == ["a", "b"]
    assert near(vector.index_vector(g, "c", "e", [5.0, 1.0])) == ["c", "a", "b"] and near(vector.index_vector(g, "a", "e", [0.0, 3.0])) == ["a", "b"]
    for node, v, code in (("x", [1.0, 1.0], "node_not_found"), ("d", [1.0, 1.0], "no_vector_designation"), ("a", [1.0], "dimension_mismatch")):
        with pytest.raises(GraphError, match=code):
            vector.index_vector(g, node, "e", v)
    from loomgraph.versioning.mutate import tombstone_nodes

    assert near(tombstone_nodes(g, spark.createDataFrame([("a",)], "id string"))) == ["b"]  # dead nodes are found no more


def test_grid_of_places(spark):
    rng = random.Random(1)
    places = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(400)] + [(900, 95.0, 0.0), (901, None, 0.0), (902, 90.0, 180.0), (903, -90.0, -180.0)]
    df = spark.createDataFrame(places, "id long, lat double, lon double")
    grid = spatial.Grid.build(df, 4)
    for lat, lon, km in ((48, 11, 3000), (-89, 0, 2000), (0, 179.9, 1500), (90, 0, 500)):
        assert rows(grid.radius(lat, lon, km)) == rows(spatial.radius(df.filter("lat <= 90"), lat, lon, km)) != []
    assert rows(grid.bbox(-20, -50, 60, 100)) == rows(spatial.bbox(df, -20, -50, 60, 100)) != []
    moved = grid.upsert(spark.createDataFrame([(0, 48.0, 11.0)], "id long, lat double, lon double")).remove(spark.createDataFrame([(902,)], "id long"))
    assert (0,) in rows(moved.radius(48, 11, 1)) and (902,) not in rows(moved.bbox(80, 170, 90, 180))
    with pytest.raises(GraphError):
        spatial.Grid.build(df, 16)


def test_plugins_and_schemas(spark):
    assert registry.backend("spatial", "grid") is spatial.Grid and registry.backend("fulltext", environment={"LOOMGRAPH_FULLTEXT": "postings"}) is fulltext.Postings and registry.backend("spatial") is spatial
    with pytest.raises(GraphError):
        registry.backend("spatial", "none")
    with pytest.raises(GraphError):
        registry.install(registry.Plugin("echo"))
    with pytest.raises(GraphError):
        registry.install(registry.Plugin("other", backends=(("paper", "x", 1),)))
    assert registry.PLUGINS["spatial"].capabilities() == ("spatial",) and registry.PLUGINS["echo"].capabilities() == ("operations",)
    by = {o["name"]: o for o in registry.catalog()}
    assert by["ppr"]["schema"]["required"] == ["seeds"] and by["ppr"]["schema"]["properties"]["alpha"] == {"type": "number", "default": 0.15}
    g = PropertyGraph.local(spark, [], [])
    assert registry.call(g, "echo", message="hi").first()[0] == "hi"


def test_resident_graph(spark):
    rng = np.random.default_rng(3)
    e = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 30, 90), rng.random(90))]
    p = spark.createDataFrame(e, "a string, b string, w double")
    graph = kernels.Resident.load(p)
    exact = dict(graph.ppr({"n1": 2.0, "n2": 1.0}, 0.15, 1e-9, 10**7))
    # power iteration; a node without out-edges keeps what it would send on, for good
    ids = graph.ids
    m = np.zeros((30, 30))
    for a, b, w in e:
        m[ids.index(a), ids.index(b)] += w
    out = m.sum(axis=1)
    m = np.divide(m, out[:, None], where=out[:, None] > 0, out=np.zeros_like(m))
    x, want = np.zeros(30), np.zeros(30)
    x[ids.index("n1")], x[ids.index("n2")] = 2 / 3, 1 / 3
    for _ in range(400):
        want += 0.15 * x
        x = 0.85 * x @ m
    assert all(abs(exact.get(i, 0.0) - want[k]) < 1e-6 for k, i in enumerate(ids) if out[k] > 0)
    assert graph.ppr({"zz": 1.0}) == [("zz", 0.15)] and len(graph.ppr({"n1": 1.0}, top_k=3)) == 3
    with pytest.raises(kernels.GraphTooLarge):
        kernels.Resident.load(p, 10)
    whole = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "a long, b long, w double")
    assert [r["id"] for r in kernels.personalised_ids(whole, {1: 1.0}, top_k=1).collect()] == [1]
    with pytest.raises(ValueError):
        kernels.personalised_ids(whole, {"1": 1.0})


def test_query_log_and_cache():
    log = observe.QueryLog(slow_ms=10, most=2)
    for ms in (0.5, 1, 3, 20, 30, 9999):
        log.record("cypher", ms, str(ms))
    assert [x["ms"] for x in log.slow] == [30, 9999]
    assert log.histogram("cypher")[0] == (1, 2) and log.histogram("cypher")[-1] == (None, 6) and len(log.histogram("x")) == 11
    with pytest.raises(ZeroDivisionError):
        log.timed("bad", lambda: 1 / 0)
    assert sum(log.counts["bad"]) == 1
    c = cache.VersionedCache()
    c.put("query", {"a": 1}, 3, "x")
    assert c.explain("query", {"a": 1}, 4)["state"] == "stale" and c.explain("query", {"a": 2}, 4)["entry_version"] is None


def test_latency_buckets(spark):
    df = spark.createDataFrame([("q", 0.5), ("q", 1.0), ("q", 6000.0)], "kind string, ms double")
    assert rows(observe.histogram(df, "ms", ["kind"])) == [("q", 0, 2), ("q", 10, 1)]


def test_waiting_for_mentions(spark):
    seen = iter([[], [("m1", "ask @ann")], []])
    now = [0.0]
    read = lambda: spark.createDataFrame(next(seen), "id string, text string")
    wait = lambda name, most: memory.wait_for_mentions(read, name, most, 1.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert wait("ann", 5) == ["m1"] and now[0] == 1.0
    assert wait("bob", 0) == []


def test_pull_brings_a_member_up_to_date(spark):
    cell = lambda f, v, t, who: ("node", "n", f, v, (t, 0, who))
    room = rooms.DeltaRoom(spark.createDataFrame([cell("prop:a", "1", 1, "x"), cell("prop:b", "2", 5, "y")], crdt.CELLS))
    mine = spark.createDataFrame([cell("prop:a", "1", 1, "x")], crdt.CELLS)
    reply = room.pull(crdt.version_vector(mine))
    assert rows(crdt.join_cells(mine, reply).select("field", "value")) == rows(room.state.select("field", "value"))
    assert room.pull(crdt.version_vector(room.state)).isEmpty()


def test_commands(spark):
    g = PropertyGraph.local(spark, [{"id": "a", "labels": ["N"]}], [])
    g, out = commands.run(g, "graph.node.upsert", {"id": "b", "labels": ["N"], "properties": {"k": 1}})
    g, out = commands.run(g, " GRAPH.EDGE.UPSERT ", {"id": "e", "from_id": "a", "to_id": "b", "type": "T"})
    assert [r["id"] for r in commands.run(g, "graph.nodes.query", {"label": "N"})[1].collect()] == ["a", "b"]
    assert commands.run(g, "graph.neighbors", {"node_id": "a"})[1].first()["node_id"] == "b" and commands.run(g, "graph.stats", {})[1].first()["edge_count"] == 1
    assert commands.run(g, "graph.verify", {})[1].isEmpty() and commands.run(g, "state.hash", {})[1].startswith("sha256:")
    assert commands.run(g, "debug.match", {"query": "MATCH (n:N)  RETURN n"})[1].count() == 2 and commands.run(g, "debug.match", {"query": "MATCH (a)-[e:T]->(b) RETURN a, e, b"})[1].first()["id"] == "e"
    assert commands.run(g, "debug.match", {"query": "RETURN 1"})[1].isEmpty()
    with pytest.raises(GraphError):
        commands.run(g, "nope", {})


def test_tree_doesn_t_depend_on_ranges(spark):
    import hashlib

    h = lambda k: "sha256:" + hashlib.sha256(str(k).encode()).hexdigest()
    for n in (0, 1, 700):
        df = spark.createDataFrame([(f"node/{k:05d}", h(k)) for k in range(n)], "key string, hash string").repartition(6)
        assert rows(snapshot.tree(df)) == rows(snapshot.tree(df, 20))
    more = df.unionByName(spark.createDataFrame([("node/00350x", h("x"))], "key string, hash string"))
    old, new = ({r["hash"] for r in snapshot.tree(x, 20).filter("level = 1").collect()} for x in (df, more))
    assert len(new - old) <= 12 < len(new & old)  # a row more changes the chunks near it alone


def test_only_one_writer_publishes(spark, tmp_path):
    root = str(tmp_path / "s")
    g = PropertyGraph.local(spark, [{"id": "a"}], [])
    m = store.save(g, root)
    assert not store._create(spark, f"{root}/manifests/000000000001.json", "{}")
    (tmp_path / "s" / "manifests" / "000000000002.json").write_text('{"format": 1, "ver')  # cut short by a crash
    assert store.load(spark, root).version == m["version"]
    assert store.save(g, root, expect_version=m["version"])["version"] == m["version"] + 1 and store.upgrade(spark, root)["format"] == 1


def test_csv_cells_keep_their_digits(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,label,v\nx:10, L1 ,202\n")
    assert [tuple(r)[:3] for r in readers.nodes_csv(spark, str(tmp_path / "n.csv"))[0].collect()] == [("x:10", ["L1"], '{"v":"202"}')]


def test_a_pattern_reads_the_tables_of_its_labels(spark):
    from loomgraph import testdata
    from loomgraph.plans.planner import cypher

    out = cypher(testdata.commerce(spark, "/root/testdata/sf0.001"), "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, COUNT(*) AS n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all(x in plan for x in ("c_custkey", "n_nationkey")) and not any(x in plan for x in ("o_orderkey", "p_partkey", "r_regionkey", "l_orderkey"))
