"""Model, matching, the query language and writes on tiny graphs."""

import pytest
from pyspark.sql import functions as F

from loomgraph.model import GraphError, PropertyGraph, token_of
from loomgraph.operators import match, paths, stats
from loomgraph.plans import planner
from loomgraph.plans.syntax import parse
from loomgraph.versioning import mutate


@pytest.fixture(scope="module")
def files(spark):
    nodes = [
        {"id": "f:a", "labels": ["File", " File ", ""], "properties": {"path": "a", "n": 1, "x": 1.0, "z": None}},
        {"id": "f:b", "labels": ["File"], "properties": {"path": "b", "n": 2}},
        {"id": "s:c", "labels": ["Symbol"], "properties": {"name": "c", "n": "2"}},
        {"id": "dead", "labels": ["File"], "tombstone": True},
    ]
    edges = [
        {"from_id": "f:a", "to_id": "f:b", "type": "IMPORTS", "confidence": 0.9},
        {"from_id": "f:b", "to_id": "s:c", "type": "DEFINES", "confidence": 0.5, "epistemic_type": "supports"},
        {"from_id": "f:a", "to_id": "dead", "type": "IMPORTS"},
        {"id": "loop", "from_id": "f:a", "to_id": "f:a", "type": "SELF"},
    ]
    return PropertyGraph.local(spark, nodes, edges)


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_tokens_tell_types_apart(files):
    t = {r["id"]: r["prop_tokens"] for r in files.nodes.collect()}
    assert t["f:a"] == {"path": "str:a", "n": "int:1", "x": "float:1.0", "z": "null"}
    assert [token_of(v) for v in (1, 1.0, 1e21, True, None, "x", [1])] == ["int:1", "float:1.0", "float:1.0E21", "bool:true", "null", "str:x", None]
    assert files.nodes.filter("id = 'f:a'").first()["labels"] == ["File"]
    with pytest.raises(GraphError):
        token_of(float("nan"))


def test_node_query(files):
    assert ids(match.node_query(files, "File")) == ["f:a", "f:b"]
    assert ids(match.node_query(files, None, {"n": 2})) == ["f:b"]
    assert ids(match.node_query(files, None, {"n": "2"})) == ["s:c"]
    assert ids(match.node_query(files, None, {"z": None})) == ["f:a"]
    assert ids(match.node_query(files, None, {"n": [2]})) == []


def test_neighbors_hide_dead_ends(files):
    assert ids(match.neighbors(files, "f:a"), "node_id") == ["f:b", "f:a"]
    assert ids(match.neighbors(files, "f:a", "in"), "node_id") == ["f:a"]
    with pytest.raises(GraphError):
        match.neighbors(files, "f:a", "sideways")


def test_structured_query(files):
    out = match.structured_rows(*match.structured_query(files, {"operation": "node_match", "label": "File", "limit": 1}))
    assert len(out["rows"]) == 1 and out["truncated"]
    for bad in ({"operation": "x"}, {"operation": "node_match", "limit": 0}):
        with pytest.raises(GraphError):
            match.structured_query(files, bad)


def test_reads(files):
    run = lambda q, **k: [tuple(r) for r in planner.cypher(files, q, **k).collect()]
    assert run("MATCH (a:File)-[:IMPORTS]->(b:File) RETURN a.path, b.path") == [("a", "b")]
    assert run("MATCH (a:File {path: 'a'})-[:IMPORTS]->(b)-[:DEFINES]->(c) RETURN c.name AS name") == [("c",)]
    assert run("MATCH p = (a:File {path: $p})-[:IMPORTS]->(b) RETURN p", params={"p": "a"}) == [(["f:a", "f:b"],)]
    assert run("MATCH (n:File) RETURN COUNT(*)") == [(2,)]
    assert run("MATCH (n:Nothing) RETURN COUNT(*)") == [(0,)]
    assert run("MATCH (n:Nothing) RETURN SUM(n.n)") == []
    assert run("MATCH (n:File) RETURN n.missing AS m, n.path ORDER BY n.path DESC") == [(None, "b"), (None, "a")]
    assert run("MATCH (n:File) RETURN n.path SKIP 1 LIMIT 1") == [("b",)]
    assert run("MATCH (n:File) RETURN n.path LIMIT 0") == []
    assert run("MATCH (n:File) WITH n.missing AS m, SUM(n.n) AS s RETURN m, s") == [(None, 3.0)]
    assert run("MATCH (a:File {path: 'a'})-[:IMPORTS]->(b) WHERE b.path = 'b' RETURN b")[0][0]["id"] == "f:b"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("MATCH (n) RETURN n UNION MATCH (m) RETURN m", "unsupported_cypher"),
        ("MATCH (n:File {a: 1}) WHERE n.a = 2 RETURN n", "contradictory_filter"),
        ("MATCH (n:File) WHERE n.a = $x RETURN n", "missing_cypher_param"),
        ("MATCH (n)-[:T*3..1]->(m) RETURN n", "invalid_range"),
        ("MATCH (a)-[:T]->(b) RETURN a", "relationship_scan"),
        ("MATCH (a:F)-[:T]->(a) RETURN a", "repeated_binding"),
        ("MATCH (a:F) RETURN b", "unknown_binding"),
        ("MATCH (a:F RETURN a", "cypher_syntax"),
    ],
)
def test_refused(files, text, code):
    with pytest.raises(GraphError) as e:
        planner.cypher(files, text)
    assert e.value.code == code


def test_parse_shapes():
    q = parse("MATCH (a:X {k: -1.5, s: \"t\"})-[:T*2..4]->(b) RETURN a, COUNT(b.k) AS n ORDER BY n DESC SKIP 2 LIMIT 3")
    assert q.pattern.hops[0].low == 2 and q.pattern.hops[0].high == 4 and q.pattern.nodes[0].props == (("k", -1.5), ("s", "t"))
    assert q.items[1].aggregate == "COUNT" and q.order[0].descending and (q.skip, q.limit) == (2, 3)
    assert planner.explain("MATCH (a:X)-[:T*]->(b) RETURN a")["steps"][1]["range"] == [1, 8]


def test_var_length_blocks_at_nodes_outside_the_target(spark):
    g = PropertyGraph.local(spark, [{"id": i, "labels": [l]} for i, l in (("a", "A"), ("b", "B"), ("c", "C"), ("d", "C"))], [{"from_id": x, "to_id": y, "type": "T"} for x, y in ("ab", "bc", "cd", "da")])
    run = lambda q: sorted(r[0]["id"] for r in planner.cypher(g, q).collect())
    assert run("MATCH (a:A)-[:T*1..3]->(c:C) RETURN c") == []  # b stands in the way from depth 1 on
    assert run("MATCH (a:A)-[:T*2..3]->(c:C) RETURN c") == ["c", "d"]
    assert run("MATCH (a:A)-[:T*]->(x) RETURN x") == ["b", "c", "d"]


def test_writes(spark, files):
    one = files.with_(edges=files.edges.filter("to_id <> 'dead'"))
    g = planner.cypher(one, "CREATE (n:File {id: 'f:n', path: 'n'})")
    assert ids(match.get_node(g, "f:n")) == ["f:n"] and g.version == one.version + 1
    g = planner.cypher(g, "MERGE (n:Doc {id: 'f:n'}) ON MATCH SET n.count = n.count + 2 ON CREATE SET n.count = 1")
    r = match.get_node(g, "f:n").first()
    assert r["labels"] == ["Doc"] and r["prop_tokens"] == {"path": "str:n", "count": "int:2"}
    g = planner.cypher(g, "MATCH (n:Doc) SET n.path = 'm', n.count = n.count + 1")
    assert match.get_node(g, "f:n").first()["prop_tokens"] == {"path": "str:m", "count": "int:3"}
    g = planner.cypher(g, "CREATE (a:File {id: 'f:n', path: 'm'})-[:KNOWS]->(b:File {id: 'f:o'})")
    assert ids(match.neighbors(g, "f:n"), "node_id") == ["f:o"]
    g = planner.cypher(g, "MATCH (n:File {path: 'm'}) DETACH DELETE n")
    assert ids(match.get_node(g, "f:n")) == [] and g.live_edges.filter("type = 'KNOWS'").isEmpty()


def test_upserts_check_ends(spark, files):
    new = spark.createDataFrame([("e", "f:a", "nowhere", "T")], "id string, from_id string, to_id string, type string")
    with pytest.raises(GraphError) as e:
        mutate.upsert_edges(files, new)
    assert e.value.code == "missing_endpoint"
    with pytest.raises(GraphError) as e:
        mutate.upsert_edges(files, new.withColumn("to_id", F.lit("dead")))
    assert e.value.code == "tombstoned_endpoint"
    with pytest.raises(GraphError):
        mutate.upsert_nodes(files, spark.createDataFrame([(" ",)], "id string"))
    out = mutate.upsert_nodes(files, spark.createDataFrame([("f:b", '{"n":3}')], "id string, properties string"))
    old = files.nodes.filter("id = 'f:b'").first()["content_hash"]
    assert out.nodes.filter("id = 'f:b'").first()["parent_hashes"] == [old]


def test_batches_and_transactions(spark, files):
    with pytest.raises(GraphError):
        mutate.commit_batch(files, None, None)
    rows = spark.createDataFrame([("t:1", '{"a":1}')], "id string, properties string")
    out, writes = mutate.commit_batch(files, rows, None)
    assert [r["id"] for r in writes.collect()] == ["t:1"] and out.version == files.version + 1
    with pytest.raises(GraphError):
        mutate.commit_batch(files, rows, None, quota_bytes=1)
    now = [0.0]
    tx = mutate.Transactions(files, clock=lambda: now[0])
    a, b = tx.begin(), tx.begin()
    tx.stage(a, nodes=rows)
    with pytest.raises(GraphError):
        tx.stage(a, nodes=rows, tenant="other")
    tx.commit(a)
    with pytest.raises(GraphError) as e:
        tx.commit(b)
    assert e.value.code == "transaction_conflict"
    c = tx.begin()
    now[0] = 301.0
    with pytest.raises(GraphError) as e:
        tx.rollback(c)
    assert e.value.code == "transaction_not_found"


def test_paths_and_expansion(spark):
    edges = [("a", "b", 0.9), ("b", "d", 0.9), ("a", "c", 0.5), ("c", "d", 1.0), ("d", "e", 0.1)]
    g = PropertyGraph.local(spark, [{"id": x} for x in "abcde"], [{"from_id": x, "to_id": y, "type": "T", "confidence": w} for x, y, w in edges])
    assert paths.shortest_path(g, "a", "d") == ["a", "b", "d"] and paths.shortest_path(g, "e", "a") == [] and paths.shortest_path(g, "a", "a") == ["a"]
    p, cost = paths.shortest_path_weighted(g, "a", "d")
    assert p == ["a", "b", "d"] and abs(cost - 0.2) < 1e-9
    assert [(r["id"], r["depth"]) for r in match.expand(g, ["a"], 2).collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert ids(match.expand(g, ["a"], 3, 0.6)) == ["a", "b", "d"]
    assert [(r["id"], r["edge_id"]) for r in match.epistemic_neighbors(g, "d", None, 0.6).collect()] == [("b", "b-T-d"), ("c", "c-T-d")]


def test_stats_and_verify(files):
    r = stats.graph_stats(files).first()
    assert (r["node_count"], r["edge_count"], r["label_count"]) == (3, 4, 2)
    assert [tuple(x) for x in stats.verify(files).select("edge_id", "problem").collect()] == [("f:a-IMPORTS-dead", "tombstoned_node")]
    assert [r["label"] for r in stats.labels(files).collect()] == ["File", "Symbol"]
    assert stats.latency_quantile(files.live_nodes.selectExpr("length(id) as v"), "v", 0.95).first()[0] == 3
