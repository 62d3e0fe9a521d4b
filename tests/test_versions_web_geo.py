"""Sources, versions, merges, conflict-free joins, overlays, geometry, text, pages, streams on tiny inputs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.algorithms import kernels
from loomgraph.functions import geometry, scalar
from loomgraph.model import GraphError, PropertyGraph
from loomgraph.operators import fulltext, memory, spatial, vector
from loomgraph.sources import readers, store
from loomgraph.streaming import cache, rooms
from loomgraph.versioning import crdt, overlay, snapshot
from loomgraph.web import crawl, search


def graph(spark, conf=0.5, name="x"):
    return PropertyGraph.local(spark, [{"id": "a", "properties": {"name": name}}, {"id": "b"}], [{"id": "e", "from_id": "a", "to_id": "b", "type": "T", "confidence": conf}])


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id":"a","labels":["X",3],"properties":{"k":1}}\r\n\nnot json\n{"id":5}\n{"id":"b","properties":[1]}\n')
    good, bad = readers.nodes_jsonl(spark, str(tmp_path / "n.jsonl"))
    assert [(r["id"], r["labels"], r["properties"]) for r in good.collect()] == [("a", ["X"], '{"k":1}')]
    assert sorted(r["code"] for r in bad.collect()) == ["invalid_json", "missing_id", "properties_not_object"]
    (tmp_path / "e.jsonl").write_text('{"id":"e","from_id":"a","to_id":"a","edge_type":"T","confidence":0.5}\n{"id":"f","from_id":"a","to_id":"zz","type":"T"}\n{"id":"g","from_id":"a"}\n')
    g = PropertyGraph.local(spark, [], [])
    g, report = readers.load_nodes(g, good, bad)
    assert report["inserted"] == 1 and report["failed"] == 3
    g, report = readers.load_edges(g, *readers.edges_jsonl(spark, str(tmp_path / "e.jsonl")))
    assert report["inserted"] == 1 and report["failed"] == 2 and g.edges.first()["confidence"] == 0.5
    (tmp_path / "n.csv").write_text("id,label,v\nx,L,1\ny,L\n")
    good, bad = readers.nodes_csv(spark, str(tmp_path / "n.csv"))
    assert [tuple(r)[:3] for r in good.collect()] == [("x", ["L"], '{"v":"1"}')] and bad.first()["code"] == "width_mismatch"
    (tmp_path / "e.csv").write_text("from_id,to_id,rel,w\nx,y,R,2\n")
    assert readers.edges_csv(spark, str(tmp_path / "e.csv"))[0].first()["id"] == "x-R-y"


def test_store_and_log(spark, tmp_path):
    root = str(tmp_path / "s")
    g = graph(spark)
    m = store.save(g, root)
    back = store.load(spark, root)
    assert back.nodes.count() == 2 and back.version == m["version"]
    with pytest.raises(GraphError):
        store.save(g, root, expect_version=99)
    assert store.save(back, root, expect_version=m["version"])["version"] == m["version"] + 1
    import hashlib

    body = json.dumps({"nodes": [{"id": "c", "labels": [], "properties": "{}", "version": 3, "tombstone": False}], "edges": []})
    ok = json.dumps({"txn": 2, "checksum": hashlib.sha256(body.encode()).hexdigest(), "body": body})
    (tmp_path / "log").write_text("\n".join([ok, json.dumps({"txn": 3, "checksum": "bad", "body": body}), ok]) + "\n")
    out, report = readers.replay_log(back, str(tmp_path / "log"), 1)
    assert out.nodes.count() == 3 and report["frames"] == 1


def test_diff_merge_and_tree(spark):
    base, ours, theirs = graph(spark), graph(spark, 0.9), graph(spark, 0.5, "y")
    assert {r["key"]: r["change"] for r in snapshot.diff(base, theirs).collect()} == {"node/a": "modified", "node/b": "unchanged", "edge/e": "unchanged"}
    merged, conflicts = snapshot.merge(base, ours, theirs)
    assert conflicts.isEmpty() and merged.edges.first()["confidence"] == 0.9 and merged.nodes.filter("id = 'a'").first()["prop_tokens"]["name"] == "str:y"
    assert snapshot.merge(base, graph(spark, name="z"), theirs)[0] is None
    assert snapshot.merge(base, graph(spark, name="z"), theirs, "prefer_ours")[0] is not None
    assert snapshot.merge(base, graph(spark, 0.7), ours)[0].edges.first()["confidence"] == 0.9
    assert snapshot.root_hash(base) == snapshot.root_hash(base.with_(nodes=base.nodes.repartition(2))) != snapshot.root_hash(theirs)
    repo = snapshot.Repository()
    c1 = repo.commit(base, message="one")
    c2 = repo.commit(ours, message="two")
    assert [c.message for c in repo.log("main")] == ["two", "one"] and c2.parents == (c1.hash,) and repo.checkout("main") is ours
    with pytest.raises(GraphError):
        repo.update_ref("x", "nope")


def test_conflict_free_join(spark):
    rows = [("node", "n", "prop:a", "1", (1, 0, "x")), ("node", "n", "prop:a", "2", (2, 0, "x")), ("node", "n", "label:L", "", (1, 0, "x")), ("node", "n", "alive", "", (1, 0, "x")), ("node", "n", "dead", "", (1, 0, "x")), ("edge", "e", "confidence", "0.9", (1, 0, "x")), ("edge", "e", "confidence", "0.2", (5, 0, "x"))]
    cells = spark.createDataFrame(rows, crdt.CELLS)
    one, two = crdt.join_cells(cells.limit(3), cells), crdt.join_cells(cells, cells.limit(3), cells)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    r = {x["id"]: x for x in crdt.records(one).collect()}
    assert r["n"]["properties"] == {"a": "2"} and r["n"]["labels"] == ["L"] and not r["n"]["tombstone"] and r["e"]["confidence"] == 0.9
    assert crdt.diff_since(one, crdt.version_vector(one)).isEmpty()
    room = rooms.DeltaRoom(one)
    room.join(cells, 0)
    room.join(cells, 0)
    assert room.applied == 0 and room.state.count() == one.count()
    c = crdt.Clock("me", wall=lambda: 10)
    assert c.now() < c.now() < c.observe((50, 3, "you")) < c.now()


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:02:00", "b", 4.0)], "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = rooms.tumbling(stream, "1 minute", ["k"]).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, rooms.tumbling(e, "1 minute", ["k"]).collect()))
    assert rooms.sessions(e, "2 minutes", []).count() == 1


def test_overlay(spark):
    base = graph(spark)
    v = overlay.view(base, spark.createDataFrame([("c", '{"name":"Foo"}')], "id string, properties string"), spark.createDataFrame([("n", "a", "c", "U"), ("m", "a", "gone", "U")], "id string, from_id string, to_id string, type string"), [], ["e"])
    assert {r["id"] for r in v.edges.collect()} == {"n"} and overlay.resolve_symbol(v, "foo") == "c"
    assert [(r["id"], r["depth"]) for r in overlay.impact(v, "a").collect()] == [("c", 1)] and overlay.impact(v, "nope").isEmpty()
    assert overlay.search(v, "foo").first()["score"] == 2.0


def test_geometry():
    sq = geometry.parse("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "wkt")
    assert geometry.contains(sq, (3, 3)) and not geometry.contains(sq, (1.5, 1.5)) and geometry.contains(sq, (0, 2)) and not geometry.contains(sq, (5, 5))
    assert geometry.intersects(sq, geometry.parse("LINESTRING (-1 3, 5 3)", "wkt")) and not geometry.intersects(sq, geometry.parse("POINT (9 9)", "wkt"))
    assert geometry.within(geometry.parse("POLYGON ((2.5 2.5, 3 2.5, 3 3, 2.5 3, 2.5 2.5))", "wkt"), sq)
    assert geometry.parse("0101000000000000000000F03F0000000000000040", "wkb").points == ((1.0, 2.0),)
    assert geometry.parse("POLYGON ((0 0, 1 1))", "wkt") is None and geometry.parse("nonsense", "wkt") is None
    assert geometry.parse("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "wkt").polygons[1][0][0] == (5.0, 5.0)


def test_places(spark):
    p = spark.createDataFrame([("berlin", 52.52, 13.405), ("paris", 48.8566, 2.3522), ("pole", 89.9, 0.0)], "id string, lat double, lon double")
    assert [r[0] for r in spatial.radius(p, 52.5, 13.4, 10).collect()] == ["berlin"]
    assert [r[0] for r in spatial.radius(p, 90.0, 100.0, 50).collect()] == ["pole"]
    assert [r[0] for r in spatial.bbox(p, 48, 2, 49, 3).collect()] == ["paris"]
    assert [tuple(r)[:2] for r in spatial.nearby_pairs(p, p, 900.0).filter("a_id < b_id").collect()] == [("berlin", "paris")]


def test_bm25_and_vectors(spark):
    d = spark.createDataFrame([("1", "red fox and red hen"), ("2", "red dog"), ("3", ""), ("4", None)], "id string, text string")
    assert [r["id"] for r in fulltext.search(d, "red", 5).collect()][0] in ("1", "2") and fulltext.search(d, "the", 5).isEmpty()
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, vector array<float>")
    g = PropertyGraph.local(spark, [{"id": x, "labels": ["V"]} for x in "abc"], [{"from_id": "a", "to_id": "c", "type": "R", "epistemic_type": "contradicts"}])
    g = vector.designate(g, "V", "e", 2, v)
    assert [r["id"] for r in vector.vector_search(g, [1.0, 0.0], 2, "V", "e").collect()] == ["a", "b"]
    with pytest.raises(GraphError):
        vector.vector_search(g, [1.0], 2, "V", "e")
    s = {r["id"]: r["score"] for r in vector.graph_scores(g, ["a"]).collect()}
    assert s == {"a": 1.0, "c": -1.0}
    assert [r["id"] for r in vector.hybrid_search(g, [1.0, 0.0], ["a"], 3, "V", "e").collect()] == ["a", "b", "c"]


def test_pages(spark):
    one = spark.createDataFrame([("http://H.example:80/d/p.html?q#f", '<a href="../x">1</a> <a href=\'//o.org\'>2</a><a href="mailto:a@b">3</a><a href="#t">4</a> <b>bold</b>')], "url string, html string")
    r = one.select(scalar.canonical_url(F.col("url")).alias("u"), scalar.links(F.col("url"), F.col("html")).alias("l"), scalar.html_text(F.col("html")).alias("t")).first()
    assert r["u"] == "http://h.example/d/p.html?q" and r["l"] == ["http://h.example/d/p.html?q", "http://h.example/x", "http://o.org/"] and r["t"] == "1 2 3 4 bold"
    g = crawl.crawl_graph(one, "r")
    assert {x["labels"][0] for x in g.nodes.collect()} == {"CrawlRun", "FetchAttempt", "Page", "ContentSnapshot", "Domain", "RobotsPolicy", "UrlAlias"}
    u = spark.createDataFrame([("http://127.0.0.1/",), ("http://a.com/x.pdf",), ("ftp://x/",), ("https://docs.rs/y",)], "u string")
    assert [tuple(x) for x in u.select(scalar.guarded(F.col("u")), scalar.source_class(F.col("u"))).collect()] == [(False, "unknown"), (True, "pdf"), (False, "unknown"), (True, "docs")]
    pages = spark.createDataFrame([("p1", "http://a.com/cats", "cats are fine"), ("p2", "http://b.com/", "linked"), ("p3", "http://c.com/", "far")], "id string, url string, text string")
    links = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p9")], "a string, b string")
    hits = search.substrate_search(pages, links, "cats")
    assert sorted((x["node_id"], x["ring"]) for x in hits.collect()) == [("p1", 0), ("p2", 1), ("p3", 2)]
    assert search.trigger_gate(search.search_stats(hits.limit(0)), "cats").first()["reason"] == "empty results"
    w = spark.createDataFrame([("p", 0.5, None), ("p", 0.0, None), ("q", None, "verified")], "peer string, weight double, tier string")
    assert {x["peer"]: x["weight"] for x in crawl.peer_weights(w).collect()} == {"p": 0.0, "q": 1.0}


def test_memory_and_cache(spark):
    t = spark.createDataFrame([(1, "hi @bob, `@no` x@y @amy.")], "id int, text string")
    assert [r["name"] for r in memory.mentioned(t).collect()] == ["bob", "amy"]
    c = cache.VersionedCache(2)
    c.put("query", {"q": 1}, 1, "v")
    assert c.get("query", {"q": 1}, 1) == "v" and c.get("query", {"q": 1}, 2) is None and c.check("query", {"q": 1}, 2) == "stale"
    assert c.invalidate(stale_before=2) == 1 and c.stats()["entries"] == 0


def test_all_matches_seed_the_page_search(spark):
    """1,500 equal matches in a ring: every page holds its own share of the mass, also those after the first thousand."""
    n = 1500
    pages = spark.createDataFrame([(f"p{i:04d}", f"http://h.com/{i}", "cats") for i in range(n)], "id string, url string, text string")
    links = spark.createDataFrame([(f"p{i:04d}", f"p{(i + 1) % n:04d}") for i in range(n)], "a string, b string")
    ranks = {f"p{i:04d}": 1 / (61 + i) for i in range(n)}
    hits = {r["node_id"]: r["score"] for r in search.substrate_search(pages, links, "cats", limit=n).collect()}
    both = pd.DataFrame([(f"p{i:04d}", f"p{(i + d) % n:04d}", 1.0) for i in range(n) for d in (1, -1)], columns=["a", "b", "w"])
    assert len(hits) == n
    top = search.dense_scores(pages, "cats").filter(F.col("dense") >= search.DENSE_LEAST).orderBy(F.desc("dense"), "id").limit(search.DENSE_TOP).collect()
    for k, r in enumerate(top):
        ranks[r["id"]] += 1 / (61 + k)
    want = kernels.ppr(both, ranks, 0.15, 1e-5)
    for i, s in zip(want["id"], want["score"]):
        assert abs(hits[i] - s) < 1e-9


def test_mentions_beside_code(spark, tmp_path):
    rows = [(1, "@ann and `@code` here", "en"), (2, "```\n@fenced\n``` then @bob, @cy", None), (3, "only `@code`", "de"), (4, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["id"], r["place"]): r["name"] for r in queries.QUERIES["mentions"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): "en", (1, 1): "doc.1", (1, 2): "ann", (2, 0): "any", (2, 1): "doc.2", (2, 2): "bob", (2, 3): "cy", (3, 0): "de", (3, 1): "doc.3", (4, 0): "fr", (4, 1): "doc.4"}
