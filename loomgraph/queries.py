"""Queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testdata as td
from .algorithms import iterative, kernels, registry, similarity
from .functions import scalar
from .iterate import scratch, settle
from .model import PropertyGraph, token_text
from .operators import fulltext, match, memory, paths, spatial, stats, vector
from .plans.planner import cypher
from .sources import readers
from .streaming import rooms
from .versioning import crdt, mutate, overlay, snapshot
from .web import crawl, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def cy(name: str, text: str, sql: str, graph: Callable[[SparkSession, str], PropertyGraph] = td.commerce, types: dict[str, str] | None = None, rounded: tuple[str, ...] = (), params: dict | None = None) -> None:
    """Register a statement of the query language."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = cypher(graph(spark, sf_dir), text, params, types, None)
        return out.select(*[(F.round(F.col(f"`{c}`"), 2) if c in rounded else F.col(f"`{c}`")).alias(c) for c in out.columns])

    QUERIES[name] = run
    ORACLES[name] = sql


# --------------------------------------------------------------------------- the query language

cy("cypher_count_by_nation", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.n_name AS nation, COUNT(*) AS customers ORDER BY n.n_name",
   "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
cy("cypher_two_hop", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, COUNT(*) AS n, SUM(c.c_acctbal) AS balance",
   "SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", rounded=("balance",))
cy("cypher_three_hop", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, COUNT(*) AS lines",
   "SELECT p_brand AS brand, count(*) AS lines FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
cy("cypher_filter_sort", "MATCH (c:Customer {c_mktsegment: $segment}) RETURN c.c_name AS name, c.c_acctbal AS balance ORDER BY c.c_acctbal DESC SKIP 5 LIMIT 20",
   "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, 'customer:' || c_custkey OFFSET 5 LIMIT 20", types={"balance": "double"}, params={"segment": "BUILDING"})
cy("cypher_where", "MATCH (o:Order) WHERE o.o_orderstatus = 'F' RETURN o.o_orderkey AS k, o.o_totalprice AS price",
   "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'", types={"k": "bigint", "price": "double"})
cy("cypher_with_group", "MATCH (p:Part) WITH p.p_brand AS brand, COUNT(*) AS n, AVG(p.p_retailprice) AS mean, MIN(p.p_size) AS low, MAX(p.p_size) AS high RETURN brand, n, mean, low, high ORDER BY n DESC",
   "SELECT p_brand AS brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high FROM part GROUP BY 1", rounded=("mean",))
cy("cypher_top_groups", "MATCH (p:Part) WITH p.p_type AS kind, COUNT(*) AS n, MAX(p.p_retailprice) AS high RETURN kind, n, high ORDER BY n DESC LIMIT 7",
   "SELECT p_type AS kind, count(*) AS n, max(p_retailprice) AS high FROM part GROUP BY 1 ORDER BY n DESC, kind LIMIT 7")
cy("cypher_with_distinct", "MATCH (p:Part) WITH p.p_type AS kind, p.p_brand AS brand RETURN kind, brand", "SELECT DISTINCT p_type AS kind, p_brand AS brand FROM part")
cy("cypher_aggregates", "MATCH (c:Customer) RETURN SUM(c.c_acctbal) AS total, AVG(c.c_acctbal) AS mean, MIN(c.c_acctbal) AS low, MAX(c.c_acctbal) AS high, COUNT(c) AS n",
   "SELECT round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 2) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer", rounded=("total", "mean"))
cy("cypher_count", "MATCH (o:Order {o_orderpriority: '1-URGENT'}) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
cy("cypher_sum_of_strings", "MATCH (c:Customer) RETURN SUM(c.c_name) AS s, COUNT(c.missing) AS n", "SELECT 0.0::DOUBLE AS s, count(*) AS n FROM customer")
cy("cypher_var_length", "MATCH (a:Turn {turn: 0})-[:NEXT*1..3]->(b:Turn) RETURN a.conv_id AS conv, b.turn AS turn",
   "SELECT DISTINCT a.conv_id AS conv, b.turn AS turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn BETWEEN 1 AND 3", td.turns, {"conv": "bigint", "turn": "bigint"})
cy("cypher_var_length_blocked", "MATCH (a:Turn {turn: 0})-[:NEXT*1..4]->(b:Turn {role: 'assistant'}) RETURN a.conv_id AS conv, b.turn AS turn",
   """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, role FROM conversations),
      walk AS (SELECT conv_id, 0 AS turn FROM t WHERE turn = 0
               UNION ALL SELECT t.conv_id, t.turn FROM walk JOIN t ON t.conv_id = walk.conv_id AND t.turn = walk.turn + 1 WHERE t.role = 'assistant' AND t.turn <= 4)
      SELECT conv_id AS conv, turn FROM walk WHERE turn > 0""", td.turns, {"conv": "bigint", "turn": "bigint"})  # fmt: skip
cy("cypher_path", "MATCH p = (a:Turn {turn: 0})-[:NEXT]->(b:Turn)-[:NEXT]->(c:Turn) RETURN a.conv_id AS conv, p",
   "SELECT DISTINCT a.conv_id AS conv, [printf('turn:%08d:0000', a.conv_id), printf('turn:%08d:0001', a.conv_id), printf('turn:%08d:0002', a.conv_id)] AS p FROM conversations a JOIN conversations c ON a.conv_id = c.conv_id WHERE a.turn = 0 AND c.turn = 2", td.turns, {"conv": "bigint"})

# --------------------------------------------------------------------------- scans, filters, neighbours


@query("node_query", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand = 'Brand#2' AND p_size = 11")
def _(spark, d):
    return match.node_query(td.commerce(spark, d), "Part", {"p_brand": "Brand#2", "p_size": 11}, None).select("id")


@query("neighbors_in", "SELECT 'customer:' || c_custkey || '|IN_NATION|nation:1' AS edge_id, 'customer:' || c_custkey AS node_id FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 'supplier:' || s_suppkey || '|IN_NATION|nation:1', 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 1")
def _(spark, d):
    return match.neighbors(td.commerce(spark, d), "nation:1", "in", "IN_NATION").select("edge_id", "node_id")


@query("structured_neighbors", "SELECT 'order:' || o_orderkey AS node_id FROM orders WHERE o_custkey = 7 ORDER BY 'customer:7|PLACED|order:' || o_orderkey LIMIT 11")
def _(spark, d):
    return match.structured_query(td.commerce(spark, d), {"operation": "neighbors", "node_id": "customer:7", "edge_type": "PLACED", "limit": 10})[0].select("node_id")


@query("expand_two_hops", "SELECT 'region:1' AS id, 0 AS depth UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def _(spark, d):
    return match.expand(td.commerce(spark, d), ["region:1"], 2, None, "in")


@query("expand_weighted", """WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1) AND 0.5 + ((conv_id * 7 + turn * 3) % 10) / 20.0 >= 0.7),
    w AS (SELECT conv_id, 0::BIGINT AS turn FROM conversations WHERE conv_id < 40 AND turn = 0 UNION SELECT w.conv_id, w.turn + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.turn WHERE w.turn < 3)
    SELECT printf('turn:%08d:%04d', conv_id, turn) AS id, turn::INTEGER AS depth FROM w""")
def _(spark, d):
    g = td.turns(spark, d)
    seeds = [f"turn:{i:08d}:0000" for i in range(40)]
    have = [r[0] for r in g.live_nodes.filter(F.col("id").isin(seeds)).select("id").collect()]
    return match.expand(g, have, 3, 0.7)


@query("epistemic_neighbors", """WITH t AS (SELECT DISTINCT turn FROM conversations WHERE conv_id = 3)
    SELECT printf('turn:%08d:%04d', 3, turn) AS id, 1 AS depth FROM t WHERE turn = 0 AND EXISTS (SELECT 1 FROM t WHERE turn = 1)
    UNION ALL SELECT printf('turn:%08d:%04d', 3, turn), 1 FROM t WHERE turn = 2 AND EXISTS (SELECT 1 FROM t WHERE turn = 1)
    UNION ALL SELECT printf('turn:%08d:%04d', 3, turn), 2 FROM t WHERE turn = 3 AND EXISTS (SELECT 1 FROM t WHERE turn = 1)""")
def _(spark, d):
    return match.epistemic_neighbors(td.turns(spark, d), "turn:00000003:0001", None, 0.0, 2).select("id", "depth")


@query("graph_stats", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + 30 AS node_count, 25 + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) AS edge_count, 6 AS label_count, 5 AS type_count")
def _(spark, d):
    return stats.graph_stats(td.commerce(spark, d)).select("node_count", "edge_count", "label_count", "type_count")


@query("label_catalog", "SELECT 'Customer' AS label FROM customer UNION SELECT 'Nation' FROM nation UNION SELECT 'Order' FROM orders UNION SELECT 'Part' FROM part UNION SELECT 'Region' FROM region UNION SELECT 'Supplier' FROM supplier")
def _(spark, d):
    return stats.labels(td.commerce(spark, d))


@query("property_catalog", "SELECT 'conv_id' AS key FROM conversations WHERE conv_id IS NOT NULL UNION SELECT 'role' FROM conversations WHERE role IS NOT NULL UNION SELECT 'turn' FROM conversations WHERE turn IS NOT NULL")
def _(spark, d):
    return stats.property_keys(td.turns(spark, d))


@query("verify_dangling", "SELECT 'customer:' || c_custkey || '|IN_NATION|nation:' || c_nationkey AS edge_id, 'to' AS side, 'tombstoned_node' AS problem FROM customer WHERE c_nationkey < 3 UNION ALL SELECT 'supplier:' || s_suppkey || '|IN_NATION|nation:' || s_nationkey, 'to', 'tombstoned_node' FROM supplier WHERE s_nationkey < 3 UNION ALL SELECT 'nation:' || n_nationkey || '|IN_REGION|region:' || n_regionkey, 'from', 'tombstoned_node' FROM nation WHERE n_nationkey < 3")
def _(spark, d):
    g = td.commerce(spark, d)
    dead = F.col("id").isin("nation:0", "nation:1", "nation:2")
    return stats.verify(g.with_(nodes=g.nodes.withColumn("tombstone", dead))).select("edge_id", "side", "problem")


@query("degrees", "WITH e AS (SELECT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b, 1 - l_discount AS w FROM lineitem) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(sum(w), 4) AS strength FROM (SELECT a AS id, 1 AS o, 0 AS i, w FROM e UNION ALL SELECT b, 0, 1, w FROM e) GROUP BY 1")
def _(spark, d):
    g = td.commerce(spark, d)
    only = g.with_(edges=g.edges.filter("type = 'CONTAINS'"))
    return stats.degrees(only).select("id", "out_degree", "in_degree", F.round("strength", 4).alias("strength"))


# --------------------------------------------------------------------------- vectors


def _vector_graph(spark, d):
    v = td.vectors(spark, d)
    g = PropertyGraph.of(v.select("id", F.array(F.lit("Vec")).alias("labels")), spark.createDataFrame([], "id string, from_id string, to_id string, type string"))
    return vector.designate(g, "Vec", "embedding", 64, v)


def _probe(spark, d):
    return [float(x) for x in td.table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query("vector_search", "SELECT 'vec:' || vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS distance FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, 'vec:' || vec_id LIMIT 10")
def _(spark, d):
    return vector.vector_search(_vector_graph(spark, d), _probe(spark, d), 10, "Vec").select("id", F.round(F.abs("distance"), 5).alias("distance"))


@query("knn_graph", """WITH s AS (SELECT 'vec:' || a.vec_id AS source, 'vec:' || b.vec_id AS target, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM s)
    SELECT source, rank::INTEGER AS rank, round(sim, 5) AS similarity FROM r WHERE rank <= 5""")
def _(spark, d):
    return vector.knn_pairs(td.vectors(spark, d), 5, -1.0).select("source", F.col("rank").cast("int").alias("rank"), F.round("similarity", 5).alias("similarity"))


@query("hybrid_search", """WITH d AS (SELECT 'vec:' || vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings), h AS (SELECT * FROM d ORDER BY d, id LIMIT 20),
    s AS (SELECT id, 0.5 * (1 - d / (SELECT max(d) FROM h)) + CASE WHEN id IN ('vec:1', 'vec:2', (SELECT id FROM h ORDER BY d DESC LIMIT 1)) THEN 0.5 ELSE 0 END AS score FROM h)
    SELECT id, round(score, 4) AS score FROM s ORDER BY score DESC, id LIMIT 10""")
def _(spark, d):
    g, probe = _vector_graph(spark, d), _probe(spark, d)
    far = vector.vector_search(g, probe, 20, "Vec").orderBy(F.desc("distance")).first()["id"]  # a seed among the hits
    return vector.hybrid_search(g, probe, ["vec:1", "vec:2", far], 10, "Vec").select("id", F.round("score", 4).alias("score"))


# --------------------------------------------------------------------------- text

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '' AND NOT list_contains(['a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','or','that','the','to','was','were','will','with','this','these','those'], w))"


@query("bm25_search", f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
    q AS (SELECT unnest(['onst', 'that', 'moron', 'moron', 'ciónra']) AS term), p AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q WHERE term <> 'that'),
    f AS (SELECT term, count(DISTINCT doc_id) AS df FROM p WHERE tf > 0 GROUP BY term)
    SELECT doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(a, 1)))), 3) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id""")
def _(spark, d):
    return fulltext.search(td.table(spark, d, "documents"), "onst that moron moron CIÓNRA", None, "doc_id").select("id", F.round(F.col("score").cast("double"), 3).alias("score"))


@query("postings", f"SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return fulltext.postings(td.table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))


@query("bm25_postings", f"""WITH d AS (SELECT doc_id, CASE lang WHEN 'fr' THEN text || ' onst onst' ELSE text END AS text FROM documents WHERE lang <> 'de'), t AS (SELECT doc_id, {_TOKENS} AS w FROM d), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
    q AS (SELECT unnest(['onst', 'that', 'moron', 'moron', 'ciónra']) AS term), p AS (SELECT doc_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q WHERE term <> 'that'),
    f AS (SELECT term, count(DISTINCT doc_id) AS df FROM p WHERE tf > 0 GROUP BY term)
    SELECT doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(a, 1)))), 3) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id""")
def _(spark, d):
    docs = td.table(spark, d, "documents")
    index = fulltext.Postings.build(docs, "doc_id").remove(docs.filter("lang = 'de'").select(F.col("doc_id").alias("id")))
    index = index.upsert(docs.filter("lang = 'fr'").select("doc_id", F.concat("text", F.lit(" onst onst")).alias("text")), "doc_id")
    return index.search("onst that moron moron CIÓNRA", None).select("id", F.round(F.col("score").cast("double"), 3).alias("score"))


# --------------------------------------------------------------------------- places

_PLACES = "(SELECT c_custkey AS id, (c_custkey * 37) % 1700 / 10.0 - 85 AS lat, (c_custkey * 91) % 3590 / 10.0 - 179.5 AS lon FROM customer)"


def _km(a: str, b: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


@query("radius_search", f"WITH q AS (SELECT 48.0 AS lat, 11.0 AS lon) SELECT p.id FROM {_PLACES} p, q WHERE {_km('q', 'p')} <= 2500")
def _(spark, d):
    return spatial.radius(td.places(spark, d), 48.0, 11.0, 2500.0)


@query("bbox_search", f"SELECT id FROM {_PLACES} WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN 20 AND 90")
def _(spark, d):
    return spatial.bbox(td.places(spark, d), -10, 20, 30, 90)


@query("grid_search", f"WITH q AS (SELECT 48.0 AS lat, 11.0 AS lon) SELECT 'radius' AS kind, p.id FROM {_PLACES} p, q WHERE {_km('q', 'p')} <= 2500 UNION ALL SELECT 'box', id FROM {_PLACES} WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN 20 AND 90")
def _(spark, d):
    grid = spatial.Grid.build(td.places(spark, d))
    return grid.radius(48.0, 11.0, 2500.0).select(F.lit("radius").alias("kind"), "id").unionByName(grid.bbox(-10, 20, 30, 90).select(F.lit("box").alias("kind"), "id"))


@query("nearby_pairs", f"SELECT a.id AS a_id, b.id AS b_id, round({_km('a', 'b')}, 3) AS km FROM {_PLACES} a JOIN {_PLACES} b ON a.id < b.id AND abs(a.lat - b.lat) < 2 WHERE {_km('a', 'b')} <= 150")
def _(spark, d):
    p = td.places(spark, d)
    return spatial.nearby_pairs(p, p, 150.0).filter("a_id < b_id").select("a_id", "b_id", F.round("km", 3).alias("km"))


@query("polygon_contains", f"SELECT id FROM {_PLACES} WHERE lat BETWEEN 0 AND 20 AND lon BETWEEN 0 AND 40")
def _(spark, d):
    p = td.places(spark, d).select(F.col("id"), F.concat(F.lit("POINT ("), "lon", F.lit(" "), "lat", F.lit(")")).alias("shape"))
    return spatial.within(spatial.geometries(p, "id", "shape"), "POLYGON ((0 0, 40 0, 40 20, 0 20, 0 0))")


# --------------------------------------------------------------------------- algorithms


def _pagerank_sql(rounds: int) -> str:
    out = """WITH e AS (SELECT DISTINCT 'customer:' || o_custkey AS a, 'supplier:' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    v AS (SELECT a AS id FROM e UNION SELECT b FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v), deg AS (SELECT a, count(*) AS d FROM e GROUP BY a), r0 AS (SELECT id, 1 / n AS s FROM v, n)"""
    for i in range(rounds):
        out += f""", x{i} AS (SELECT b AS id, sum(s / d) AS s FROM r{i} JOIN deg ON r{i}.id = deg.a JOIN e ON e.a = deg.a GROUP BY 1), l{i} AS (SELECT coalesce(sum(s), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT a FROM deg)),
    r{i + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (lost / n + coalesce(x{i}.s, 0)) AS s FROM v LEFT JOIN x{i} ON v.id = x{i}.id, n, l{i})"""
    return out + f" SELECT id, round(s, 9) AS score FROM r{rounds}"


@query("pagerank", _pagerank_sql(5))
def _(spark, d):
    out = kernels.auto(td.trade(spark, d), lambda pdf: kernels.pagerank(pdf, 0.85, 5, 0.0), lambda p: iterative.pagerank(p, 0.85, 5, 0.0), "id string, score double")
    return out.select("id", F.round("score", 9).alias("score"))


@query("pagerank_loop", _pagerank_sql(3))
def _(spark, d):
    return iterative.pagerank(td.trade(spark, d), 0.85, 3, 0.0).select("id", F.round("score", 9).alias("score"))


@query("components", "SELECT printf('turn:%08d:%04d', conv_id, turn) AS id, printf('turn:%08d:0000', conv_id) AS component FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) > 0))")
def _(spark, d):
    return iterative.components(iterative.edge_pairs(td.turns(spark, d)))


@query("node_similarity", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), k AS (SELECT s, count(*) AS d FROM e GROUP BY 1),
    x AS (SELECT a.s AS s1, b.s AS s2, count(*) AS c FROM e a JOIN e b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2),
    j AS (SELECT 'supplier:' || s1 AS node1, 'supplier:' || s2 AS node2, c / (k1.d + k2.d - c) AS sim FROM x JOIN k k1 ON k1.s = s1 JOIN k k2 ON k2.s = s2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node1 ORDER BY sim DESC, node2) AS rn FROM j) SELECT node1, node2, round(sim, 6) AS similarity FROM r WHERE rn <= 10""")
def _(spark, d):
    l = td.table(spark, d, "lineitem").select(td.ref("supplier", "l_suppkey").alias("a"), td.ref("part", "l_partkey").alias("b")).distinct()
    only = l.select(F.col("a").alias("id")).distinct()
    return similarity.node_similarity(l, top_k=10, only=only).select("node1", "node2", F.round("similarity", 6).alias("similarity"))


@query("link_prediction", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT p, count(*) AS d FROM e GROUP BY 1), w AS (SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
    x AS (SELECT s1, s2, d.d FROM w JOIN e a ON a.s = s1 JOIN e b ON b.s = s2 AND b.p = a.p JOIN d ON d.p = a.p)
    SELECT 'supplier:' || w.s1 AS node1, 'supplier:' || w.s2 AS node2, count(x.d) AS common_neighbors, round(coalesce(sum(CASE WHEN x.d > 1 THEN 1 / ln(x.d) END), 0), 6) AS adamic_adar, round(coalesce(sum(1 / x.d), 0), 6) AS resource_allocation FROM w LEFT JOIN x ON x.s1 = w.s1 AND x.s2 = w.s2 GROUP BY 1, 2""")
def _(spark, d):
    l = td.table(spark, d, "lineitem").select(td.ref("supplier", "l_suppkey").alias("a"), td.ref("part", "l_partkey").alias("b"))
    s = td.table(spark, d, "supplier")
    w = s.select(td.ref("supplier", "s_suppkey").alias("node1"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") + 1).cast("string")).alias("node2"), (F.col("s_suppkey") + 1).alias("k")).join(s.select(F.col("s_suppkey").alias("k")), "k", "left_semi")
    return similarity.link_prediction(l, w).select("node1", "node2", "common_neighbors", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("resource_allocation", 6).alias("resource_allocation"))


@query("modularity", """WITH x AS (SELECT c_custkey AS a, c_nationkey AS b, c_custkey % 4 AS ca, c_nationkey % 4 AS cb FROM customer), m AS (SELECT 2.0 * count(*) AS m2 FROM x),
    k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM x UNION ALL SELECT cb FROM x) GROUP BY 1), i AS (SELECT ca AS c, 2.0 * count(*) AS e FROM x WHERE ca = cb GROUP BY 1)
    SELECT round(sum(coalesce(e, 0) / m2 - pow(k / m2, 2)), 9) AS modularity FROM k LEFT JOIN i USING (c), m""")
def _(spark, d):
    c = td.table(spark, d, "customer")
    pairs = c.select(td.ref("customer", "c_custkey").alias("a"), td.ref("nation", "c_nationkey").alias("b"), F.lit(1.0).alias("w"))
    labels = c.select(td.ref("customer", "c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("community")).unionByName(c.select(td.ref("nation", "c_nationkey").alias("id"), (F.col("c_nationkey") % 4).cast("long").alias("community")).distinct())
    return iterative.modularity(pairs, labels).select(F.round("modularity", 9).alias("modularity"))


@query("topological_levels", "SELECT printf('turn:%08d:%04d', conv_id, turn) AS id, turn::INTEGER AS level FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) > 0))")
def _(spark, d):
    return iterative.topological_levels(iterative.edge_pairs(td.turns(spark, d)))


#: Turns of conversations that have several, and whether an assistant speaks.
_TALK = "SELECT conv_id, turn, max((role = 'assistant')::INTEGER) AS a FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) > 0) GROUP BY 1, 2"


@query("strong_components", f"SELECT printf('turn:%08d:%04d', conv_id, turn) AS id, printf('turn:%08d:%04d', conv_id, max(CASE WHEN a = 0 OR turn = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn)) AS root FROM ({_TALK})")
def _(spark, d):
    out = kernels.auto(td.replies(spark, d), kernels.strong_components, iterative.strong_components, "id string, component int", kernels.KERNEL_EDGES)
    return out.join(out.groupBy("component").agg(F.min("id").alias("root")), "component").select("id", "root")


@query("personalised_pagerank")
def _(spark, d):
    pairs = td.trade(spark, d)
    return kernels.personalised(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), {"customer:1": 1.0}).orderBy(F.desc("score"), "id").limit(10)


@query("communities")
def _(spark, d):
    return registry.call(td.turns(spark, d), "communities")


@query("leiden")
def _(spark, d):
    return kernels.run_kernel(iterative.edge_pairs(td.turns(spark, d)), kernels.leiden, "id string, community int")


@query("betweenness", "SELECT printf('turn:%08d:%04d', c.conv_id, c.turn) AS id, (c.turn * (m.last - c.turn))::DOUBLE AS score FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1 HAVING max(turn) > 0) m USING (conv_id)")
def _(spark, d):
    return kernels.per_component(iterative.edge_pairs(td.turns(spark, d)), kernels.component_betweenness, "id string, score double")


@query("betweenness_tree", """WITH c AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1), t AS (SELECT n_nationkey AS n, n_regionkey AS r, coalesce(k, 0) AS k FROM nation LEFT JOIN c ON n = n_nationkey), x AS (SELECT r, sum(k + 1) + 1 AS size FROM t GROUP BY 1)
    SELECT 'nation:' || n AS id, (k * (size - 1 - k) + k * (k - 1) / 2)::DOUBLE AS score FROM t JOIN x USING (r) UNION ALL SELECT 'region:' || r, (pow(sum(k + 1), 2) - sum(pow(k + 1, 2))) / 2 FROM t GROUP BY r UNION ALL SELECT 'customer:' || c_custkey, 0 FROM customer""")
def _(spark, d):
    g = td.commerce(spark, d)
    e = g.typed("IN_NATION").filter("from_id like 'customer:%'").unionByName(g.typed("IN_REGION"))
    return kernels.betweenness(e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(1.0).alias("w")))


@query("cut_points", f"WITH t AS ({_TALK}), m AS (SELECT conv_id, max(turn) AS last FROM t GROUP BY 1) SELECT 'articulation' AS kind, printf('turn:%08d:%04d', conv_id, turn) AS a FROM t JOIN m USING (conv_id) WHERE turn > 0 AND turn < last UNION ALL SELECT 'bridge', printf('turn:%08d:%04d', conv_id, turn - 1) FROM t WHERE turn > 0 AND a = 0")
def _(spark, d):
    return kernels.per_component(td.replies(spark, d), kernels.cut_points, "kind string, a string, b string").select("kind", "a")


@query("weighted_distances", """WITH RECURSIVE w AS (SELECT 0::BIGINT AS turn, 0.0::DOUBLE AS cost UNION ALL SELECT w.turn + 1, w.cost + 1 - (0.5 + ((5 * 7 + w.turn * 3) % 10) / 20.0) FROM w WHERE w.turn < (SELECT max(turn) FROM conversations WHERE conv_id = 5))
    SELECT printf('turn:%08d:%04d', 5, turn) AS id, round(cost, 6) AS cost FROM w""")
def _(spark, d):
    return paths.weighted_distances(td.turns(spark, d), "turn:00000005:0000", 16).select("id", F.round("cost", 6).alias("cost"))


@query("registry_pagerank_stats")
def _(spark, d):
    g = td.turns(spark, d)
    return registry.call(g, "pagerank", "stats", max_iter=3)


@query("morphology_dual", "WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey AS a, -1 - l_partkey AS b FROM lineitem), s AS (SELECT l_orderkey || '/' || l_linenumber AS seg, unnest([a, b]) AS p FROM e) SELECT DISTINCT x.seg AS a, y.seg AS b FROM s x JOIN s y ON x.p = y.p AND x.seg <> y.seg")
def _(spark, d):
    l = td.table(spark, d, "lineitem")
    return iterative.dual_graph(l.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("a"), (-1 - F.col("l_partkey")).alias("b")))


# --------------------------------------------------------------------------- versions


def _versions(spark, d) -> tuple[PropertyGraph, PropertyGraph, PropertyGraph]:
    """Customers, and two edited copies of them."""
    c = td.table(spark, d, "customer")
    none = spark.createDataFrame([], "id string, from_id string, to_id string, type string")

    def version(rows: DataFrame, bal) -> PropertyGraph:
        return PropertyGraph.of(rows.select(td.ref("customer", "c_custkey").alias("id"), F.array(F.lit("Customer")).alias("labels"), F.to_json(F.struct(F.col("c_name").alias("name"), bal.cast("int").alias("b"))).alias("properties")), none)

    k = F.col("c_custkey")
    one = F.lit(1)
    base = version(c.filter(k % 10 != 0), one)
    ours = version(c.filter(k % 10 != 1), F.when(k % 10 == 2, 2).otherwise(one))
    theirs = version(c.filter((k % 10 != 0) & (k % 10 != 4)), F.when(k % 10 == 3, 3).otherwise(one))
    return base, ours, theirs


@query("snapshot_diff", "SELECT 'node/customer:' || c_custkey AS key, CASE c_custkey % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS change FROM customer")
def _(spark, d):
    base, ours, _t = _versions(spark, d)
    return snapshot.diff(base, ours).select("key", "change")


@query("three_way_merge", "SELECT 'customer:' || c_custkey AS id, CASE c_custkey % 10 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS b FROM customer WHERE c_custkey % 10 NOT IN (1, 4)")
def _(spark, d):
    merged, _c = snapshot.merge(*_versions(spark, d), strategy="manual")
    return merged.nodes.select("id", token_text(F.col("prop_tokens")["b"]).cast("int").alias("b"))


@query("merge_conflicts", "SELECT 'node/customer:' || c_custkey AS key FROM customer WHERE c_custkey % 10 = 2")
def _(spark, d):
    base, ours, _t = _versions(spark, d)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    n = base.nodes.withColumn("properties", F.when(k % 10 == 2, F.lit('{"b":9}')).otherwise(F.col("properties"))).select("id", "labels", "properties")
    return snapshot.merge(base, ours, PropertyGraph.of(n, base.edges), strategy="manual")[1].select("key")


@query("content_tree_root")
def _(spark, d):
    return snapshot.tree(snapshot.content_objects(_versions(spark, d)[0])).orderBy(F.desc("level")).limit(1)


def _cells(spark, d) -> DataFrame:
    e = td.table(spark, d, "events")
    stamp = F.struct(F.expr("unix_millis(cast(ts as timestamp))").alias("physical_ms"), F.col("event_id").alias("logical"), F.lit("a").alias("actor"))
    return e.select(F.lit("node").alias("kind"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("prop:"), "event_type").alias("field"), F.col("value").cast("string").alias("value"), stamp.alias("stamp"))


@query("crdt_join", "SELECT 'user:' || user_id AS id, 'prop:' || event_type AS field, arg_max(value, (epoch_ms(ts), event_id)) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    c = _cells(spark, d)
    odd = F.col("stamp.logical") % 2 == 1
    return crdt.join_cells(c.filter(odd), c.filter(~odd), c).select("id", "field", F.col("value").cast("double").alias("value"))


@query("crdt_records", "SELECT 'user:' || user_id AS id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def _(spark, d):
    return crdt.records(crdt.join_cells(_cells(spark, d))).select("id", F.size("properties").cast("long").alias("n"))


@query("crdt_diff_since", "SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE event_id > (SELECT max(event_id) / 2 FROM events)")
def _(spark, d):
    c = _cells(spark, d)
    half = c.agg(F.max("stamp.logical")).first()[0] / 2
    seen = crdt.version_vector(c.filter(F.col("stamp.logical") <= half))
    return crdt.diff_since(c, seen).select("id").distinct()


@query("overlay_view", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey <> 5 UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'part:' || p_partkey FROM part UNION ALL SELECT 'order:' || o_orderkey FROM orders UNION ALL SELECT 'extra:1'")
def _(spark, d):
    return overlay.view(td.commerce(spark, d), spark.createDataFrame([("extra:1",)], "id string"), None, ["customer:5"]).nodes.select("id")


@query("overlay_impact", "SELECT 'nation:' || n_nationkey AS id, 1 AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(spark, d):
    return overlay.impact(td.commerce(spark, d), "region:2", "in", 2)


@query("overlay_search", "SELECT 'part:' || p_partkey AS id, CASE WHEN p_name LIKE '%widget%' THEN 2.0 ELSE 0 END + CASE WHEN p_name LIKE '%red%' THEN 2.0 ELSE 0 END AS score FROM part WHERE p_name LIKE '%widget%' OR p_name LIKE '%red%'")
def _(spark, d):
    p = td.table(spark, d, "part").withColumnRenamed("p_name", "name")
    g = PropertyGraph(td.nodes_of(p, td.ref("part", "p_partkey"), "Part", ["name"]), td.commerce(spark, d).edges)
    return overlay.search(g, "widget RED", None)


@query("upsert_detach", "SELECT 'customer:' || c_custkey || '|IN_NATION|nation:' || c_nationkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'customer:' || o_custkey || '|PLACED|order:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    ids = td.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(td.ref("customer", "c_custkey").alias("id"))
    out = mutate.tombstone_nodes(td.commerce(spark, d), ids, detach=True)
    return out.edges.filter("tombstone").select("id")


# --------------------------------------------------------------------------- loads


def _written(rows: DataFrame, name: str) -> str:
    """Lines of a text table as files in the shared folder."""
    path = f"{scratch(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def jsonl_nodes(rows: DataFrame, key: Column, label: str, props: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(key.alias("id"), F.array(F.lit(label)).alias("labels"), F.struct(*props).alias("properties"))).alias("value"))


def jsonl_edges(rows: DataFrame, a: Column, kind: str, b: Column) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.concat_ws("|", a, F.lit(kind), b).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"))).alias("value"))


def _empty_graph(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph.of(spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string, from_id string, to_id string, type string"))


@query("load_jsonl", """SELECT 'node' AS kind, 'customer:' || c_custkey AS id, c_name AS value FROM customer UNION ALL SELECT 'node', 'nation:' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'edge', 'customer:' || c_custkey || '|IN_NATION|nation:' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'report', 'nodes', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) || '/2' UNION ALL SELECT 'report', 'edges', (SELECT count(*) FROM customer) || '/' || (1 + (SELECT count(*) FROM supplier))""")
def _(spark, d):
    c, n, s = (td.table(spark, d, x) for x in ("customer", "nation", "supplier"))
    odd = spark.createDataFrame([("not json",), ('{"labels": ["X"]}',), ("",)], "value string")
    nodes = jsonl_nodes(c.withColumnRenamed("c_name", "name"), td.ref("customer", "c_custkey"), "Customer", ["name"]).unionByName(jsonl_nodes(n.withColumnRenamed("n_name", "name"), td.ref("nation", "n_nationkey"), "Nation", ["name"])).unionByName(odd)
    g, r = readers.load_nodes(_empty_graph(spark), *readers.nodes_jsonl(spark, _written(nodes, "nodes")))
    # edges of suppliers have no node at one end, and one line is no JSON
    lines = jsonl_edges(c, td.ref("customer", "c_custkey"), "IN_NATION", td.ref("nation", "c_nationkey")).unionByName(jsonl_edges(s, td.ref("supplier", "s_suppkey"), "IN_NATION", td.ref("nation", "s_nationkey"))).unionByName(odd.limit(1))
    g, q = readers.load_edges(g, *readers.edges_jsonl(spark, _written(lines, "edges")))
    out = g.live_nodes.select(F.lit("node").alias("kind"), "id", token_text(F.col("prop_tokens")["name"]).alias("value")).unionByName(g.live_edges.select(F.lit("edge").alias("kind"), "id", F.col("type").alias("value")))
    return out.unionByName(spark.createDataFrame([("report", k, f"{x['inserted']}/{x['failed']}") for k, x in (("nodes", r), ("edges", q))], "kind string, id string, value string"))


@query("load_csv", "SELECT 'node' AS kind, 'supplier:' || s_suppkey AS id, s_name AS value FROM supplier UNION ALL SELECT 'edge', 'supplier:' || a.s_suppkey || '-NEXT-supplier:' || b.s_suppkey, 'NEXT' FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def _(spark, d):
    s = td.table(spark, d, "supplier")
    nodes = s.select(F.concat_ws(",", td.ref("supplier", "s_suppkey"), F.lit("Supplier"), "s_name").alias("value"))
    follow = s.select((F.col("s_suppkey") - 1).alias("k"))
    edges = s.join(follow, s["s_suppkey"] == follow["k"], "left_semi").select(F.concat_ws(",", td.ref("supplier", "s_suppkey"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") + 1).cast("string")), F.lit("NEXT")).alias("value"))
    g, _r = readers.load_nodes(_empty_graph(spark), *readers.nodes_csv(spark, _written(nodes, "nodes"), ["id", "label", "name"]))
    g, _r = readers.load_edges(g, *readers.edges_csv(spark, _written(edges, "edges"), ["from_id", "to_id", "type"]))
    return g.live_nodes.select(F.lit("node").alias("kind"), "id", token_text(F.col("prop_tokens")["name"]).alias("value")).unionByName(g.live_edges.select(F.lit("edge").alias("kind"), "id", F.col("type").alias("value")))


# --------------------------------------------------------------------------- pages

_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"


@query("page_links", f"SELECT DISTINCT page_id, {_ORIGIN} || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages")
def _(spark, d):
    return td.web_pages(spark, d).select("page_id", F.explode(scalar.links(F.col("url"), F.col("html"))).alias("link")).distinct()


@query("page_text", "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>?', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_hash FROM pages")
def _(spark, d):
    return td.web_pages(spark, d).select("page_id", F.sha2(scalar.html_text(F.col("html")), 256).alias("text_hash"))


@query("page_domains", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    return td.web_pages(spark, d).groupBy(scalar.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("page_classes", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '^[^?#]*\\.pdf([?#]|$)') THEN 'pdf' WHEN regexp_matches(lower(url), '^[a-z]+://[^/?#]+/[^?#]*(/docs|/documentation)') OR regexp_matches(lower(url), '^[a-z]+://[^/?#]+(/docs|/documentation)') THEN 'docs' WHEN regexp_matches(lower(url), '^[a-z]+://[^/?#]+[^?#]*/blog') THEN 'blog' WHEN regexp_matches(lower(url), '^[a-z]+://[^/?#]+[^?#]*(/forum|/community|/discuss)') THEN 'forum' WHEN regexp_matches(lower(url), '^[a-z]+://[^/?#]+[^?#]*(/product|/pricing)') THEN 'product' ELSE 'unknown' END AS source_class FROM pages")
def _(spark, d):
    return td.web_pages(spark, d).select("page_id", scalar.source_class(F.col("url")).alias("source_class"))


@query("crawl_graph_labels", f"""WITH f AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url, html, {_ORIGIN} AS o, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS d FROM pages), l AS (SELECT DISTINCT o || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM f)
    SELECT 'CrawlRun' AS label, 1 AS n UNION ALL SELECT 'FetchAttempt', count(DISTINCT url) FROM f UNION ALL SELECT 'Page', count(*) FROM (SELECT url FROM f UNION SELECT regexp_replace(url, '#.*$', '') FROM l)
    UNION ALL SELECT 'ContentSnapshot', count(DISTINCT sha256(html)) FROM f UNION ALL SELECT 'Domain', count(DISTINCT d) FROM f UNION ALL SELECT 'RobotsPolicy', count(DISTINCT d) FROM f
    UNION ALL SELECT 'UrlAlias', count(DISTINCT url) FROM pages WHERE url LIKE '%#%' HAVING count(*) > 0""")
def _(spark, d):
    g = crawl.crawl_graph(td.web_pages(spark, d), "r1")
    return g.nodes.groupBy(F.element_at("labels", 1).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("page_search")
def _(spark, d):
    f = settle(crawl.fetched(td.web_pages(spark, d)).select(crawl.page_id(F.col("url")).alias("id"), "url", "text", "links"))
    links = f.select(F.col("id").alias("a"), F.explode("links").alias("t")).select("a", crawl.page_id(F.col("t")).alias("b"))
    return search.substrate_search(f.select("id", "url", "text"), links, "moron idiot ciónra")


@query("crawl_gate")
def _(spark, d):
    return search.trigger_gate(search.search_stats(QUERIES["page_search"](spark, d)), "moron", "broad")


# --------------------------------------------------------------------------- streams and memory


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return rooms.tumbling(td.table(spark, d, "events"), "1 hour", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("sliding_windows", "WITH w AS (SELECT ts, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY 1")
def _(spark, d):
    return rooms.sliding(td.table(spark, d, "events"), "2 hours", "1 hour", []).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    return rooms.sessions(td.table(spark, d, "events"), "6 hours", ["user_id"]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("memory_recall", "SELECT 'memory:' || conv_id || ':' || turn AS id FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'the') AND (turn % 10) / 10.0 >= 0.3")
def _(spark, d):
    c = td.table(spark, d, "conversations").select(F.concat_ws(":", F.lit("memory"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("role").alias("actor"), F.col("text").alias("content"), (F.col("turn") % 10 / 10.0).alias("fitness"), F.lit("active").alias("status"))
    g = PropertyGraph(td.nodes_of(c, F.col("key"), "Memory", ["actor", "content", "fitness", "status"]), td.turns(spark, d).edges)
    return memory.recall(g, "the", actor="assistant", limit=None).select("id")


_ASKED = "'ask @' || coalesce(lang, 'any') || ' and `@nobody` or ```\n@none\n``` but a@b for @doc.' || doc_id || '. ' || coalesce(text, '')"


@query("mentions", f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace({_ASKED.replace(chr(10), "' || chr(10) || '")}, '(?s)```.*?(?:```|$)', ' ', 'g'), '`[^`' || chr(10) || ']*`', ' ', 'g') AS t FROM documents)
    SELECT doc_id AS id, m AS name, place::INTEGER AS place FROM (SELECT doc_id, unnest(l) AS m, unnest(range(len(l))) AS place FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '(^|[^A-Za-z0-9_])@([A-Za-z0-9][A-Za-z0-9_.:-]*)', 2), lambda x: regexp_replace(x, '[.:-]+$', '')), lambda x: x <> '' AND length(x) <= 120) AS l FROM t))""")
def _(spark, d):
    docs = td.table(spark, d, "documents").withColumn("text", F.expr(_ASKED.replace("\n", "\\n")))
    return memory.mentioned(docs, "doc_id").select("id", "name", "place")
