"""Graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import PropertyGraph, as_edges, as_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _token(c: Column, kind: str) -> Column:
    if kind.endswith("int"):
        return F.concat(F.lit("int:"), c.cast("string"))
    if kind == "double":
        return F.concat(F.lit("float:"), c.cast("string"))
    return F.concat(F.lit("str:"), c.cast("string"))


def nodes_of(df: DataFrame, key: Column, label: str, props: list[str]) -> DataFrame:
    """Nodes whose properties are typed columns: tokens come from the columns, not from JSON, so filters stay cheap."""
    kinds = dict(df.dtypes)
    entries = [x for p in props for x in (F.lit(p), F.coalesce(_token(F.col(p), kinds[p]), F.lit("null")))]
    tokens = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return as_nodes(df.select(key.alias("id"), F.array(F.lit(label)).alias("labels"), F.to_json(F.struct(*props)).alias("properties"), tokens.alias("prop_tokens"), F.lit(None).cast("string").alias("content_hash")))


def edges_of(df: DataFrame, a: Column, kind: str, b: Column, key: Column | None = None, confidence: Column | None = None, epistemic: Column | None = None) -> DataFrame:
    key = key if key is not None else F.concat_ws("|", a, F.lit(kind), b)
    none = F.lit(None)
    return as_edges(
        df.select(
            key.alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), F.create_map().cast("map<string,string>").alias("prop_tokens"), none.cast("string").alias("content_hash"),
            (confidence if confidence is not None else none).cast("double").alias("confidence"), (epistemic if epistemic is not None else none).cast("string").alias("epistemic_type"),
        )
    )


def ref(label: str, key: str) -> Column:
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


_graphs: dict[tuple, PropertyGraph] = {}


def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders and their links. The plan is built once a session and folder."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _graphs:
        _graphs[key] = _commerce(spark, sf_dir)
    return _graphs[key]


def _commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda n: table(spark, sf_dir, n)
    c, s, n, r, p, o, l = (t(x) for x in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem"))
    line = F.concat_ws("/", F.lit("line"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    labels = {
        "Region": nodes_of(r, ref("region", "r_regionkey"), "Region", ["r_regionkey", "r_name"]),
        "Nation": nodes_of(n, ref("nation", "n_nationkey"), "Nation", ["n_nationkey", "n_name"]),
        "Customer": nodes_of(c, ref("customer", "c_custkey"), "Customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]),
        "Supplier": nodes_of(s, ref("supplier", "s_suppkey"), "Supplier", ["s_suppkey", "s_name", "s_acctbal"]),
        "Part": nodes_of(p, ref("part", "p_partkey"), "Part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
        "Order": nodes_of(o, ref("order", "o_orderkey"), "Order", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]),
    }
    types = {
        "IN_REGION": edges_of(n, ref("nation", "n_nationkey"), "IN_REGION", ref("region", "n_regionkey")),
        "IN_NATION": edges_of(c, ref("customer", "c_custkey"), "IN_NATION", ref("nation", "c_nationkey")).unionByName(edges_of(s, ref("supplier", "s_suppkey"), "IN_NATION", ref("nation", "s_nationkey"))),
        "PLACED": edges_of(o, ref("customer", "o_custkey"), "PLACED", ref("order", "o_orderkey")),
        "CONTAINS": edges_of(l, ref("order", "l_orderkey"), "CONTAINS", ref("part", "l_partkey"), line, 1 - F.col("l_discount")),
        "SUPPLIED_BY": edges_of(l, ref("order", "l_orderkey"), "SUPPLIED_BY", ref("supplier", "l_suppkey"), F.concat(line, F.lit("/s")), 1 - F.col("l_discount")),
    }
    return PropertyGraph.of_tables(labels, types)


def turns(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Conversation turns with NEXT edges; the edge's epistemic type follows the turn number, its confidence the keys."""
    t = table(spark, sf_dir, "conversations")
    tid = F.concat_ws(":", F.lit("turn"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    nxt = F.concat_ws(":", F.lit("turn"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad((F.col("turn") + 1).cast("string"), 4, "0"))
    nodes = nodes_of(t.dropDuplicates(["conv_id", "turn"]), tid, "Turn", ["conv_id", "turn", "role"])
    more = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
    e = t.select("conv_id", "turn").distinct().join(more, "conv_id").filter("turn < last")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("supports", "contradicts", "tension", "derives", "cites")]), (F.col("turn") % 5 + 1).cast("int"))
    conf = 0.5 + ((F.col("conv_id") * 7 + F.col("turn") * 3) % 10) / 20.0
    return PropertyGraph(nodes, edges_of(e, tid, "NEXT", nxt, None, conf, kind))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns' NEXT edges, and an edge back from every assistant's turn to the one before, as (a, b, w): chains with cycles and bridges."""
    from .algorithms.iterative import edge_pairs

    t = table(spark, sf_dir, "conversations").filter("role = 'assistant' and turn > 0").select("conv_id", "turn").distinct()
    tid = lambda n: F.concat_ws(":", F.lit("turn"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(n.cast("string"), 4, "0"))
    return edge_pairs(turns(spark, sf_dir)).unionByName(t.select(tid(F.col("turn")).alias("a"), tid(F.col("turn") - 1).alias("b"), F.lit(1.0).alias("w")))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customer-supplier pairs as (a, b, w)."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(ref("customer", "o_custkey").alias("a"), ref("supplier", "l_suppkey").alias("b")).distinct().withColumn("w", F.lit(1.0))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with coordinates made from their keys: (id, lat, lon)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 1700 / 10.0 - 85).alias("lat"), ((F.col("c_custkey") * 91) % 3590 / 10.0 - 179.5).alias("lon"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(ref("vec", "vec_id").alias("id"), F.col("embedding").alias("vector"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")
