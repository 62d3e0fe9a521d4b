"""Catalogues, counts and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


def labels(g: PropertyGraph) -> DataFrame:
    return g.live_nodes.select(F.explode("labels").alias("label")).distinct().orderBy("label")


def edge_types(g: PropertyGraph) -> DataFrame:
    return g.live_edges.select("type").distinct().orderBy("type")


def property_keys(g: PropertyGraph) -> DataFrame:
    return g.live_nodes.select(F.explode(F.json_object_keys("properties")).alias("key")).distinct().orderBy("key")


def graph_stats(g: PropertyGraph) -> DataFrame:
    """One row: version, live counts, distinct labels, types and keys, indexable properties, estimated bytes."""
    n = g.live_nodes.agg(F.count(F.lit(1)).alias("node_count"), F.coalesce(F.sum(F.size("prop_tokens")), F.lit(0)).alias("property_index_entries"), F.coalesce(F.sum(F.octet_length("properties") + F.octet_length("id")), F.lit(0)).alias("node_bytes"))
    e = g.live_edges.agg(F.count(F.lit(1)).alias("edge_count"), F.count_distinct("type").alias("type_count"), F.coalesce(F.sum(F.octet_length("properties") + F.octet_length("id") + F.octet_length("from_id") + F.octet_length("to_id")), F.lit(0)).alias("edge_bytes"))
    c = labels(g).agg(F.count(F.lit(1)).alias("label_count"))
    k = property_keys(g).agg(F.count(F.lit(1)).alias("key_count"))
    one = F.lit(1).alias("_one")  # four tables of one row
    out = n.select("*", one).join(e.select("*", one), "_one").join(c.select("*", one), "_one").join(k.select("*", one), "_one")
    return out.select(F.lit(g.version).cast("long").alias("version"), "node_count", "edge_count", "label_count", "type_count", "key_count", "property_index_entries", (F.col("node_bytes") + F.col("edge_bytes")).alias("estimated_bytes"))


def verify(g: PropertyGraph) -> DataFrame:
    """Live edges with a missing or dead end: (edge_id, side, node_id, problem)."""
    ends = g.live_edges.select(F.col("id").alias("edge_id"), F.explode(F.map_from_arrays(F.array(F.lit("from"), F.lit("to")), F.array("from_id", "to_id"))).alias("side", "node_id"))
    all_ = g.nodes.select(F.col("id").alias("node_id"), "tombstone")
    out = ends.join(all_, "node_id", "left").filter(F.col("tombstone").isNull() | F.col("tombstone"))
    return out.select("edge_id", "side", "node_id", F.when(F.col("tombstone").isNull(), "missing_node").otherwise("tombstoned_node").alias("problem")).orderBy("edge_id", "side")


def degrees(g: PropertyGraph) -> DataFrame:
    """Out, in and total degree and strength (sum of effective confidences) of every edge end."""
    w = F.coalesce("confidence", F.lit(1.0)).alias("w")
    ends = g.live_edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), w).unionByName(g.live_edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), w))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def score_stats(scores: DataFrame, column: str = "score") -> DataFrame:
    """Count, min, max, mean and sum of scores."""
    return scores.agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.coalesce(F.sum(column), F.lit(0.0)).alias("sum"))


def schema_payload(g: PropertyGraph) -> dict:
    """Observed labels, types, keys, stats and whether the graph verifies."""
    return {
        "labels": [r[0] for r in labels(g).collect()],
        "edge_types": [r[0] for r in edge_types(g).collect()],
        "property_keys": [r[0] for r in property_keys(g).collect()],
        "stats": graph_stats(g).first().asDict(),
        "verified": verify(g).isEmpty(),
        "designations": [d.__dict__ for d in g.designations],
    }


def rebuild(g: PropertyGraph) -> tuple[PropertyGraph, DataFrame]:
    """Derive tokens and hashes again; the report counts records whose derived columns had drifted."""
    from ..model import as_edges, as_nodes

    nodes, edges = as_nodes(g.nodes.drop("prop_tokens", "content_hash")), as_edges(g.edges.drop("prop_tokens", "content_hash"))
    drift = g.nodes.alias("a").join(nodes.alias("b"), "id").agg(F.count_if(~F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))).alias("nodes_changed"))
    return g.with_(nodes=nodes, edges=edges), drift


def latency_quantile(values: DataFrame, column: str, q: float) -> DataFrame:
    """The element at place ceil((n - 1) q) of the sorted column."""
    listed = values.agg(F.array_sort(F.collect_list(column)).alias("v"))
    return listed.select(F.element_at("v", (F.ceil((F.size("v") - 1) * F.lit(q)) + 1).cast("int")).alias("value"))
