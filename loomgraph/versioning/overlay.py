"""A session's view: a base graph with a delta on top, the delta first."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..algorithms.iterative import edge_pairs
from ..algorithms.kernels import ppr, run_kernel
from ..functions.scalar import symbol_matches
from ..iterate import first_rows
from ..model import PropertyGraph, as_edges, as_nodes, token_text
from ..operators.match import of_kind, overlay_impact

impact = overlay_impact


def view(base: PropertyGraph, objects: DataFrame | None = None, edges: DataFrame | None = None, dead_objects: list[str] = (), removed_edges: list[str] = ()) -> PropertyGraph:
    """Base without tombstoned objects and removed edges, plus the delta's records; edges need both ends live."""
    spark = base.spark
    gone = spark.createDataFrame([(x,) for x in dead_objects], "id string")
    cut = spark.createDataFrame([(x,) for x in removed_edges], "id string")
    nodes, all_edges = base.live_nodes.join(gone, "id", "left_anti"), base.live_edges.join(cut, "id", "left_anti")
    if objects is not None:
        objects = as_nodes(objects).filter(~F.col("tombstone"))
        nodes = nodes.join(objects.select("id"), "id", "left_anti").unionByName(objects)
    if edges is not None:
        edges = as_edges(edges).filter(~F.col("tombstone"))
        all_edges = all_edges.join(edges.select("id"), "id", "left_anti").unionByName(edges)
    g = base.with_(nodes=nodes, edges=all_edges)
    return g.with_(edges=g.bound_edges)


def status(base: PropertyGraph, merged: PropertyGraph, delta_objects: DataFrame | None, delta_edges: DataFrame | None, dead: int = 0, removed: int = 0) -> dict:
    """Counts of the layers and a hash of the merged content."""
    h = merged.nodes.select("content_hash").unionByName(merged.edges.select("content_hash"))
    total = h.agg(F.coalesce(F.sum(F.xxhash64("content_hash").cast("decimal(38,0)")), F.lit(0)), F.count(F.lit(1))).first()
    return {
        "base_objects": base.live_nodes.count(), "base_edges": base.live_edges.count(), "delta_objects": delta_objects.count() if delta_objects is not None else 0, "delta_edges": delta_edges.count() if delta_edges is not None else 0,
        "tombstoned_objects": dead, "removed_edges": removed, "objects": merged.nodes.count(), "edges": merged.edges.count(), "merged_hash": "sha256:" + hashlib.sha256(f"{total[0]}:{total[1]}".encode()).hexdigest(),
    }


def ppr_scores(g: PropertyGraph, seeds: dict[str, float], top_k: int = 10, **options: float) -> DataFrame:
    """Personalised PageRank over the view's confidence-weighted edges: (id, score), best first."""
    out = run_kernel(edge_pairs(g), lambda pdf: ppr(pdf, seeds, **options), "id string, score double")
    return out.orderBy(F.desc("score"), "id").limit(top_k)


def related(g: PropertyGraph, node_id: str, kinds: list[str] = (), top_k: int = 10) -> DataFrame:
    """The best of four times as many PPR hits that are of a kind, without the seed."""
    hits = ppr_scores(g, {node_id: 1.0}, 4 * top_k).filter(F.col("id") != node_id)
    nodes = g.live_nodes.filter(of_kind(list(kinds))) if kinds else g.live_nodes
    return hits.join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(top_k)


FIELDS = ("name", "symbol", "title", "path", "text", "summary", "content", "signature", "doc")


def search(g: PropertyGraph, query: str, top_k: int | None = 10) -> DataFrame:
    """Substring search: each (term, field) pair that matches scores 2 for id and name, else 1: (id, score)."""
    terms = sorted({t for t in query.lower().split() if t})
    score = F.lit(0.0)
    for t in terms:
        score = score + F.when(F.contains(F.lower("id"), F.lit(t)), 2.0).otherwise(0.0)
        for f in FIELDS:
            text = F.lower(token_text(F.col("prop_tokens")[f]))
            score = score + F.when(F.coalesce(F.contains(text, F.lit(t)), F.lit(False)), 2.0 if f == "name" else 1.0).otherwise(0.0)
    return first_rows(g.live_nodes.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id"), top_k)


def resolve_symbol(g: PropertyGraph, symbol: str) -> str | None:
    """An exact id, else the smallest id whose tail or name matches."""
    names = F.filter(F.array(*[token_text(F.col("prop_tokens")[k]) for k in ("name", "symbol", "title")]), lambda x: x.isNotNull())
    hit = g.live_nodes.filter((F.col("id") == symbol) | symbol_matches(F.col("id"), names, symbol)).orderBy((F.col("id") != symbol), "id").select("id").first()
    return hit[0] if hit else None


def edges_from(g: PropertyGraph, node_id: str) -> DataFrame:
    return g.live_edges.filter(F.col("from_id") == node_id).orderBy("type", "to_id", "id")


def explain_edge(g: PropertyGraph, delta_edges: DataFrame | None, edge_id: str) -> DataFrame:
    """The edge with the layer that it comes from and its evidence strings."""
    delta = delta_edges.select(F.col("id").alias("_d")) if delta_edges is not None else g.spark.createDataFrame([], "_d string")
    e = g.live_edges.filter(F.col("id") == edge_id).join(delta, F.col("id") == F.col("_d"), "left")
    evidence = F.array_compact(F.array(F.concat(F.lit("confidence="), F.col("confidence").cast("string")), F.concat(F.lit("epistemic="), "epistemic_type"), F.concat(F.lit("source="), "provenance.source_id"), F.concat(F.lit("method="), "provenance.method")))
    return e.select("id", "from_id", "to_id", "type", F.when(F.col("_d").isNotNull(), "delta").otherwise("base").alias("layer"), evidence.alias("evidence"))


def project_rows(g: PropertyGraph, rows: DataFrame, prefix: str, label: str = "Row") -> PropertyGraph:
    """Keep nodes in step with a document's rows (row_id, title, fields map): upsert all, tombstone those that left."""
    from .mutate import tombstone_nodes, upsert_nodes

    props = F.to_json(F.map_concat(F.create_map(F.lit("title"), F.coalesce("title", F.lit(""))), F.coalesce("fields", F.create_map().cast("map<string,string>"))))
    new = rows.select(F.concat(F.lit(prefix + ":"), "row_id").alias("id"), F.array(F.lit(label)).alias("labels"), props.alias("properties"))
    out = upsert_nodes(g, new)
    left = out.live_nodes.filter(F.col("id").startswith(prefix + ":")).join(new.select("id"), "id", "left_anti").select("id")
    return tombstone_nodes(out, left) if not left.isEmpty() else out
