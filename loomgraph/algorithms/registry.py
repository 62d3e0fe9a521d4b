"""Operations by name: modes, argument checks, estimates, statistics, writes back to the graph."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphError, PropertyGraph
from ..operators import fulltext, match, paths, spatial, stats, vector
from . import iterative, kernels, similarity

MODES = ("estimate", "stream", "stats", "mutate")


@dataclass(frozen=True)
class Operation:
    name: str
    summary: str
    run: Callable[..., DataFrame]
    modes: tuple[str, ...] = ("stream",)
    args: dict[str, object] = field(default_factory=dict)  #: names with defaults; ... means required
    score: str = "score"
    node_bytes: tuple[int, int] = (48, 96)
    edge_bytes: int = 24


REGISTRY: dict[str, Operation] = {}


def register(op: Operation) -> Operation:
    """Add an operation; a plug-in calls this too."""
    if any(m not in MODES for m in op.modes):
        raise GraphError("unknown_mode", str(op.modes))
    REGISTRY[op.name] = op
    return op


#: JSON types by Python type of a default.
JSON_TYPES = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}


def schema(op: Operation) -> dict:
    """The JSON schema of an operation's arguments; a type is left open where the default doesn't show it."""
    known = {k: JSON_TYPES.get(type(v)) for k, v in op.args.items() if v is not ...}
    props = {k: ({"type": known[k], "default": v} if known.get(k) else {"default": v}) if v is not ... else {} for k, v in op.args.items()}
    return {"type": "object", "properties": props, "required": sorted(k for k, v in op.args.items() if v is ...), "additionalProperties": False}


def catalog() -> list[dict]:
    return [{"name": o.name, "summary": o.summary, "modes": ["estimate", *o.modes], "args": {k: "required" if v is ... else v for k, v in o.args.items()}, "schema": schema(o), "route": f"/algorithms/{o.name}"} for o in sorted(REGISTRY.values(), key=lambda o: o.name)]


@dataclass(frozen=True)
class Plugin:
    """What a plug-in brings: operations, and backends by kind ("spatial", "fulltext") and name."""

    name: str
    operations: tuple[Operation, ...] = ()
    backends: tuple[tuple[str, str, object], ...] = ()

    def capabilities(self) -> tuple[str, ...]:
        kinds = [k for k, _, _ in self.backends] + (["operations"] if self.operations else [])
        return tuple(sorted(set(kinds)))


PLUGINS: dict[str, Plugin] = {}
BACKENDS: dict[tuple[str, str], object] = {}


def install(plugin: Plugin) -> None:
    """Register all that a plug-in brings; a name that is taken, or an unknown kind, is an error and changes nothing."""
    if plugin.name in PLUGINS:
        raise GraphError("duplicate_plugin", plugin.name)
    for kind, name, _ in plugin.backends:
        if kind not in ("spatial", "fulltext"):
            raise GraphError("unknown_backend_kind", kind)
        if (kind, name) in BACKENDS:
            raise GraphError("duplicate_backend", f"{kind}/{name}")
    for op in plugin.operations:
        if op.name in REGISTRY:
            raise GraphError("duplicate_operation", op.name)
    for op in plugin.operations:
        register(op)
    BACKENDS.update({(kind, name): b for kind, name, b in plugin.backends})
    PLUGINS[plugin.name] = plugin


def backend(kind: str, name: str | None = None, environment: dict[str, str] | None = None) -> object:
    """A backend by name, else the one that the environment names (LOOMGRAPH_SPATIAL, LOOMGRAPH_FULLTEXT), else the built-in one."""
    env = os.environ if environment is None else environment
    wanted = name or env.get(f"LOOMGRAPH_{kind.upper()}") or "builtin"
    if (kind, wanted) not in BACKENDS:
        raise GraphError("unknown_backend", f"{kind}/{wanted}")
    return BACKENDS[kind, wanted]


def estimate(g: PropertyGraph, op: Operation) -> dict:
    """Bytes that a run may need, from the counts of ends and edges."""
    pairs = iterative.edge_pairs(g)
    n, m = iterative.ends(pairs).count(), pairs.count()
    return {"node_count": n, "edge_count": m, "bytes_min": 4096 + op.node_bytes[0] * n + op.edge_bytes * m, "bytes_max": 4096 + op.node_bytes[1] * n + op.edge_bytes * m}


def call(g: PropertyGraph, name: str, mode: str = "stream", **args: object):
    """Run an operation: stream gives its rows, stats one row about its scores, mutate a graph with the result as node properties."""
    op = REGISTRY.get(name)
    if op is None:
        raise GraphError("unknown_operation", name)
    if mode not in ("estimate", *op.modes):
        raise GraphError("unknown_mode", mode)
    if mode == "estimate":
        return estimate(g, op)
    prop = args.pop("property", name)
    unknown = set(args) - set(op.args)
    missing = [k for k, v in op.args.items() if v is ... and k not in args]
    if unknown or missing:
        raise GraphError("invalid_arguments", f"unknown {sorted(unknown)}, missing {missing}")
    full = {**{k: v for k, v in op.args.items() if v is not ...}, **args}
    top = full.pop("top_k", None) if mode != "stream" and name != "node_similarity" else full.pop("top_k", None) if "top_k" in full and name != "node_similarity" else None
    out = op.run(g, **full)
    if mode == "stats":
        return stats.score_stats(out, op.score)
    if mode == "mutate":
        return write_property(g, out, op.score, str(prop))
    if top:
        out = out.orderBy(F.desc(op.score), "id").limit(int(top))
    return out


def write_property(g: PropertyGraph, rows: DataFrame, column: str, prop: str) -> PropertyGraph:
    """Set a node property from (id, column); other properties stay."""
    from ..plans.planner import _merge_json
    from ..versioning.mutate import upsert_nodes

    j = g.live_nodes.join(rows.select("id", F.col(column).alias("_v")), "id")
    value = F.to_json(F.struct(F.col("_v").alias("v")))
    text = F.regexp_extract(value, r'^\{"v":(.*)\}$', 1)
    return upsert_nodes(g, j.select("id", "labels", _merge_json(F.col("properties"), {prop: text}).alias("properties")))


def _ppr(g: PropertyGraph, seeds: dict[str, float], alpha: float, epsilon: float, max_pushes: int, distributed: bool) -> DataFrame:
    pairs = iterative.edge_pairs(g)
    if distributed:
        return iterative.ppr_rounds(pairs, seeds, alpha, epsilon)
    return kernels.personalised(pairs, seeds, alpha, epsilon, max_pushes, kernels.KERNEL_EDGES)


def _components(g: PropertyGraph, directed: bool) -> DataFrame:
    pairs = iterative.edge_pairs(g)
    if directed:
        return kernels.run_kernel(pairs, kernels.forward_components, "id string, component string")
    return kernels.auto(pairs, kernels.components, iterative.components, "id string, component string")


def _pagerank(g: PropertyGraph, damping: float, max_iter: int, tolerance: float) -> DataFrame:
    return kernels.auto(iterative.edge_pairs(g), lambda pdf: kernels.pagerank(pdf, damping, max_iter, tolerance), lambda p: iterative.pagerank(p, damping, max_iter, tolerance), "id string, score double")


def _communities(g: PropertyGraph) -> DataFrame:
    return kernels.auto(iterative.edge_pairs(g), kernels.label_propagation, iterative.label_propagation, "id string, community int")


def _shortest(g: PropertyGraph, source: str, target: str, max_depth: int, weighted: bool) -> DataFrame:
    if weighted:
        path, cost = paths.shortest_path_weighted(g, source, target, max_depth)
    else:
        path = paths.shortest_path(g, source, target, max_depth)
        cost = float(len(path) - 1) if path else None
    return g.spark.createDataFrame([(i, v, cost) for i, v in enumerate(path)], "step int, id string, cost double")


def _similar(g: PropertyGraph, metric: str, degree_cutoff: int, similarity_cutoff: float, top_k: int, label: str | None) -> DataFrame:
    only = g.labelled(label).select("id") if label else None
    return similarity.node_similarity(iterative.edge_pairs(g), metric, degree_cutoff, similarity_cutoff, top_k, only)


def _links(g: PropertyGraph, pairs: list, node1: str | None, node2: str | None) -> DataFrame:
    wanted = [tuple(p) for p in pairs] + ([(node1, node2)] if node1 and node2 else [])
    return similarity.link_prediction(iterative.edge_pairs(g), g.spark.createDataFrame(wanted, "node1 string, node2 string"))


def _morphology(g: PropertyGraph, feature_property: str, iterations: int, relation_weights: dict) -> DataFrame:
    n = g.live_nodes.select("id", F.from_json(F.get_json_object("properties", f"$.{feature_property}"), "array<double>").alias("features")).filter("features is not null")
    e = g.live_edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", "confidence")
    return iterative.morphology_pass(n, e, iterations, relation_weights)


ALL = ("stream", "stats", "mutate")
register(Operation("pagerank", "Power iteration over all live edges", _pagerank, ALL, {"damping": 0.85, "max_iter": 100, "tolerance": 1e-6, "top_k": None}))
register(Operation("ppr", "Personalised PageRank by forward push", _ppr, ALL, {"seeds": ..., "alpha": 0.15, "epsilon": 1e-4, "max_pushes": 200_000, "top_k": None, "distributed": False}))
register(Operation("components", "Weakly connected components, or forward reachability", _components, ("stream", "mutate"), {"directed": False}, "component"))
register(Operation("communities", "Synchronous label propagation", _communities, ("stream", "mutate"), {}, "community"))
register(Operation("louvain", "Former name of communities", _communities, ("stream", "mutate"), {}, "community"))
register(Operation("leiden", "Connected communities by local moves, refinement and aggregation", lambda g, gamma, seed, max_levels: kernels.run_kernel(iterative.edge_pairs(g), lambda pdf: kernels.leiden(pdf, gamma, seed, max_levels), "id string, community int"), ("stream", "mutate"), {"gamma": 1.0, "seed": 0, "max_levels": 10}, "community"))
register(Operation("betweenness", "Brandes, exact or from sampled pivots", lambda g, directed, sample_size, seed: kernels.betweenness(iterative.edge_pairs(g), directed, sample_size, seed), ALL, {"directed": False, "sample_size": None, "seed": 0, "top_k": None}))
register(Operation("scc", "Strongly connected components", lambda g: kernels.auto(iterative.edge_pairs(g), kernels.strong_components, iterative.strong_components, "id string, component int", kernels.KERNEL_EDGES), ("stream", "mutate"), {}, "component"))
register(Operation("cut_points", "Articulation points and bridges", lambda g: kernels.per_component(iterative.edge_pairs(g), kernels.cut_points, "kind string, a string, b string")))
register(Operation("topological_sort", "Kahn's order, smallest id first", lambda g: kernels.run_kernel(iterative.edge_pairs(g), kernels.topological_sort, "position int, id string")))
register(Operation("node_similarity", "Jaccard or overlap of neighbour sets", _similar, ("stream", "stats"), {"metric": "jaccard", "degree_cutoff": 1, "similarity_cutoff": 0.0, "top_k": 10, "label": None}, "similarity"))
register(Operation("link_prediction", "Common neighbours, Adamic-Adar, resource allocation", _links, ("stream",), {"pairs": [], "node1": None, "node2": None}))
register(Operation("similarity_knn", "Nearest nodes by cosine", lambda g, label, prop, k, cutoff: vector.similarity_knn(g, label, prop, k, cutoff)[0], ("stream", "stats"), {"label": ..., "prop": ..., "k": 10, "cutoff": 0.0}, "similarity"))
register(Operation("shortest_path", "Fewest hops or least 1 - confidence", _shortest, ("stream",), {"source": ..., "target": ..., "max_depth": 16, "weighted": True}))
register(Operation("expand", "Nodes within some hops", lambda g, seeds, max_depth, weighted, min_confidence: match.expand(g, seeds, max_depth, min_confidence if weighted else None), ("stream",), {"seeds": ..., "max_depth": 3, "weighted": True, "min_confidence": 0.0}, "depth"))
register(Operation("morphological_message_passing", "Feature averages along typed edges", _morphology, ("stream",), {"feature_property": "features", "iterations": 1, "relation_weights": {}}))

install(Plugin("spatial", backends=(("spatial", "builtin", spatial), ("spatial", "grid", spatial.Grid))))
install(Plugin("fulltext", backends=(("fulltext", "builtin", fulltext), ("fulltext", "postings", fulltext.Postings))))
install(Plugin("echo", operations=(Operation("echo", "Its arguments, to try the interface", lambda g, message: g.spark.createDataFrame([(str(message),)], "message string"), ("stream",), {"message": ...}),)))
