"""Node queries, neighbours, pattern expansion: the joins of a graph engine as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..iterate import distinct_by, settle
from ..model import GraphError, PropertyGraph, effective_confidence, token_of

DEFAULT_LIMIT = 100


def has_label(label: str) -> Column:
    return F.array_contains("labels", label)


def token_equals(key: str, value: object) -> Column:
    """A property equals a scalar, type included; an explicit null matches only an explicit null; lists and objects never match."""
    t = token_of(value)
    return F.lit(False) if t is None else F.coalesce(F.col("prop_tokens")[F.lit(key)] == t, F.lit(False))


def target_equals(key: str, value: object) -> Column:
    """As :func:`token_equals`, but on pattern targets a null also matches a missing key."""
    c = F.col("prop_tokens")[F.lit(key)]
    return F.coalesce(c, F.lit("null")) == "null" if value is None else token_equals(key, value)


def node_query(g: PropertyGraph, label: str | None = None, properties: dict[str, object] | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Live nodes with the label and all property values, by id; limit None is no limit, absent or 0 the default."""
    out = g.labelled(label)
    for k, v in (properties or {}).items():
        out = out.filter(token_equals(k, v))
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit or DEFAULT_LIMIT)


def get_node(g: PropertyGraph, node_id: str) -> DataFrame:
    return g.live_nodes.filter(F.col("id") == node_id)


def get_edge(g: PropertyGraph, edge_id: str) -> DataFrame:
    return g.live_edges.filter(F.col("id") == edge_id)


def property_ids(g: PropertyGraph, key: str, value: object) -> DataFrame:
    return g.live_nodes.filter(token_equals(key, value)).select("id").orderBy("id")


def label_ids(g: PropertyGraph, label: str) -> DataFrame:
    return g.labelled(label).select("id").orderBy("id")


def type_ids(g: PropertyGraph, edge_type: str) -> DataFrame:
    return g.typed(edge_type).select("id").orderBy("id")


def of_kind(kinds: list[str]) -> Column:
    """A label or the property ``kind`` is one of ``kinds``, ignoring case."""
    low = [k.lower() for k in kinds]
    return F.exists("labels", lambda x: F.lower(x).isin(low)) | F.coalesce(F.lower(F.col("prop_tokens")["kind"]).isin([f"str:{k}" for k in low]), F.lit(False))


def edge_filter(edges: DataFrame, edge_type: str | None = None, min_confidence: float | None = None, epistemic_types: list[str] | None = None) -> DataFrame:
    if edge_type is not None:
        edges = edges.filter(F.col("type") == edge_type)
    if min_confidence is not None and min_confidence > 0:
        edges = edges.filter(effective_confidence() >= min_confidence)
    if epistemic_types:
        edges = edges.filter(F.col("epistemic_type").isin([t.lower() for t in epistemic_types]))
    return edges


def neighbors(g: PropertyGraph, node_id: str, direction: str = "out", edge_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Hits (edge_id, node_id, type, confidence) in edge-id order; edges to dead nodes are hidden; parallel edges give one hit each."""
    if direction not in ("out", "in"):
        raise GraphError("unknown_direction", direction)
    near, far = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    e = edge_filter(g.live_edges.filter(F.col(near) == node_id), edge_type).select(F.col("id").alias("edge_id"), F.col(far).alias("node_id"), "type", "confidence")
    out = e.join(g.live_nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("edge_id", "node_id", "type", "confidence").orderBy("edge_id")
    return out if limit is None else out.limit(limit)


def structured_query(g: PropertyGraph, q: dict) -> tuple[DataFrame, dict]:
    """``node_match`` or ``neighbors`` with a limit of 1 to 1000 (default 100); one more row is fetched to tell truncation."""
    limit = q.get("limit", DEFAULT_LIMIT)
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise GraphError("invalid_limit", str(limit))
    limit = min(limit, 1000)
    op = q.get("operation")
    if op == "node_match":
        rows = node_query(g, q.get("label"), q.get("properties"), limit + 1)
    elif op == "neighbors":
        rows = neighbors(g, q["node_id"], q.get("direction", "out"), q.get("edge_type"), limit + 1)
    else:
        raise GraphError("unknown_operation", str(op))
    plan = {"operation": op, "limit": limit, "steps": ["node_index_scan" if q.get("label") or q.get("properties") else "node_scan"] if op == "node_match" else ["adjacency_expand", "live_far_end"]}
    return rows, plan


def structured_rows(rows: DataFrame, plan: dict) -> dict:
    """Rows up to the limit and whether there were more."""
    got = rows.collect()
    return {"rows": [r.asDict(recursive=True) for r in got[: plan["limit"]]], "truncated": len(got) > plan["limit"], "explain": plan}


# --------------------------------------------------------------------------- patterns


def hop(left: DataFrame, edges: DataFrame, nodes: DataFrame, edge_type: str | None, step: int) -> DataFrame:
    """Extend rows that end in ``n{step-1}`` by one edge and node (``n{step}``); duplicates are kept."""
    e = edge_filter(edges, edge_type).select(F.col("from_id").alias("_from"), F.col("to_id").alias("_to"))
    n = nodes.select(F.struct("*").alias(f"n{step}"))
    return left.join(e, F.col(f"n{step - 1}.id") == F.col("_from")).join(n, F.col("_to") == F.col(f"n{step}.id")).drop("_from", "_to")


def chain(g: PropertyGraph, patterns: list[tuple[str | None, list[Column]]], types: list[str]) -> DataFrame:
    """Walks along node patterns (label, predicates) joined by edge types; nodes and edges may repeat. Columns n0, n1, ..."""

    def matching(pattern: tuple[str | None, list[Column]]) -> DataFrame:
        label, tests = pattern
        out = g.labelled(label)
        for t in tests:
            out = out.filter(t)
        return out

    rows = matching(patterns[0]).select(F.struct("*").alias("n0"))
    for i, t in enumerate(types, 1):
        rows = hop(rows, g.live_edges, matching(patterns[i]), t, i)
    return rows


def var_length(
    g: PropertyGraph, seeds: DataFrame, edge_type: str | None, low: int = 1, high: int = 8, target: DataFrame | None = None
) -> DataFrame:
    """Shortest-hop reachability from each seed id: rows (seed, id, depth, path), one per seed and target.

    Every seed has its own visited set and never returns to itself. From depth ``low`` on a node outside ``target`` is
    skipped without being marked or passed through; below that all nodes pass. Zero hops are never given.
    """
    if high < 1 or low > high:
        raise GraphError("invalid_range", f"{low}..{high}")
    nodes = g.live_nodes.select("id")
    edges = settle(g.typed(edge_type).select("from_id", "to_id").join(nodes.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
    allowed = None if target is None else target.select("id").distinct()
    frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("id"), F.array("id").alias("path"))
    visited = settle(frontier.select("seed", "id", F.lit(0).alias("depth"), "path"))
    frontier = visited.select("seed", "id", "path")
    for depth in range(1, high + 1):
        step = frontier.join(edges, frontier["id"] == edges["from_id"]).select("seed", F.col("to_id").alias("id"), F.concat("path", F.array("to_id")).alias("path"))
        if depth >= low and allowed is not None:
            step = step.join(allowed, "id", "left_semi")
        step = step.join(visited.select("seed", "id"), ["seed", "id"], "left_anti").groupBy("seed", "id").agg(F.min("path").alias("path"))
        step = settle(step.select("seed", "id", F.lit(depth).alias("depth"), "path"))
        if step.isEmpty():
            break
        visited = settle(visited.unionByName(step))
        frontier = step.select("seed", "id", "path")
    return visited.filter(F.col("depth") >= max(low, 1))


def epistemic_neighbors(g: PropertyGraph, node_id: str, epistemic_types: list[str] | None = None, min_confidence: float = 0.0, max_depth: int = 1) -> DataFrame:
    """Undirected breadth-first visit over filtered edges: (edge_id, id, depth); the first visiting edge wins.

    Within a level the winner has the earliest-found parent, then out-edges before in-edges, then the smaller edge id.
    """
    e = edge_filter(g.bound_edges, None, min_confidence, epistemic_types)
    both = settle(
        e.select(F.col("id").alias("edge_id"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(0).alias("dir"))
        .unionByName(e.select(F.col("id").alias("edge_id"), F.col("to_id").alias("a"), F.col("from_id").alias("b"), F.lit(1).alias("dir")))
    )
    seen = settle(get_node(g, node_id).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_id"), F.array(F.struct(F.lit(0).alias("dir"), F.lit("").alias("edge"))).alias("rank")))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id"), F.lit(depth).alias("depth"), both["edge_id"], F.concat("rank", F.array(F.struct(F.col("dir"), both["edge_id"].alias("edge")))).alias("rank"))
        step = settle(distinct_by(step.join(seen.select("id"), "id", "left_anti"), ["id"], "rank"))
        if step.isEmpty():
            break
        seen, front = settle(seen.unionByName(step)), step
    return seen.filter("depth > 0").orderBy("rank").select("edge_id", "id", "depth")


def expand(g: PropertyGraph, seeds: list[str], max_depth: int = 3, min_confidence: float | None = None, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """Nodes within ``max_depth`` hops of the seeds with their least depth, seeds included at 0, by (depth, id).

    With ``min_confidence`` only edges of at least that effective confidence are walked.
    """
    e = edge_filter(g.live_edges, edge_type, min_confidence)
    pairs = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    if direction == "in":
        pairs = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    elif direction == "both":
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = settle(pairs.distinct())
    start = g.spark.createDataFrame([(s,) for s in sorted(set(seeds))], "id string")
    return reach(start, pairs, max_depth).orderBy("depth", "id")


def reach(start: DataFrame, pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """Breadth-first closure of (a, b) pairs from start ids: (id, depth). Without a bound until nothing is new."""
    seen = settle(start.select("id", F.lit(0).alias("depth")).distinct())
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(pairs, front["id"] == pairs["a"], "inner").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        step = settle(step)
        if step.isEmpty():
            break
        seen, front = settle(seen.unionByName(step)), step
    return seen


def overlay_impact(g: PropertyGraph, node_id: str, direction: str = "out", max_depth: int = 2) -> DataFrame:
    """Reached nodes without the seed, by (depth, id); an unknown seed reaches nothing."""
    if get_node(g, node_id).isEmpty():
        return g.spark.createDataFrame([], "id string, depth int")
    inside = g.with_(edges=g.bound_edges)
    return expand(inside, [node_id], max_depth, None, direction).filter(F.col("id") != node_id).orderBy("depth", "id")
