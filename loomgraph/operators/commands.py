"""Graph commands by name, for callers that send text: each takes a dict and gives the graph after it and a result."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphError, PropertyGraph
from ..plans.planner import cypher
from ..versioning import mutate, snapshot
from . import match, stats


def _one(g: PropertyGraph, args: dict, keys: tuple[str, ...]) -> DataFrame:
    """A record of text fields as a table of one row, with labels and properties where given."""
    fields = {k: args.get(k) for k in keys}
    missing = [k for k in keys if not isinstance(fields[k], str) or not fields[k].strip()]
    if missing:
        raise GraphError("empty_graph_field", missing[0])
    row = g.spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in keys))
    if "labels" in args:
        row = row.withColumn("labels", F.lit(list(args["labels"])).cast("array<string>"))
    if args.get("confidence") is not None:
        row = row.withColumn("confidence", F.lit(float(args["confidence"])))
    return row.withColumn("properties", F.lit(json.dumps(args.get("properties", {}))))


def debug_match(g: PropertyGraph, text: str) -> DataFrame:
    """Two literal shapes, all live nodes of a label or all live edges of a type; any other text gives no row."""
    text = " ".join(text.split())
    if m := re.fullmatch(r"MATCH \(n:([^\s)]+).*RETURN n", text):
        return g.labelled(m[1])
    if m := re.match(r"MATCH \(a\)-\[e:([^\]]*)\]->\(b\) RETURN a, e, b", text):
        return g.typed(m[1])
    return g.live_nodes.limit(0)


def _rebuilt(g: PropertyGraph) -> tuple[PropertyGraph, DataFrame]:
    return stats.rebuild(g)


def _read(f: Callable[[PropertyGraph, dict], object]) -> Callable[[PropertyGraph, dict], tuple[PropertyGraph, object]]:
    return lambda g, args: (g, f(g, args))


def _write(f: Callable[[PropertyGraph, dict], PropertyGraph]) -> Callable[[PropertyGraph, dict], tuple[PropertyGraph, object]]:
    def run(g: PropertyGraph, args: dict) -> tuple[PropertyGraph, object]:
        out = f(g, args)
        return out, {"id": args.get("id"), "version": out.version}

    return run


COMMANDS: dict[str, Callable[[PropertyGraph, dict], tuple[PropertyGraph, object]]] = {
    "graph.node.upsert": _write(lambda g, a: mutate.upsert_nodes(g, _one(g, a, ("id",)))),
    "graph.edge.upsert": _write(lambda g, a: mutate.upsert_edges(g, _one(g, a, ("id", "from_id", "to_id", "type")))),
    "graph.nodes.query": _read(lambda g, a: match.node_query(g, a.get("label"), a.get("properties"), a.get("limit", match.DEFAULT_LIMIT))),
    "graph.neighbors": _read(lambda g, a: match.neighbors(g, a["node_id"], a.get("direction", "out"), a.get("edge_type"), (a.get("budget") or {}).get("max_nodes_returned", a.get("limit", match.DEFAULT_LIMIT)))),
    "graph.stats": _read(lambda g, a: stats.graph_stats(g)),
    "graph.verify": _read(lambda g, a: stats.verify(g)),
    "graph.rebuild": lambda g, a: _rebuilt(g),
    "state.hash": _read(lambda g, a: snapshot.root_hash(g)),
    "cypher": _read(lambda g, a: cypher(g, a["query"], a.get("params"))),
    "debug.match": _read(lambda g, a: debug_match(g, a["query"])),
}


def run(g: PropertyGraph, name: str, args: dict) -> tuple[PropertyGraph, object]:
    """Run a command; names are trimmed and their case doesn't matter."""
    command = COMMANDS.get(name.strip().lower())
    if command is None:
        raise GraphError("unsupported_command", name)
    return command(g, args)
