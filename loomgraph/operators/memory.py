"""Agent memory: notes as nodes, recall, mentions, presence; and the agent-run records."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import atom_id, mentions
from ..iterate import first_rows
from ..model import PropertyGraph, token_number, token_text
from ..versioning.mutate import tombstone_nodes, upsert_nodes

FITNESS = 0.3


def remember(g: PropertyGraph, kind: str, title: str, content: str, actor: str = "", surface: str = "", fitness: float = 1.0, status: str = "active", updated_ms: int = 0) -> PropertyGraph:
    """Add a note under its content-derived id."""
    props = {"kind": kind, "title": title, "content": content, "actor": actor, "surface": surface, "fitness": float(fitness), "status": status, "updated_ms": updated_ms}
    one = g.spark.createDataFrame([(kind, json.dumps({"title": title, "content": content, "actor": actor}), json.dumps(props))], "kind string, payload string, properties string")
    return upsert_nodes(g, one.select(atom_id(F.col("kind"), F.col("payload")).alias("id"), F.array(F.lit("Memory")).alias("labels"), "properties"))


def revise(g: PropertyGraph, node_id: str, **changes: object) -> PropertyGraph:
    old = g.live_nodes.filter(F.col("id") == node_id).select("labels", "properties").first()
    if old is None:
        raise ValueError(f"unknown memory {node_id}")
    props = {**json.loads(old["properties"]), **changes}
    return upsert_nodes(g, g.spark.createDataFrame([(node_id, list(old["labels"]), json.dumps(props))], "id string, labels array<string>, properties string"))


def archive(g: PropertyGraph, node_id: str) -> PropertyGraph:
    return revise(g, node_id, status="archived")


def forget(g: PropertyGraph, node_id: str) -> PropertyGraph:
    return tombstone_nodes(g, g.spark.createDataFrame([(node_id,)], "id string"))


def recall(g: PropertyGraph, query: str = "", status: str | None = "active", actor: str | None = None, surface: str | None = None, kind: str | None = None, least_fitness: float = FITNESS, limit: int | None = 20) -> DataFrame:
    """Notes by equality on status, actor, surface, kind, a substring of title, content or summary, and fitness; fittest and newest first."""
    p = lambda k: F.col("prop_tokens")[k]
    out = g.live_nodes.filter(F.array_contains("labels", "Memory"))
    for k, v in (("status", status), ("actor", actor), ("surface", surface), ("kind", kind)):
        if v is not None:
            out = out.filter(p(k) == f"str:{v}")
    if query:
        q = F.lit(query.lower())
        hit = F.lit(False)
        for k in ("title", "content", "summary"):
            hit = hit | F.coalesce(F.contains(F.lower(token_text(p(k))), q), F.lit(False))
        out = out.filter(hit)
    fitness = F.coalesce(token_number(p("fitness")), F.lit(1.0))
    out = out.select("id", token_text(p("kind")).alias("kind"), token_text(p("title")).alias("title"), token_text(p("content")).alias("content"), fitness.alias("fitness"), F.coalesce(token_number(p("updated_ms")), F.lit(0.0)).cast("long").alias("updated_ms"))
    return first_rows(out.filter(F.col("fitness") >= least_fitness).orderBy(F.desc("fitness"), F.desc("updated_ms"), "id"), limit)


def mentioned(texts: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, place, name) of @mentions outside code."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(mentions(F.col(text))).alias("place", "name"))


def wait_for_mentions(read: Callable[[], DataFrame], name: str, timeout_s: float = 30.0, every_s: float = 0.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Ids of texts that mention ``name``, as soon as there are any; empty after the timeout. ``read`` gives the texts (id, text) as they are now."""
    end = clock() + timeout_s
    while True:
        found = [r[0] for r in mentioned(read()).filter(F.col("name") == name).select("id").distinct().orderBy("id").collect()]
        if found or clock() >= end:
            return found
        sleep(min(every_s, max(0.0, end - clock())))


def presence(beats: DataFrame, now_ms: int, ttl_ms: int = 60_000) -> DataFrame:
    """(actor, surface, last_ms) of actors whose last heartbeat is recent."""
    return beats.groupBy("actor", "surface").agg(F.max("at_ms").alias("last_ms")).filter(F.col("last_ms") >= now_ms - ttl_ms)


# --------------------------------------------------------------------------- agent runs


def run_graph(runs: DataFrame, steps: DataFrame) -> PropertyGraph:
    """Runs (run_id, goal, status) and steps (run_id, seq, tool, status) as nodes, HAS_STEP and NEXT edges."""
    r = runs.select(F.concat(F.lit("run:"), "run_id").alias("id"), F.array(F.lit("AgentRun")).alias("labels"), F.to_json(F.struct("goal", "status")).alias("properties"))
    sid = F.concat(F.lit("step:"), "run_id", F.lit(":"), F.col("seq").cast("string"))
    s = steps.select(sid.alias("id"), F.array(F.lit("AgentStep")).alias("labels"), F.to_json(F.struct("seq", "tool", "status")).alias("properties"))
    has = steps.select(F.concat(F.lit("run:"), "run_id").alias("from_id"), sid.alias("to_id"), F.lit("HAS_STEP").alias("type"))
    from pyspark.sql import Window

    before = F.lag(sid).over(Window.partitionBy("run_id").orderBy("seq"))
    nxt = steps.select(before.alias("from_id"), sid.alias("to_id"), F.lit("NEXT").alias("type")).filter("from_id is not null")
    e = has.unionByName(nxt).select(F.concat_ws("|", "from_id", "type", "to_id").alias("id"), "from_id", "to_id", "type")
    return PropertyGraph.of(r.unionByName(s), e)


# The tools of a compiled toolkit and the skill that asks for each.
TOOLS = (("graph.query", "query"), ("graph.neighbors", "traverse"), ("graph.upsert", "write"))


def toolkit(skills: list[str] | None = None) -> list[str]:
    """Names of the static tools, only those of the asked skills if any are named."""
    return [t for t, s in TOOLS if not skills or s in skills]
