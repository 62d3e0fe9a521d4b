"""Writes: upserts, tombstones, batches, transactions. Every write is a new pair of tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import numbered, settle
from ..model import EDGE_SCHEMA, NODE_SCHEMA, GraphError, PropertyGraph, as_edges, as_nodes


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def _latest(df: DataFrame, seq: str) -> DataFrame:
    """The last record of each id in the order of ``seq``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(seq)))).filter("_rn = 1").drop("_rn")


def _merge(old: DataFrame, new: DataFrame, names: list[str]) -> DataFrame:
    """Replace whole records by id; a parent hash is noted where the content changed and the writer gave none."""
    o = old.select(F.col("id").alias("_id"), F.col("content_hash").alias("_old"), F.col("parent_hashes").alias("_parents"))
    j = new.join(o, F.col("id") == F.col("_id"), "left")
    changed = F.col("_old").isNotNull() & (F.col("_old") != F.col("content_hash"))
    parents = F.when(F.size("parent_hashes") > 0, F.col("parent_hashes")).when(changed, F.array("_old")).when(F.col("_old").isNotNull(), F.col("_parents")).otherwise(F.col("parent_hashes"))
    fresh = j.withColumn("parent_hashes", parents).select(*names)
    return old.join(new.select("id"), "id", "left_anti").select(*names).unionByName(fresh)


def upsert_nodes(g: PropertyGraph, rows: DataFrame, seq: str | None = None) -> PropertyGraph:
    """Replace or add nodes; blank ids raise. Several records of one id apply in order, the last stands."""
    if not rows.filter(_blank("id")).isEmpty():
        raise GraphError("blank_node_id")
    order = rows.select("id", *([F.col(seq).alias("_seq")] if seq else [F.xxhash64("id").alias("_seq")]), *[c for c in rows.columns if c not in ("id", seq)])
    keep = numbered(order, "_seq", "id")
    last = settle(_latest(keep, "_n"))
    new = as_nodes(last.withColumn("version", F.lit(g.version) + F.col("_n")))
    n = keep.count()
    return g.with_(nodes=_merge(g.nodes, new, NODE_SCHEMA.names), version=g.version + n)


def rejects(g: PropertyGraph, rows: DataFrame, extra_nodes: DataFrame | None = None) -> DataFrame:
    """Edge records that may not be written: (id, code). Blank fields, missing and tombstoned ends."""
    known = g.nodes.select("id", "tombstone")
    if extra_nodes is not None:
        known = known.join(extra_nodes.select("id"), "id", "left_anti").unionByName(extra_nodes.select("id", "tombstone"))
    ends = known.select(F.col("id").alias("_e"), F.col("tombstone").alias("_dead"))
    out = rows.join(ends.withColumnsRenamed({"_e": "_f", "_dead": "_fd"}), F.col("from_id") == F.col("_f"), "left").join(ends.withColumnsRenamed({"_e": "_t", "_dead": "_td"}), F.col("to_id") == F.col("_t"), "left")
    dead = F.coalesce("tombstone", F.lit(False)) if "tombstone" in rows.columns else F.lit(False)
    code = (
        F.when(_blank("id"), "blank_edge_id").when(_blank("from_id") | _blank("to_id"), "blank_edge_endpoint").when(_blank("type"), "blank_edge_type")
        .when(~dead & (F.col("_f").isNull() | F.col("_t").isNull()), "missing_endpoint").when(~dead & (F.col("_fd") | F.col("_td")), "tombstoned_endpoint")
    )
    return out.select("id", code.alias("code")).filter("code is not null")


def upsert_edges(g: PropertyGraph, rows: DataFrame, seq: str | None = None, checked: bool = False) -> PropertyGraph:
    """Replace or add edges; both ends must be live nodes (a tombstone needs no ends), unless the caller has ``checked`` that with :func:`rejects`."""
    if not checked:
        rows = settle(rows)
        bad = rejects(g, rows).first()
        if bad:
            raise GraphError(bad["code"], str(bad["id"]))
    keep = numbered(rows, *([seq] if seq else []), "id")
    last = settle(_latest(keep, "_n"))
    new = as_edges(last.withColumn("version", F.lit(g.version) + F.col("_n")))
    return g.with_(edges=_merge(g.edges, new, EDGE_SCHEMA.names), version=g.version + keep.count())


def tombstone_nodes(g: PropertyGraph, ids: DataFrame, detach: bool = False) -> PropertyGraph:
    """Mark nodes dead; edges stay unless ``detach``, which marks incident live edges first."""
    if detach:
        hit = ids.select("id").distinct()
        e = g.live_edges
        inc = e.join(hit.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("id").unionByName(e.join(hit.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("id")).distinct()
        g = tombstone_edges(g, inc)
    rows = g.live_nodes.join(ids.select("id").distinct(), "id", "left_semi").withColumn("tombstone", F.lit(True))
    return upsert_nodes(g, rows.select("id", "labels", "properties", "tombstone"))


def tombstone_edges(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    rows = g.live_edges.join(ids.select("id").distinct(), "id", "left_semi").withColumn("tombstone", F.lit(True))
    return upsert_edges(g, rows.drop("content_hash", "version", "parent_hashes", "prop_tokens"))


def commit_batch(g: PropertyGraph, nodes: DataFrame | None, edges: DataFrame | None, quota_bytes: int | None = None) -> tuple[PropertyGraph, DataFrame]:
    """All or nothing: nodes then edges; an empty batch and a batch over the quota are errors. Also (id, version, checksum) of the writes."""
    n = 0 if nodes is None else nodes.count()
    m = 0 if edges is None else edges.count()
    if n + m == 0:
        raise GraphError("empty_batch")
    out = g
    if n:
        out = upsert_nodes(out, nodes)
    if m:
        out = upsert_edges(out, edges)
    if quota_bytes is not None:
        used = estimated_bytes(out)
        if used > quota_bytes:
            raise GraphError("memory_quota_exceeded", f"{used} > {quota_bytes}")
    writes = out.nodes.filter(F.col("version") > g.version).select("id", "version", F.col("content_hash").alias("checksum")).unionByName(out.edges.filter(F.col("version") > g.version).select("id", "version", F.col("content_hash").alias("checksum")))
    return out, writes.orderBy("version")


def estimated_bytes(g: PropertyGraph) -> int:
    a = g.nodes.agg(F.sum(F.octet_length("id") + F.octet_length("properties"))).first()[0] or 0
    b = g.edges.agg(F.sum(F.octet_length("id") + F.octet_length("from_id") + F.octet_length("to_id") + F.octet_length("properties"))).first()[0] or 0
    return int(a + b)


@dataclass
class Transactions:
    """Optimistic transactions on one graph: a commit fails if the graph moved since begin; idle ones expire."""

    graph: PropertyGraph
    ttl_seconds: float = 300.0
    clock: object = time.monotonic
    open: dict[str, dict] = field(default_factory=dict)

    def begin(self, tenant: str = "default") -> str:
        self._expire()
        tx = uuid.uuid4().hex
        self.open[tx] = {"tenant": tenant, "version": self.graph.version, "at": self.clock(), "nodes": [], "edges": []}
        return tx

    def _expire(self) -> None:
        now = self.clock()
        self.open = {k: v for k, v in self.open.items() if now - v["at"] <= self.ttl_seconds}

    def _get(self, tx: str, tenant: str) -> dict:
        self._expire()
        if tx not in self.open:
            raise GraphError("transaction_not_found", tx)
        if self.open[tx]["tenant"] != tenant:
            raise GraphError("tenant_mismatch", tx)
        return self.open[tx]

    def stage(self, tx: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, tenant: str = "default") -> None:
        t = self._get(tx, tenant)
        t["nodes"] += [nodes] if nodes is not None else []
        t["edges"] += [edges] if edges is not None else []

    def commit(self, tx: str, tenant: str = "default") -> PropertyGraph:
        t = self._get(tx, tenant)
        if t["version"] != self.graph.version:
            del self.open[tx]
            raise GraphError("transaction_conflict", f"version {t['version']} is now {self.graph.version}")
        out = self.graph
        for n in t["nodes"]:
            out = upsert_nodes(out, n)
        for e in t["edges"]:
            out = upsert_edges(out, e)
        del self.open[tx]
        self.graph = out
        return out

    def rollback(self, tx: str, tenant: str = "default") -> None:
        self._get(tx, tenant)
        del self.open[tx]
