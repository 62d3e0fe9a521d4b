"""A versioned store: every commit is a new folder of Parquet tables, published by creating the next numbered manifest last."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..model import EDGE_SCHEMA, NODE_SCHEMA, GraphError, PropertyGraph

FORMAT = 1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False if it is. The file system's own exclusive create decides between two writers."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of manifests, the latest first."""
    fs, p = _fs(spark, f"{root}/manifests")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(((int(n[:-5]), f"{root}/manifests/{n}") for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _latest(spark: SparkSession, root: str) -> dict | None:
    """The latest manifest that was written to its end; one that a crash cut short is passed over."""
    for _, path in _published(spark, root):
        try:
            return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
        except json.JSONDecodeError:
            continue
    return None


def manifest(spark: SparkSession, root: str) -> dict | None:
    m = _latest(spark, root)
    if m and m["format"] > FORMAT:
        raise GraphError("newer_format", str(m["format"]))
    return m


def save(g: PropertyGraph, root: str, expect_version: int | None = None, keep: int = 2) -> dict:
    """Publish a graph as a new numbered manifest, which only one writer can create. With ``expect_version`` the publish
    fails if the store has moved, also between the check and the publish. Edges are dealt by source, so that readers can
    prune and join on it; folders older than the last ``keep`` are deleted after the publish."""
    spark = g.spark
    now = manifest(spark, root)
    have = now["version"] if now else 0
    if expect_version is not None and have != expect_version:
        raise GraphError("version_conflict", f"{have} != {expect_version}")
    number = next((n for n, _ in _published(spark, root)), 0) + 1
    version = max(g.version, have + 1)
    folder = f"v{version:012d}-{uuid.uuid4().hex[:8]}"
    g.nodes.select(*NODE_SCHEMA.names).write.parquet(f"{root}/{folder}/nodes")
    g.edges.select(*EDGE_SCHEMA.names).repartition("from_id").sortWithinPartitions("from_id", "type").write.parquet(f"{root}/{folder}/edges")
    m = {"format": FORMAT, "version": version, "folder": folder, "tenant": g.tenant, "previous": ([now["folder"], *now.get("previous", [])][: keep - 1] if now else [])}
    if not _create(spark, f"{root}/manifests/{number:012d}.json", json.dumps(m)):
        fs, p = _fs(spark, f"{root}/{folder}")
        fs.delete(p, True)
        raise GraphError("version_conflict", f"another writer published {number}")
    for old in ([now["folder"], *now.get("previous", [])] if now else [])[keep - 1 :]:
        fs, p = _fs(spark, f"{root}/{old}")
        fs.delete(p, True)
    return m


def load(spark: SparkSession, root: str) -> PropertyGraph:
    m = manifest(spark, root)
    if m is None:
        raise GraphError("no_manifest", root)
    base = f"{root}/{m['folder']}"
    return PropertyGraph(spark.read.schema(NODE_SCHEMA).parquet(f"{base}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{base}/edges"), m["version"], tenant=m.get("tenant", "default"))


def upgrade(spark: SparkSession, root: str) -> dict:
    """Publish the manifest of an older format anew; newer ones are refused."""
    m = _latest(spark, root)
    if m is None:
        raise GraphError("no_manifest", root)
    if m.get("format", 0) > FORMAT:
        raise GraphError("newer_format", str(m["format"]))
    if m.get("format", 0) < FORMAT:
        m = {**m, "format": FORMAT, "previous": m.get("previous", [])}
        number = _published(spark, root)[0][0] + 1
        if not _create(spark, f"{root}/manifests/{number:012d}.json", json.dumps(m)):
            raise GraphError("version_conflict", f"another writer published {number}")
    return m
