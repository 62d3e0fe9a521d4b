"""Content objects, tree hashes, commits, refs, diff and three-way merge."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..iterate import settle
from ..model import EDGE_SCHEMA, NODE_SCHEMA, GraphError, PropertyGraph

CHUNK_MOST, CHUNK_LEAST = 16, 4


def content_objects(g: PropertyGraph) -> DataFrame:
    """(key, kind, hash, parents) in any order; keys are node/<id> and edge/<id>."""
    n = g.nodes.select(F.concat(F.lit("node/"), "id").alias("key"), F.lit("node").alias("kind"), F.col("content_hash").alias("hash"), F.col("parent_hashes").alias("parents"))
    e = g.edges.select(F.concat(F.lit("edge/"), "id").alias("key"), F.lit("edge").alias("kind"), F.col("content_hash").alias("hash"), F.col("parent_hashes").alias("parents"))
    return n.unionByName(e)


def _chunks(entries: list[tuple[str, str]], last: bool = True) -> list[list[tuple[str, str]]]:
    """Chunks end at 16 entries, or from 4 on where a hash's last digit is one of 0, 4, 8, c; an open one is left out unless it is the ``last``."""
    out: list[list[tuple[str, str]]] = []
    now: list[tuple[str, str]] = []
    for key, h in entries:
        now.append((key, h))
        if len(now) >= CHUNK_MOST or (len(now) >= CHUNK_LEAST and h[-1] in "048c"):
            out.append(now)
            now = []
    return out + [now] if now and last else out


def _hashed(chunks: list[list[tuple[str, str]]]) -> list[tuple[str, str]]:
    return [(c[0][0], "sha256:" + hashlib.sha256(json.dumps(c, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()) for c in chunks]


def _upper(entries: list[tuple[str, str]], level: int) -> list[tuple[int, str, str]]:
    """All levels above sorted ``entries``, the entries left out."""
    rows: list[tuple[int, str, str]] = []
    while len(entries) > 1 or not rows:
        entries = _hashed(_chunks(entries)) if entries else [("", "sha256:" + hashlib.sha256(b"[]").hexdigest())]
        level += 1
        rows += [(level, k, h) for k, h in entries]
    return rows


_TREE = "level int, key string, hash string"


def _open_after(hashes: list[str], have: int) -> int:
    """Entries of the open chunk after reading hashes with ``have`` already in it."""
    for h in hashes:
        have += 1
        if have >= CHUNK_MOST or (have >= CHUNK_LEAST and h[-1] in "048c"):
            have = 0
    return have


def _next_level(entries: DataFrame, level: int) -> DataFrame:
    """One level over many ranges, the same as in one task.

    All that a range must know of those before is the open chunk that they leave. Each range says for all 16 sizes of
    such a chunk what it leaves itself, with its last entries; the driver follows these from range to range.
    """
    ranges = settle(entries.repartitionByRange("key").withColumn("part", F.spark_partition_id()))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        h, tail = pdf["hash"].tolist(), pdf.tail(CHUNK_MOST - 1)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "leaves": [[_open_after(h, k) for k in range(CHUNK_MOST)]], "keys": [tail["key"].tolist()], "hashes": [tail["hash"].tolist()]})

    before: dict[int, list[tuple[str, str]]] = {}
    open_: list[tuple[str, str]] = []
    for r in ranges.groupBy("part").applyInPandas(summary, "part int, leaves array<int>, keys array<string>, hashes array<string>").orderBy("part").collect():  # 15 entries a range
        before[r["part"]], left = open_, r["leaves"][len(open_)]
        open_ = (open_ + list(zip(r["keys"], r["hashes"])))[-left:] if left else []
    end = max(before)

    def chunked(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        own = sorted(zip(pdf["key"], pdf["hash"]))
        return pd.DataFrame([(level, k, h) for k, h in _hashed(_chunks(before[part] + own, part == end))], columns=["level", "key", "hash"])

    return settle(ranges.groupBy("part").applyInPandas(chunked, _TREE))


def tree(objects: DataFrame, task_rows: int = 1_000_000) -> DataFrame:
    """The hash tree over (key, hash): (level, key, hash), the root last. It depends on the content alone, not on row order, partitions or size.

    While a level has more than ``task_rows`` entries the next is made range by range; what is left is finished in one task.
    """
    spark = objects.sparkSession
    now = settle(objects.select(F.lit(0).alias("level"), "key", "hash"))
    parts, level = [now], 0
    while (n := now.count()) > task_rows:
        level += 1
        now = _next_level(now.select("key", "hash"), level)
        parts.append(now)
    if n:
        rest = now.select("key", "hash", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: pd.DataFrame(_upper(sorted(zip(pdf["key"], pdf["hash"])), level), columns=["level", "key", "hash"]), _TREE)
    else:
        rest = spark.createDataFrame(_upper([], level), _TREE)
    return reduce(DataFrame.unionByName, [*parts, rest])


def root_hash(g: PropertyGraph) -> str:
    return tree(content_objects(g)).orderBy(F.desc("level")).first()["hash"]


@dataclass(frozen=True)
class Commit:
    tree: str
    branch: str
    parents: tuple[str, ...]
    author: str
    message: str
    timestamp: str
    graph_version: int

    @property
    def hash(self) -> str:
        return "sha256:" + hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Repository:
    """Commits by hash, branch heads, and the graphs they stand for."""

    commits: dict[str, Commit] = field(default_factory=dict)
    refs: dict[str, str] = field(default_factory=dict)
    graphs: dict[str, PropertyGraph] = field(default_factory=dict)

    def commit(self, g: PropertyGraph, branch: str = "main", author: str = "", message: str = "", timestamp: str = "", parents: list[str] | None = None) -> Commit:
        up = tuple(parents) if parents is not None else ((self.refs[branch],) if branch in self.refs else ())
        c = Commit(root_hash(g), branch, up, author, message, timestamp, g.version)
        self.commits[c.hash], self.graphs[c.hash], self.refs[branch] = c, g, c.hash
        return c

    def update_ref(self, name: str, target: str) -> None:
        if target not in self.commits:
            raise GraphError("unknown_commit", target)
        self.refs[name] = target

    def log(self, start: str, limit: int | None = None) -> list[Commit]:
        """Breadth-first over parents."""
        todo, seen, out = [self.refs.get(start, start)], set(), []
        while todo:
            h = todo.pop(0)
            if h in seen or h not in self.commits:
                continue
            seen.add(h)
            out.append(self.commits[h])
            todo += self.commits[h].parents
        return out if limit is None else out[:limit]

    def checkout(self, target: str) -> PropertyGraph:
        h = self.refs.get(target, target)
        if h not in self.graphs:
            raise GraphError("payload_missing", target)
        return self.graphs[h]


def diff(base: PropertyGraph, target: PropertyGraph) -> DataFrame:
    """(key, kind, change, base_hash, target_hash) in any order; change is added, removed, modified or unchanged."""
    a, b = content_objects(base), content_objects(target)
    j = a.select("key", F.col("kind").alias("k1"), F.col("hash").alias("base_hash")).join(b.select("key", F.col("kind").alias("k2"), F.col("hash").alias("target_hash")), "key", "full_outer")
    change = F.when(F.col("base_hash").isNull(), "added").when(F.col("target_hash").isNull(), "removed").when(F.col("base_hash") == F.col("target_hash"), "unchanged").otherwise("modified")
    return j.select("key", F.coalesce("k1", "k2").alias("kind"), change.alias("change"), "base_hash", "target_hash")


STRATEGIES = ("auto_confidence", "prefer_ours", "prefer_theirs", "manual")


def _three(base: DataFrame, ours: DataFrame, theirs: DataFrame, names: list[str], strategy: str, min_delta: float, is_edge: bool) -> DataFrame:
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.col("id"), F.struct(*names).alias(s))

    j = side(base, "b").join(side(ours, "o"), "id", "full_outer").join(side(theirs, "t"), "id", "full_outer")
    h = lambda s: F.col(f"{s}.content_hash")
    same = lambda x, y: h(x).eqNullSafe(h(y))
    pick: Column = F.when(same("o", "t"), "o").when(same("o", "b"), "t").when(same("t", "b"), "o")
    if strategy == "prefer_ours":
        pick = pick.otherwise("o")
    elif strategy == "prefer_theirs":
        pick = pick.otherwise("t")
    elif strategy == "auto_confidence" and is_edge:
        co, ct = F.coalesce("o.confidence", F.lit(1.0)), F.coalesce("t.confidence", F.lit(1.0))
        both = F.col("o").isNotNull() & F.col("t").isNotNull()
        pick = pick.when(both & (F.abs(co - ct) > min_delta), F.when(co > ct, "o").otherwise("t")).otherwise("conflict")
    else:
        pick = pick.otherwise("conflict")
    return j.withColumn("pick", pick)


def merge(base: PropertyGraph, ours: PropertyGraph, theirs: PropertyGraph, strategy: str = "auto_confidence", min_delta: float = 0.0) -> tuple[PropertyGraph | None, DataFrame]:
    """Merge by key: equal sides, the one changed side, else the strategy. Any conflict means no merged graph.

    Also (key, base_hash, ours_hash, theirs_hash) of the conflicts. The merged version is one above all.
    """
    if strategy not in STRATEGIES:
        raise GraphError("unknown_strategy", strategy)
    n = _three(base.nodes, ours.nodes, theirs.nodes, NODE_SCHEMA.names, strategy, min_delta, False)
    e = _three(base.edges, ours.edges, theirs.edges, EDGE_SCHEMA.names, strategy, min_delta, True)
    show = lambda df, kind: df.filter("pick = 'conflict'").select(F.concat(F.lit(kind + "/"), "id").alias("key"), F.col("b.content_hash").alias("base_hash"), F.col("o.content_hash").alias("ours_hash"), F.col("t.content_hash").alias("theirs_hash"))
    conflicts = show(n, "node").unionByName(show(e, "edge")).orderBy("key")
    if not conflicts.isEmpty():
        return None, conflicts
    take = lambda df: df.withColumn("x", F.when(F.col("pick") == "o", F.col("o")).otherwise(F.col("t"))).filter("x is not null").select("x.*")
    return PropertyGraph(take(n), take(e), max(base.version, ours.version, theirs.version) + 1, ours.designations), conflicts
