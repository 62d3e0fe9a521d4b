"""Exact top-k by inner product with KD-trees: every shard of rows has its own tree of median splits with tight boxes;
a query walks it best box first and stops where no box can beat its k-th best score. That score is found in one shard
first and carried to all others, where it only grows."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a shard (one tree), queries of a block, rows of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 4096, 8192, 64


def whole_components(v: Column) -> Column:
    """floor(64 * x) of each component as a whole number; null for vectors that are null, empty or hold null, NaN or infinity."""
    x = F.transform(v, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.when((F.size(v) > 0) & fine, F.transform(x, lambda e: F.floor(e * 64)))


@dataclass
class Tree:
    """Nodes in one array each: children (-1 at a leaf), row range, tight box."""

    ids: np.ndarray
    rows: np.ndarray
    left: list[int]
    right: list[int]
    begin: list[int]
    end: list[int]
    low: np.ndarray
    high: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    """Split at the median of the widest side until a leaf holds at most ``leaf`` rows; equal rows end in one leaf."""
    order = np.arange(len(ids))
    left, right, begin, end, low, high = [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        k = len(left)
        part = rows[order[lo:hi]]
        lows, highs = part.min(axis=0), part.max(axis=0)
        for a, v in ((left, -1), (right, -1), (begin, lo), (end, hi), (low, lows), (high, highs)):
            a.append(v)
        side = int(np.argmax(highs - lows))
        if hi - lo > leaf and highs[side] > lows[side]:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, side], mid, kind="introselect")]
            left[k] = node(lo, lo + mid)
            right[k] = node(lo + mid, hi)
        return k

    node(0, len(ids))
    return Tree(ids[order], rows[order], left, right, begin, end, np.array(low), np.array(high))


def bounds(t: Tree, queries: np.ndarray) -> np.ndarray:
    """For each query and box the largest inner product of any point in the box."""
    return np.maximum(queries, 0) @ t.high.T + np.minimum(queries, 0) @ t.low.T


def search(t: Tree, query_id: int, q: np.ndarray, bound: list[int], k: int, best: list[tuple[int, int]], least: int | None = None) -> None:
    """Improve ``best``, a heap of (score, -id) of at most k, by the rows of the tree other than the query's own.

    ``bound`` has the largest possible score of each box; ``least`` is a score that k rows are known to reach. A box is
    left out only if its bound is below the k-th score, so ties are always seen.
    """
    floor = best[0][0] if len(best) == k else least
    todo = [(-bound[0], 0)]
    while todo:
        top, n = heapq.heappop(todo)
        if floor is not None and -top < floor:
            break
        if t.left[n] >= 0:
            for c in (t.left[n], t.right[n]):
                if floor is None or bound[c] >= floor:
                    heapq.heappush(todo, (-bound[c], c))
            continue
        ids = t.ids[t.begin[n] : t.end[n]]
        scores = t.rows[t.begin[n] : t.end[n]] @ q
        if floor is not None:
            some = np.flatnonzero(scores >= floor)
            ids, scores = ids[some], scores[some]
        for s, i in zip(scores.tolist(), ids.tolist()):
            if i != query_id:
                s = int(s)
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        if len(best) == k:
            floor = best[0][0] if least is None else max(best[0][0], least)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _exact(*parts: np.ndarray) -> type:
    """A type whose sums of products of these numbers are exact: doubles while they stay below 2^53, which multiply faster."""
    top = max(int(np.abs(x.astype(np.int64)).max(initial=0)) for x in parts)
    return np.float64 if top * top * parts[0].shape[1] < 2**53 else np.int64


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).reshape(n, -1)


def _grow(table: pa.Table) -> pa.Table:
    """One shard's rows to one tree."""
    table = table.combine_chunks()
    ids, rows = table["vec_id"].to_numpy(), _matrix(table["x"].combine_chunks(), table.num_rows)
    order = np.argsort(ids, kind="stable")  # rows come in any order
    tree = build(ids[order], rows[order])
    for name in ("rows", "low", "high"):
        setattr(tree, name, _narrow(getattr(tree, name)))
    return pa.table({"dim": pa.array([rows.shape[1]], pa.int32()), "shard": table["shard"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _pack(table: pa.Table) -> pa.Table:
    """One block of queries to one row."""
    table = table.combine_chunks()
    packed = pickle.dumps((table["vec_id"].to_numpy(), _narrow(_matrix(table["x"].combine_chunks(), table.num_rows)), table["least"].to_pylist()))
    return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "queries": pa.array([packed], pa.binary())})


def _walk(k: int):
    """Search the trees that follow a block's queries one after the other; the k-th scores go from tree to tree."""

    def out(ids, best):
        rows = [(int(q), -i, s) for q, b in zip(ids, best) for s, i in b]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def run(batches):
        now, ids, best = None, [], []
        for batch in batches:
            for *block, shard, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                if shard < 0:
                    if len(ids):
                        yield out(ids, best)
                    now, (ids, queries, least) = block, pickle.loads(payload.as_py())
                    best = [[] for _ in ids]
                    continue
                if block != now:  # the hash left this block without queries
                    continue
                tree = pickle.loads(payload.as_py())
                kind = _exact(tree.rows, queries)
                tree.rows, tree.low, tree.high = (x.astype(kind) for x in (tree.rows, tree.low, tree.high))
                for lo in range(0, len(ids), 1024):
                    rows = queries[lo : lo + 1024].astype(kind)
                    bound = bounds(tree, rows).tolist()
                    for j in range(len(rows)):
                        search(tree, int(ids[lo + j]), rows[j], bound[j], k, best[lo + j], least[lo + j])
        if len(ids):
            yield out(ids, best)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For every query row the k rows of highest integer inner product, other than its own: (query_id, rank, vec_id, score).

    Rows are dealt by a hash of their id into shards of about ``shard_rows``, each built into a tree once; query blocks of
    about ``block_queries`` meet every shard by explicit block numbers. First each block searches one shard, which
    gives every query a score that k rows reach. Then each task takes a block once and a share of the trees, one
    after the other, all pruned by that score and by the better ones found on the way; the partial lists of a
    block's tasks (at most k a query and task) are merged by rank. Components travel in the smallest type that holds
    them. Memory of a task: one tree, one block, its heaps.

    Ties go to the smaller id. Vectors that are null, empty or hold null or non-finite components take no part,
    nor do rows with null ids; vectors meet only those of their own dimension; fewer than k rows give all. Rows
    that repeat an id count once each as candidates, but never for a query of that id, and queries are distinct
    by id (the first by value). Extra columns are ignored; an empty table gives an empty result. Components must
    keep scores inside 63 bits.
    """
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_components(F.col(embedding)).alias("x"), is_query.alias("q")).filter("vec_id is not null and x is not null")
    x = stored(x.withColumn("dim", F.size("x")), "vectors")
    sizes = {r[0]: (r[1], r[2]) for r in x.groupBy("dim").agg(F.count(F.lit(1)), F.count_if("q")).collect()}  # a row per dimension
    if not sizes:
        return x.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)

    def deal(n: dict[int, int]) -> Column:
        parts = F.create_map(*[F.lit(v) for kv in n.items() for v in kv])
        return F.pmod(F.xxhash64("vec_id"), parts[F.col("dim")]).cast("int")

    shards = {d: max(1, -(-n // shard_rows)) for d, (n, _) in sizes.items()}
    blocks = {d: max(1, -(-m // block_queries)) for d, (_, m) in sizes.items()}
    trees = x.withColumn("shard", deal(shards)).select("vec_id", "x", "dim", "shard").groupBy("dim", "shard").applyInArrow(_grow, "dim int, shard int, tree binary")
    first = x.filter("q").groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    first = first.withColumn("block", deal(blocks))
    trees = stored(trees, "trees")
    table = lambda n: F.create_map(*[F.lit(v) for kv in n.items() for v in kv])[F.col("dim")]
    tasks = max(1, x.sparkSession.sparkContext.defaultParallelism // max(1, sum(blocks.values())))

    def walked(queries: DataFrame, meets: Column, parts: int) -> DataFrame:
        """Queries packed by block against the trees of which ``meets`` says whether they count for a block."""
        packed = queries.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, queries binary")
        part = F.col("shard") % parts
        one = packed.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("shard"), F.col("queries").alias("payload"))
        two = trees.select("dim", F.explode(F.sequence(F.lit(0), table(blocks) - 1)).alias("block"), "shard", "tree").filter(meets).select("dim", "block", part.alias("part"), "shard", F.col("tree").alias("payload"))
        rows = one.unionByName(two).repartition("dim", "block", "part").sortWithinPartitions("dim", "block", "part", "shard")
        return rows.select("dim", "block", "shard", "payload").mapInArrow(_walk(k), "query_id long, vec_id long, score long")

    seed = walked(first.withColumn("least", F.lit(None).cast("long")), F.col("shard") == F.col("block") % table(shards), 1)
    least = seed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    first = stored(first.join(least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").select("vec_id", "x", "dim", "block", "least"), "queries")
    found = walked(first, F.lit(True), tasks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
