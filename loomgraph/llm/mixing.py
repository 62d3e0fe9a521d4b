"""Mixing sources to target weights: words are packed into fixed-length blocks, every output shard draws multinomial
source counts, slots are mapped through pseudorandom permutations of a source's block numbers, and blocks are joined by
number."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, mix64, prefix_sums, stored, word_count

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
#: Sources whose totals the driver may hold, a row each; a column with more different values is no source.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> list[float]:
    """Share the sum of ``sizes`` by weight (repeating), no source above ``repeat`` times its size, the excess reshared."""
    share = [0.0] * len(sizes)
    capped: set[int] = {i for i, n in enumerate(sizes) if n == 0}
    total = sum(sizes)
    while len(capped) < len(sizes):
        left = total - sum(repeat * sizes[i] for i in capped)
        weight = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in capped)
        over = set()
        for i in range(len(sizes)):
            if i not in capped:
                share[i] = left * weights[i % len(weights)] / weight
                if share[i] > repeat * sizes[i]:
                    over.add(i)
        if not over:
            break
        capped |= over
    for i in capped:
        share[i] = float(repeat * sizes[i])
    return share


@dataclass(frozen=True)
class Quota:
    """What the mix takes of one source: all its blocks ``epochs`` times, then ``slots`` blocks of one more permutation."""

    source: str | None
    number: int
    words: int
    target: float
    blocks: int
    epochs: int
    slots: int
    last_cut: int  #: words that the last slot leaves out, so that the words taken are the rounded target


def _walk(value: np.ndarray, n: int, key: int, rounds: range, back: bool) -> np.ndarray:
    """Feistel rounds over the next even power of two, repeated for values that leave 0..n-1."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    out = value.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for r in rounds:
            k = np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))
            a, b = (b ^ (mix64(a ^ k) & mask), a) if back else (b, a ^ (mix64(b ^ k) & mask))
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1."""
    return _walk(index, n, key, range(4), False)


def place_of(value: int, n: int, key: int) -> int:
    """The index that :func:`permuted` maps to ``value``."""
    return int(_walk(np.array([value]), n, key, range(3, -1, -1), True)[0])


def _key(seed: int, number: int, epoch: int) -> int:
    return (seed * 1_000_003 + number) * 31 + epoch


def quota(source: str | None, number: int, words: int, target: float, block: int, seed: int) -> Quota:
    blocks = -(-words // block)
    epochs, rest = divmod(round(target), words) if words else (0, 0)
    short = blocks * block - words  # words missing from the last block
    slots = cut = 0
    if rest:
        place = place_of(blocks - 1, blocks, _key(seed, number, epochs))  # of the short block in the last, partial epoch
        slots = -(-rest // block)
        if place < slots and slots * block - short < rest:
            slots += 1
        cut = slots * block - (short if place < slots else 0) - rest
    return Quota(source, number, words, target, blocks, epochs, slots, cut)


def quotas_of(totals: list[tuple[str | None, int]], block: int = BLOCK_WORDS, seed: int = 0) -> list[Quota]:
    """What the mix takes of each source, given the words that it has."""
    share = targets([n for _, n in totals])
    return [quota(s, i, n, share[i], block, seed) for i, (s, n) in enumerate(totals)]


def drawn(shard: int, slots: int, quotas: np.ndarray, seed: int) -> np.ndarray:
    """The multinomial source counts of one output shard: ``slots`` draws with chances in proportion to the quotas."""
    return np.random.default_rng([seed, shard]).multinomial(slots, quotas / quotas.sum())


def _slots(spark, quotas: list[Quota], block: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot of the mix: output shard, source number, epoch, block number, words taken from the block's start.

    Every shard draws its counts for itself. A source's slots are numbered through all shards; those beyond its quota
    go, in their order, to the sources that were drawn short of theirs, so that every quota is met whatever the draw.
    """
    total = np.array([q.epochs * q.blocks + q.slots for q in quotas], np.int64)
    n = int(total.sum())
    shards = -(-n // shard_slots) if n else 0

    def draw(frames):
        for pdf in frames:
            for lo in range(0, len(pdf), 256):
                ids = pdf["id"].to_numpy()[lo : lo + 256]
                got = np.array([drawn(int(i), min(shard_slots, n - int(i) * shard_slots), total, seed) for i in ids]).reshape(len(ids), -1)
                row, number = np.nonzero(got)
                yield pd.DataFrame({"out_shard": ids[row], "number": number, "n": got[row, number]})

    rows = spark.range(shards).mapInPandas(draw, "out_shard int, number int, n long")
    rows = prefix_sums(rows, ["out_shard"], "n", ["number"]).withColumnRenamed("before", "first").drop("row")
    enough = spark.createDataFrame([(i, int(t)) for i, t in enumerate(total)], "number int, total long")
    over = F.greatest(F.lit(0), F.col("first") + F.col("n") - F.greatest("first", "total"))
    rows = stored(rows.join(enough, "number").select("out_shard", "number", "n", "first", over.cast("long").alias("over")), "draws")
    got = np.zeros(len(total), np.int64)
    for r in rows.groupBy("number").agg(F.sum("n").alias("n")).collect():  # a row per source
        got[r["number"]] = r["n"]
    short = np.maximum(total - got, 0)
    upto = np.cumsum(short)
    beyond = prefix_sums(rows.filter("over > 0"), ["number", "out_shard"], "over").select("out_shard", "number", F.col("before").alias("turn"))
    rows = rows.join(beyond, ["out_shard", "number"], "left")

    quota_of = {k: np.array([getattr(q, k) for q in quotas], np.int64) for k in ("words", "blocks", "epochs", "slots", "last_cut")}

    def placed(shard: np.ndarray, own: np.ndarray, k: np.ndarray) -> pd.DataFrame:
        """Slots ``k`` of sources ``own``: each to its block."""
        f = {name: x[own] for name, x in quota_of.items()}
        epoch, at = k // f["blocks"], k % f["blocks"]
        for key in np.unique(own * (1 << 8) + epoch):  # at most a few epochs a source
            one = np.flatnonzero((own == key >> 8) & (epoch == key & 255))
            at[one] = permuted(at[one], quotas[key >> 8].blocks, _key(seed, int(key >> 8), int(key & 255)))
        take = np.minimum(block, f["words"] - at * block) - np.where(k == f["epochs"] * f["blocks"] + f["slots"] - 1, f["last_cut"], 0)
        return pd.DataFrame({"out_shard": shard, "number": own, "epoch": epoch, "block": at, "take": take})

    def make(frames):
        for pdf in frames:
            r = pdf[["out_shard", "number", "n", "first", "over", "turn"]].fillna(0).astype(np.int64)
            for _, part in r.groupby((r["n"].cumsum() - r["n"]) // (1 << 18)):  # a draw is at most one shard's slots
                shard, own, many, first, over, turn = (part[c].to_numpy() for c in part.columns)
                row = np.repeat(np.arange(len(part)), many)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                k, to = first[row] + nth, own[row].copy()
                late = np.flatnonzero(nth >= (many - over)[row])  # beyond the quota of the source drawn: to one that fell short
                place = turn[row[late]] + nth[late] - (many - over)[row[late]]
                to[late] = np.searchsorted(upto, place, side="right")
                k[late] = got[to[late]] + place - (upto - short)[to[late]]
                yield placed(shard[row], to, k)

    return rows.mapInPandas(make, "out_shard int, number int, epoch int, block long, take long")


def mix(docs: DataFrame, source: str = "source", text: str = "text", block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mix sources to weights 1, 2, 3, ... of all words.

    A source's documents, in the order of (id, text hash), are one stream of words cut into blocks of ``block``
    words. Returns two tables. ``rows``: a row per document with ``rid``, ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``. ``parts``: which words the mix takes, as ``rid``, ``out_shard``, ``epoch``,
    ``block``, ``first``, ``last`` (word numbers in the document, last exclusive). Blocks of a hot source are
    dealt by (source, block), so no source lands in one task. The driver holds a row per source (``MAX_SOURCES`` at
    most, else an error); shards draw their counts and map their slots on the executors.

    Null sources form one source, the last; null and empty texts have size 0 and are never taken; repeated rows
    each hold their own words; the draw depends on ``seed`` and the rows alone, so reruns agree. An empty table
    gives empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("_tie"))
    rows = stored(prefix_sums(rows, ["doc_id", "_tie", "size"], "size", ["source"]).withColumn("rid", F.monotonically_increasing_id()), "streams")
    found = [(r[0], int(r[1])) for r in rows.groupBy("source").agg(F.sum("size")).limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    quotas = quotas_of(found, block, seed)
    facts = spark.createDataFrame([(q.number, q.source, q.words, q.target) for q in quotas], "number int, source string, source_size long, target double").withColumnRenamed("source", "_source")
    rows = rows.join(facts, rows["source"].eqNullSafe(facts["_source"])).drop("_source", "row")
    slots = _slots(spark, quotas, block, shard_slots, seed)
    end = F.col("before") + F.col("size")
    pieces = (
        rows.filter("size > 0").select("rid", "number", "before", "size", F.explode(F.sequence(F.floor(F.col("before") / block).cast("long"), F.floor((end - 1) / block).cast("long"))).alias("block"))
    )
    begin = F.col("block") * block
    parts = (
        pieces.join(slots.hint("merge"), ["number", "block"])  # the planner can't know how many slots a small plan makes
        .withColumn("first", F.greatest(begin, F.col("before")) - F.col("before"))
        .withColumn("last", F.least(begin + F.col("take"), F.col("before") + F.col("size")) - F.col("before"))
        .filter("last > first").select("rid", "out_shard", "epoch", "block", "first", "last")
    )
    return rows.drop("before", "number"), parts


def taken(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Per document of :func:`mix`: size, source size, target of its source, words taken (repeats counted)."""
    words = parts.groupBy("rid").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return rows.join(words, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, rows: DataFrame, parts: DataFrame, text: str = "text") -> DataFrame:
    """The mix as documents: one row per document and epoch with the words taken then, in reading order.

    A document taken whole keeps its text untouched; otherwise its taken words are joined by single spaces, gaps
    in the middle by newlines. Columns are those of ``docs``; ``n_chars``, if there, is counted again. Rows are
    matched by id and text hash; copies of a row share what is taken of any of them, one after the other.
    """
    spans = parts.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"), F.sum(F.col("last") - F.col("first")).alias("_got"))
    have = rows.select("rid", "doc_id", "_tie", F.col("size").alias("_size"))
    body = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("_did"), F.xxhash64(text).alias("_hash"))  # as one column, whatever their names
    same = F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key"))
    if (have.groupBy("doc_id", "_tie").count().agg(F.max("count")).first()[0] or 0) > 1:  # else numbering the copies would only shuffle texts
        have = have.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_tie").orderBy("rid")))
        body = body.withColumn("_copy", F.row_number().over(Window.partitionBy("_did", "_hash").orderBy("_hash")))
        same = same & (F.col("_copy") == F.col("_nth"))
    have = have.join(spans, "rid").drop("rid").withColumnsRenamed({"doc_id": "_id", "_tie": "_key"})
    out = body.join(have, same)
    old = F.col("_doc")[text]
    # neighbouring spans are one run: a newline stands only where words are missing
    glue = lambda acc, s: F.struct(
        s["last"].alias("last"),
        F.concat(acc["out"], F.when(acc["last"] < 0, "").when(acc["last"] == s["first"], " ").otherwise("\n"), F.array_join(F.slice(acc["words"], (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")), " ")).alias("out"),
        acc["words"].alias("words"),
    )
    empty = F.struct(F.lit(-1).cast("long").alias("last"), F.lit("").alias("out"), F.regexp_extract_all(old, F.lit(WORD), F.lit(0)).alias("words"))
    out = out.withColumn("_new", F.when(F.col("_got") == F.col("_size"), old).otherwise(F.aggregate("_spans", empty, glue, lambda acc: acc["out"])))
    new = {text: F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("_new").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
