"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate
edges, links confirmed on full shingle sets, connected components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_words, mix64, release, split_words, stored


@dataclass(frozen=True)
class Params:
    """Bins and bands: at similarity 0.8 a pair shares none of 32 bands of 4 with probability (1 - 0.8^4)^32 < 1e-7."""

    width: int = 2  #: words in a shingle
    percent: int = 80  #: least similarity, in hundredths
    bands: int = 32
    rows: int = 4
    small: int = 12  #: buckets of at most so many classes are settled pair by pair where components differ, larger ones by a join on rare shingles


#: What near_duplicates and the pipeline's stage take: with five words a scattered edit costs five shingles, so fewer clean texts are joined.
FIVE_WORDS = Params(width=5)


# --------------------------------------------------------------------------- shingles and signatures


def shingles(doc: np.ndarray, code: np.ndarray, word_hash: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs, sorted; a text of fewer than ``width`` words is one shingle."""
    h = word_hash[code] if len(code) else np.zeros(0, np.uint64)
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    place = np.arange(len(doc)) - first[doc]
    size = np.minimum(n, width)[doc]
    starts = np.flatnonzero(place + size <= n[doc])
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            has = k < size[starts]
            out[has] = mix64(out[has] * np.uint64(0x9E3779B97F4A7C15) + h[starts[has] + k] + np.uint64(k + 1))
    owner = doc[starts]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    return owner[new], out[new]


def donors(bins: int, attempts: int) -> np.ndarray:
    """For each bin the bins that it asks, attempt after attempt: a 2-universal choice that doesn't depend on the document."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(attempts, dtype=np.uint64), indexing="ij")
    return (mix64(i * np.uint64(1_000_003) + t + np.uint64(0xD15EA5E)) % np.uint64(bins)).astype(np.int64)


def signatures(owner: np.ndarray, shingle: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """One-permutation minima by bin, empty bins filled by optimal densification; rows of empty documents are all ones."""
    h = mix64(shingle ^ np.uint64(0x5EED))
    slot = owner * bins + (h >> np.uint64(40)).astype(np.int64) % bins
    full = np.full(n_docs * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(full, slot, h)
    sig = full.reshape(n_docs, bins)
    empty = sig == np.iinfo(np.uint64).max
    todo_doc, todo_bin = np.nonzero(empty & ~empty.all(axis=1)[:, None])
    source = sig.copy()
    ask = donors(bins, 64)
    t = 0
    while len(todo_doc):
        if t < 64:
            at = ask[todo_bin, t]
        else:  # a document with one or two shingles may need more tries than the table has
            at = (mix64(todo_bin.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(t + 0xD15EA5E)) % np.uint64(bins)).astype(np.int64)
        hit = ~empty[todo_doc, at]
        sig[todo_doc[hit], todo_bin[hit]] = source[todo_doc[hit], at[hit]]
        todo_doc, todo_bin, t = todo_doc[~hit], todo_bin[~hit], t + 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(len(sig), bands, rows)[:, :, r])
    return out


def _lower(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.ascii_lower(pc.fill_null(texts, ""))


def _sets(batch: pa.RecordBatch, width: int):
    doc, code, words = split_words(_lower(batch.column(1)))
    return shingles(doc, code, hash_words(words), batch.num_rows, width)


def _sign(p: Params):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                owner, sh = _sets(part, p.width)
                n = np.bincount(owner, minlength=part.num_rows)
                with np.errstate(over="ignore"):
                    one, two = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
                    np.add.at(one, owner, mix64(sh))
                    np.add.at(two, owner, mix64(sh ^ np.uint64(0xABCDEF)))
                keys = band_keys(signatures(owner, sh, part.num_rows, p.bands * p.rows), p.bands, p.rows).view(np.int64)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * p.bands)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["doc_id", "n_shingles", "s1", "s2", "keys"],
                )

    return run


def _expand(p: Params):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                owner, sh = _sets(part, p.width)
                offsets = np.zeros(part.num_rows + 1, np.int32)
                offsets[1:] = np.cumsum(np.bincount(owner, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sh.view(np.int64)))], names=["doc_id", "sh"])

    return run


# --------------------------------------------------------------------------- components

#: Edges that one task may hold once every partition has reduced its own to stars; beyond that the loop goes on.
TASK_EDGES = 2_000_000


def _stars(batches):
    """Edges (u, v) of a partition to stars: every node with the smallest id that these edges reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 100_000):
        some = [x for x in nodes[k : k + 100_000] if parent[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (id, comp), comp the smallest id reachable; ids that are their own component are left out.

    Each partition first reduces its edges to stars. While more than ``task_edges`` are left, large-star and
    small-star steps run as joins, each written to the shared folder; a hub's edges are pre-aggregated before the
    shuffle. What is left then, of checked size, is finished by one task.
    """
    schema = "u long, v long"
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").mapInArrow(_stars, schema), "edges")
    mark = None
    while (n := now.count()) > task_edges:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = stored(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stored(small, "small")
        release(large, now)
        now = after
        seen = (n, now.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
        if seen == mark:
            break
        mark = seen
    else:
        now = now.coalesce(1).mapInArrow(_stars, schema)
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp"))


# --------------------------------------------------------------------------- candidate edges


#: Classes with one shingle that a task compares with all others of that shingle.
BLOCK = 500


def _linkable(each: DataFrame, percent: int) -> DataFrame:
    """Sets (id, k) that may still link: too many shingles that no other one has rule a link out.

    At most n - p of a set's n shingles can be shared if p are its own, and a union is never below n.
    """
    own = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "k")).alias("x")).filter("c = 1").groupBy("x.id", "x.k").agg(F.count(F.lit(1)).alias("p"))
    left = F.col("n") - F.coalesce("p", F.lit(0))
    return each.select("id", "k", "n").distinct().join(own, ["id", "k"], "left").filter(left * 100 >= F.col("n") * percent).select("id", "k")


def _rare_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``live`` classes (id, comp) in different components that may be similar enough: a prefix-filter join.

    Shingles have one order for all, rare ones first. Sets of similarity ``percent`` share one of their first
    n - ceil(n * percent / 100) + 1; after the first they share, enough must be left on both sides. A shingle's
    classes are compared in blocks of about ``BLOCK`` against all, so a common one is spread over tasks.
    """
    comps = live.select("id", "comp").distinct()
    whole = sets.join(comps, sets["doc_id"] == comps["id"]).select("id", "comp", F.xxhash64("sh").alias("k"), F.size("sh").alias("n"), "sh").dropDuplicates(["id", "k"])
    able = stored(_linkable(whole.select("id", "k", "n", F.explode("sh").alias("s")), percent), "able")
    each = whole.join(able, ["id", "k"], "left_semi").select("id", "comp", "k", "n", F.explode("sh").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    ranked = each.join(often, "s").groupBy("id", "comp", "k", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("x"))
    first = F.slice("x", F.lit(1), F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1)
    rare = stored(ranked.select("id", "comp", "n", F.posexplode(first).alias("i", "y")).select("id", "comp", "n", "i", "y.s", "y.c").filter("c > 1"), "rare")
    several = rare.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s")
    rare = rare.join(several, "s", "left_semi").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    left = rare.select("s", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "comp", "n", "i")
    right = rare.select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("id2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    rest = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")).cast("long")
    enough = rest * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    met = left.join(right, ["s", "block"]).filter((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & _sizes_fit(F.col("n"), F.col("n2"), percent) & enough)
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes differ too much can't be similar enough."""
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * percent)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, p: Params = FIVE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents whose distinct ``width``-word shingles (ASCII letters lower-cased) have Jaccard similarity of ``percent`` or more.

    1. Every document gets a signature; documents with equal sets are one class, whose smallest id stands for it.
    2. Classes are dealt into buckets by band. Each bucket gives a star: edges from a pseudorandom member to the
       others, so a bucket of n gives n - 1 pairs, not n^2. A class's best edge (most bands) is confirmed first.
    3. Links found make components. Only buckets that still hold several components go on: all remaining star
       edges between components, every pair between components of small buckets, then every pair between
       components of the classes in large ones that a prefix filter can't rule out.
    Sets are read in full for every class that has a candidate edge, and every link is confirmed on them.

    Returns one row per input row: ``doc_id``, ``n_shingles`` (0 for texts null, empty or without words, which link with
    nothing), ``component_id`` (smallest id reachable, itself included), ``kept`` (whether it is that id). Rows
    with null ids have null component and stay. Rows that repeat an id with the same text share their result;
    different texts under one id count as one document where that id stands for a class. Extra columns are
    ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(base.mapInArrow(_sign(p), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "signed")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    heads = stored(usable.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("x")).select("s1", "s2", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").cast("int").alias("n"), F.col("x.keys").alias("keys")), "classes")
    spread = heads.select("id", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")  # nearly all keys are alone: only they and a count are shuffled first
    found = stored(spread.join(shared, "key"), "shared")
    pick = F.struct(F.xxhash64("id", "key").alias("h"), F.col("id").alias("id"), F.col("n").alias("n"))
    leads = found.groupBy("key").agg(F.min(pick).alias("l")).select("key", F.col("l.id").alias("lid"), F.col("l.n").alias("ln"))
    members = stored(found.join(leads, "key"), "members")
    release(found)
    stars = members.filter((F.col("id") != F.col("lid")) & _sizes_fit(F.col("n"), F.col("ln"), p.percent))
    stars = stored(stars.groupBy(F.col("lid").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("hits")), "stars")
    # classes that may need their sets: those in a star, and those that later rounds may pair
    fits = members.filter((F.col("c") > 2) | _sizes_fit(F.col("n"), F.col("ln"), p.percent))
    wanted = fits.select(F.col("id").alias("doc_id")).distinct()
    sets = stored(base.join(wanted, "doc_id", "left_semi").mapInArrow(_expand(p), "doc_id long, sh array<long>"), "sets")
    best = stars.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    labels = stored(components(_confirm(best, sets, p.percent)), "labels")

    for step in ("small", "large"):
        live = stored(_mixed(_labelled(members.filter(F.col("c") > (p.small if step == "large" else 1)).select("key", "id", "n", "c"), labels)), "live")
        if step == "small":
            few = live.filter(F.col("c") <= p.small)
            other = few.select("key", F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("comp").alias("lcomp"))
            inner = few.join(other, "key").filter((F.col("lid") < F.col("id")) & (F.col("lcomp") != F.col("comp")) & _sizes_fit(F.col("n"), F.col("ln"), p.percent))
            old = _between(stars.select("a", "b"), labels).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = old.unionByName(inner.select(F.col("lid").alias("a"), F.col("id").alias("b"))).distinct()
        elif live.isEmpty():
            break
        else:
            pairs = _rare_pairs(live, sets, p.percent)
        links = stored(_between(_confirm(pairs, sets, p.percent), labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
        release(live)
        if links.isEmpty():
            continue
        merged = components(links).withColumnsRenamed({"id": "_old", "comp": "_new"})
        # members follow their component; its root, which had no label so far, gets one
        moved = labels.join(merged, F.col("comp") == F.col("_old"), "left").select("id", F.coalesce("_new", "comp").alias("comp"))
        labels = stored(moved.unionByName(merged.select(F.col("_old").alias("id"), F.col("_new").alias("comp"))), "labels")

    heads_of = _labelled(heads.select("s1", "s2", "id"), labels).select("s1", "s2", "comp")
    out = signed.drop("keys").join(heads_of, ["s1", "s2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, p: Params = FIVE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one document of each near-duplicate group, all columns untouched.

    Rows without an id and further texts of one id are documents of their own; rows that repeat both id and text are
    one document. Texts without words are in no group. An empty table stays empty.
    """
    ids = docs.select(F.col(doc_id).alias("id")).groupBy("id").count()
    most, top, none = ids.agg(F.max("count"), F.max("id"), F.max(F.col("id").isNull())).first()
    if (most or 0) <= 1 and not none:
        kept = near_duplicates(docs, p, doc_id, text).filter("kept").select(F.col("doc_id").alias(doc_id))
        return docs.join(kept, doc_id, "left_semi").select(*docs.columns)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"))  # as one column, whatever their names
    texts = rows.select("id", "hash").distinct()
    first = texts.filter("id is not null").groupBy("id").agg(F.min("hash").alias("hash"))
    # every further text of an id gets a key after all ids
    further = stored(texts.join(first, ["id", "hash"], "left_anti").withColumn("more", F.lit((top or 0) + 1) + F.monotonically_increasing_id()), "keys")
    further = further.select(F.col("id").alias("i"), F.col("hash").alias("h"), "more")
    keyed = stored(rows.join(further, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left").select("row", F.coalesce("more", "id").alias("key")), "keyed")
    kept = near_duplicates(keyed.select("key", F.col("row")[text].alias("text")), p, "key").filter("kept").select(F.col("doc_id").alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _mixed(known: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    several = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return known.join(several, "key")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of their ``id``."""
    l = labels.select(F.col("id").alias("_id"), F.col("comp").alias("_comp"))
    return rows.join(l, F.col("id") == F.col("_id"), "left").withColumn("comp", F.coalesce("_comp", "id")).drop("_id", "_comp")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components, with these as (ca, cb)."""
    l = labels.select(F.col("id").alias("_a"), F.col("comp").alias("_ca"))
    r = labels.select(F.col("id").alias("_b"), F.col("comp").alias("_cb"))
    j = pairs.join(l, F.col("a") == F.col("_a"), "left").join(r, F.col("b") == F.col("_b"), "left")
    return j.select("a", "b", F.coalesce("_ca", "a").alias("ca"), F.coalesce("_cb", "b").alias("cb")).filter("ca <> cb")
