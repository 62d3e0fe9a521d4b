"""Algorithms as DataFrame loops: every round is a few joins and aggregations whose result is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import numbered, settle
from ..model import PropertyGraph, effective_confidence


def edge_pairs(g: PropertyGraph) -> DataFrame:
    """Live edges as (a, b, w): ends and effective confidence. Nodes are the ends of edges; isolated nodes don't appear."""
    return g.live_edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), effective_confidence().alias("w"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def pagerank(pairs: DataFrame, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): power iteration, parallel edges count separately, weights don't; dangling mass is spread evenly; stops at an L1 change below the tolerance.

    Ranks travel along edges once a round: one join on the source, one sum by target (combined before the shuffle);
    the edge table is stored once, already with its source's degree.
    """
    e = pairs.select("a", "b")
    deg = e.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    e = settle(e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).join(deg, "a").select("a", "b", (F.col("m") / F.col("d")).alias("share")))
    nodes = settle(ends(pairs).join(deg.select(F.col("a").alias("id"), F.lit(True).alias("out")), "id", "left").select("id", F.coalesce("out", F.lit(False)).alias("out")))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    ranks = settle(nodes.withColumn("score", F.lit(1.0 / n)))
    for _ in range(max_iter):
        lost = ranks.agg(F.coalesce(F.sum(F.when(~F.col("out"), F.col("score"))), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * lost / n
        got = ranks.join(e, ranks["id"] == e["a"]).groupBy("b").agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        new = ranks.join(got, ranks["id"] == got["b"], "left").select("id", "out", F.col("score").alias("old"), (F.lit(base) + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("score"))
        new = settle(new)
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if moved < tolerance:
            break
    return ranks.select("id", "score")


def ppr_rounds(pairs: DataFrame, seeds: dict[str, float] | DataFrame, alpha: float = 0.15, epsilon: float = 1e-4, max_rounds: int = 200) -> DataFrame:
    """Personalised PageRank by synchronous pushes, for graphs beyond one task: (id, score) of touched nodes.

    Seeds are a dict or a table (id, m). In each round every node whose residual exceeds epsilon times its out-degree is
    pushed at once; the guarantee is that of the sequential push: no residual above that bound remains, but on nodes
    without out-edges, which keep what they would send on and are pushed again only when they get more.
    """
    if isinstance(seeds, dict):
        seeds = pairs.sparkSession.createDataFrame(sorted(seeds.items()), "id string, m double")
    total = seeds.agg(F.sum("m")).first()[0] or 1.0
    out = pairs.groupBy("a").agg(F.sum("w").alias("ws"), F.count(F.lit(1)).alias("d"))
    e = settle(pairs.groupBy("a", "b").agg(F.sum("w").alias("w")).join(out.select("a", "ws"), "a").select("a", "b", F.when(F.col("ws") > 0, F.col("w") / F.col("ws")).otherwise(0.0).alias("share")))
    deg = settle(ends(pairs).join(out.select(F.col("a").alias("id"), "d"), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d")))
    state = settle(seeds.select("id", F.lit(0.0).alias("p"), (F.col("m") / F.lit(total)).alias("r"), F.lit(True).alias("fresh")).join(deg, "id", "left").na.fill({"d": 0}))
    for _ in range(max_rounds):
        hot = F.col("fresh") & (F.col("r") > F.lit(epsilon) * F.greatest(F.col("d"), F.lit(1)))
        push = state.filter(hot)
        if push.isEmpty():
            break
        sent = push.join(e, push["id"] == e["a"]).groupBy(F.col("b").alias("id")).agg(F.sum(F.lit(1 - alpha) * F.col("r") * F.col("share")).alias("in"))
        kept = state.select("id", F.when(hot, F.col("p") + F.lit(alpha) * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(hot, F.when(F.col("d") == 0, F.lit(1 - alpha) * F.col("r")).otherwise(0.0)).otherwise(F.col("r")).alias("r"))
        merged = kept.join(sent, "id", "full_outer").select("id", F.coalesce("p", F.lit(0.0)).alias("p"), (F.coalesce("r", F.lit(0.0)) + F.coalesce("in", F.lit(0.0))).alias("r"), F.col("in").isNotNull().alias("fresh"))
        state = settle(merged.join(deg, "id", "left").na.fill({"d": 0}))
    return state.filter("p + r > 0").select("id", F.col("p").alias("score"))


def components(pairs: DataFrame) -> DataFrame:
    """Weakly connected components: (id, component), component the smallest id; alternating large-star and small-star steps."""
    now = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = ends(pairs)
    mark = None
    now = settle(now.filter("u <> v"), drop=now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = settle(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = settle(small.filter("u <> v").distinct(), drop=now)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return alone.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(pairs: DataFrame) -> DataFrame:
    """(id, component) as the kernel numbers them, by size descending, then smallest member, for graphs beyond one task.

    Nodes without an edge in or out are components of their own. Of the others each gets the smallest id that reaches
    it; those of one id that reach back to it are its component. Both go on until no node is left.
    """
    e = settle(pairs.filter("a <> b").select("a", "b").distinct())
    left = settle(ends(pairs))
    parts = []
    while not left.isEmpty():
        inner = settle(left.join(e.select(F.col("a").alias("id")), "id", "left_semi").join(e.select(F.col("b").alias("id")), "id", "left_semi"))
        done = settle(left.join(inner, "id", "left_anti").withColumn("root", F.col("id")))
        if done.isEmpty():
            now = settle(left.withColumn("color", F.col("id")))
            while True:
                got = e.join(now, e["a"] == now["id"]).groupBy(F.col("b").alias("id")).agg(F.min("color").alias("new"))
                after = settle(now.join(got, "id", "left").select("id", F.least("color", F.coalesce("new", "color")).alias("color"), F.col("color").alias("old")))
                now = after.select("id", "color")
                if after.filter("color <> old").isEmpty():
                    break
            ca, cb = now.select(F.col("id").alias("a"), F.col("color").alias("ca")), now.select(F.col("id").alias("b"), F.col("color").alias("cb"))
            same = settle(e.join(ca, "a").join(cb, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("root")))
            done = edge = settle(now.filter("id = color").select("id", F.col("color").alias("root")))
            while not edge.isEmpty():
                edge = settle(same.join(edge.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"), "root").distinct().join(done, "id", "left_anti").select("id", "root"))
                done = settle(done.unionByName(edge))
            inner = settle(left.join(done, "id", "left_anti"))
        parts.append(done)
        left = inner
        e = settle(e.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    if not parts:
        return left.select("id", F.lit(0).alias("component"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = settle(rows)
    first = rows.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("m"))
    first = numbered(first, F.desc("size"), F.col("m")).select("root", (F.col("_n") - 1).cast("int").alias("component"))
    return rows.join(first, "root").select("id", "component")


def component_list(labels: DataFrame) -> DataFrame:
    """(component_id, size, members): size descending, then member list. A member list is a report; for large components use the labels."""

    got = labels.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.size("members").alias("size"), "members")
    return numbered(got, F.desc("size"), F.col("members")).select((F.col("_n") - 1).cast("int").alias("component_id"), "size", "members")


def label_propagation(pairs: DataFrame, max_rounds: int = 32) -> DataFrame:
    """Communities by synchronous label propagation over undirected weights max(confidence, 1e-6): (id, community).

    Each round a node takes the label of greatest weight among its neighbours, ties to the lowest; at most 32 rounds.
    Communities are numbered by their smallest member.
    """
    w = F.greatest("w", F.lit(1e-6)).alias("w")
    both = pairs.select("a", "b", w).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), w))
    adj = settle(both.filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")))
    now = settle(ends(pairs).withColumn("label", F.col("id")))
    for _ in range(max_rounds):
        votes = adj.join(now, adj["b"] == now["id"]).groupBy("a", "label").agg(F.sum("w").alias("v"))
        # equal votes may differ in the last digits by order of summation
        top = votes.groupBy(F.col("a").alias("id")).agg(F.min(F.struct((-F.round("v", 9)).alias("v"), "label")).alias("x")).select("id", F.col("x.label").alias("new"))
        after = settle(now.join(top, "id", "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("old")))
        changed = after.filter("label <> old").limit(1).count()
        now = after.drop("old")
        if not changed:
            break
    return number_communities(now.withColumnRenamed("label", "community"))


def number_communities(labels: DataFrame) -> DataFrame:
    """Number communities 0, 1, ... by smallest member; the table of communities, not of nodes, is ordered."""

    first = labels.groupBy("community").agg(F.min("id").alias("m"))
    first = numbered(first, "m").select("community", (F.col("_n") - 1).cast("int").alias("n"))
    return labels.join(first, "community").select("id", F.col("n").alias("community"))


def modularity(pairs: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: sum over communities of inner weight / 2m - gamma (degree / 2m)^2, on undirected weights."""
    w = F.greatest("w", F.lit(1e-6))
    l = labels.select("id", "community")
    e = pairs.filter("a <> b").select("a", "b", w.alias("w")).join(l.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(l.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inner = e.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg((2 * F.sum("w")).alias("e"))
    deg = e.select(F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy("community").agg(F.sum("w").alias("k"))
    two_m = F.sum("k").over(Window.partitionBy())
    rows = deg.join(inner, "community", "left").select(F.coalesce("e", F.lit(0.0)).alias("e"), "k", two_m.alias("m2"))
    return rows.agg(F.sum(F.col("e") / F.col("m2") - F.lit(gamma) * F.pow(F.col("k") / F.col("m2"), 2)).alias("modularity"))




def morphology_pass(nodes: DataFrame, edges: DataFrame, iterations: int = 1, relation_weights: dict[str, float] | None = None) -> DataFrame:
    """Message passing over (id, features) and (a, b, type): (id, features).

    A target gets the sum of its sources' features, weighted by relation and confidence, over max(sum of |weights|, 1),
    averaged with its own state if it has one; all nodes change at once. Only touched_to, connected_to and faced_to edges count, whatever their case. Features
    of different length raise an error.
    """
    weights = {"touched_to": 1.0, "connected_to": 1.0, "faced_to": 1.0, **{k.lower(): v for k, v in (relation_weights or {}).items()}}
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    conf = F.coalesce("confidence", F.lit(1.0)) if "confidence" in edges.columns else F.lit(1.0)
    e = settle(edges.filter(F.lower("type").isin(*weights)).select("a", "b", (table[F.lower("type")] * conf).alias("w")).filter("w <> 0"))
    sizes = nodes.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError("dimension_mismatch")
    now = settle(nodes.select("id", F.posexplode("features").alias("dim", "x")))
    for _ in range(iterations):
        got = e.join(now, e["a"] == now["id"]).groupBy(F.col("b").alias("id"), "dim").agg((F.sum(F.col("w") * F.col("x")) / F.greatest(F.sum(F.abs("w")), F.lit(1.0))).alias("m"))
        own, new = F.col("x"), F.col("m")
        now = settle(now.join(got, ["id", "dim"], "full_outer").select("id", "dim", F.when(new.isNull(), own).when(own.isNull(), new).otherwise((own + new) / 2).alias("x")))
    return now.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("features"))


def morphology_stats(edges: DataFrame) -> DataFrame:
    """Edges of each relation."""
    kinds = edges.select(F.lower("type").alias("relation")).filter(F.col("relation").isin("touched_to", "connected_to", "faced_to"))
    return kinds.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy("relation")


def dual_graph(edges: DataFrame) -> DataFrame:
    """Segments (id, a, b) that share an end point, both directions: (a, b).

    Two that share several end points pair at the least of them only, so the pairs, many times the input, need no shuffle
    to be distinct. Null ends join nothing. Rows of one id are gathered first.
    """
    # dealt by id before they are grouped: rows travel as they are, not as lists of one
    e = edges.select(F.col("id").alias("seg"), F.array("a", "b").alias("ends")).repartition("seg").groupBy("seg").agg(F.flatten(F.collect_list("ends")).alias("ends"))
    # without lambdas, which would keep the join's sides from sharing one shuffle
    e = e.withColumn("ends", F.sort_array(F.array_except("ends", F.array(F.lit(None).cast(e.schema["ends"].dataType.elementType)))))
    e = e.select("seg", F.posexplode("ends").alias("nth", "end"), "ends").select("seg", "end", F.when(F.col("nth") > 0, F.slice("ends", F.lit(1), F.col("nth"))).alias("less"))
    x, y = e.alias("x"), e.alias("y")
    first = F.col("x.less").isNull() | F.col("y.less").isNull() | ~F.arrays_overlap("x.less", "y.less")
    return x.join(y, (F.col("x.end") == F.col("y.end")) & (F.col("x.seg") != F.col("y.seg")) & first).select(F.col("x.seg").alias("a"), F.col("y.seg").alias("b"))


def topological_levels(pairs: DataFrame) -> DataFrame:
    """(id, level) by repeatedly taking nodes without incoming edges; raises on a cycle."""
    e = settle(pairs.select("a", "b").distinct())
    left = settle(ends(pairs))
    parts, level = None, 0
    while not left.isEmpty():
        free = settle(left.join(e.select(F.col("b").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            raise ValueError(f"cycle: {left.count()} nodes and {e.count()} edges are left")
        got = free.withColumn("level", F.lit(level))
        parts = got if parts is None else settle(parts.unionByName(got))
        left = settle(left.join(free, "id", "left_anti"))
        e = settle(e.join(free.withColumnRenamed("id", "a"), "a", "left_anti"))
        level += 1
    return parts if parts is not None else left.withColumn("level", F.lit(0))


__all__ = ["component_list", "components", "dual_graph", "edge_pairs", "ends", "label_propagation", "modularity", "morphology_pass", "morphology_stats", "number_communities", "pagerank", "ppr_rounds", "strong_components", "topological_levels"]
