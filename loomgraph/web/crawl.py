"""The crawl graph: fetched pages to nodes and edges, budgets, fragments, peer support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_url, domain, html_text, links, source_class, trust_weight
from ..iterate import settle
from ..model import PropertyGraph

TEXT_BYTES = 4096
PAGE_LIMIT, BYTE_LIMIT = 25, 5 << 20


def page_id(url: Column) -> Column:
    return F.concat(F.lit("page:"), url)


def fetched(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Canonical pages with text, domain, class, links and a content hash; addresses that can't be fetched are dropped."""
    have = set(pages.columns)
    t = pages.select(
        canonical_url(F.col(url)).alias("url"), F.col(url).alias("raw_url"), F.coalesce(body, F.lit("")).alias("html"),
        (F.col("status") if "status" in have else F.lit(200)).cast("int").alias("status"), (F.col("fetched_at") if "fetched_at" in have else F.lit(None)).cast("string").alias("fetched_at"),
    ).filter("url is not null")
    return t.select("*", html_text(F.col("html")).alias("text"), domain(F.col("url")).alias("domain"), source_class(F.col("url")).alias("source_class"), links(F.col("url"), F.col("html")).alias("links"), F.sha2("html", 256).alias("body_hash"))


def budget(pages: DataFrame, order: str, size: Column, page_limit: int = PAGE_LIMIT, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """Pages in order until the count or the bytes overflow; everything from the first overflow on is left out.

    This is a limit by definition: at most ``page_limit`` rows are ranked after a top-k.
    """
    first = pages.withColumn("_size", size).orderBy(order).limit(page_limit)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("_sum", F.sum("_size").over(w)).withColumn("_over", F.max((F.col("_sum") > byte_limit).cast("int")).over(w)).filter("_over = 0").drop("_size", "_sum", "_over")


def crawl_graph(pages: DataFrame, run_id: str) -> PropertyGraph:
    """Run, attempt, page, snapshot, domain, robots and alias nodes with their edges; link targets become discovered pages.

    Nodes and edges are keyed, so repeats collapse by one aggregation on the id.
    """
    f = settle(fetched(pages))  # many tables come from it
    pid, did = page_id(F.col("url")), F.concat(F.lit("domain:"), "domain")
    sid, aid = F.concat(F.lit("snapshot:"), "body_hash"), F.concat(F.lit(f"attempt:{run_id}:"), "url")

    def node(df: DataFrame, node_id: Column, label: str, props: Column, rank: int = 0) -> DataFrame:
        return df.select(node_id.alias("id"), F.array(F.lit(label)).alias("labels"), props.alias("properties"), F.lit(rank).alias("rank"))

    run = f.sparkSession.createDataFrame([(f"run:{run_id}", ["CrawlRun"], "{}", 0)], "id string, labels array<string>, properties string, rank int")
    out = f.select("url", "domain", F.explode("links").alias("target")).distinct()
    nodes = (
        run.unionByName(node(f, aid, "FetchAttempt", F.to_json(F.struct("url", "status", "fetched_at"))))
        .unionByName(node(f, pid, "Page", F.to_json(F.struct("url", "domain", "source_class", F.lit("fetched").alias("state")))))
        .unionByName(node(f, sid, "ContentSnapshot", F.to_json(F.struct("body_hash", F.octet_length("html").alias("bytes")))))
        .unionByName(node(f, did, "Domain", F.to_json(F.struct("domain"))))
        .unionByName(node(f, F.concat(F.lit("robots:"), "domain"), "RobotsPolicy", F.to_json(F.struct("domain"))))
        .unionByName(node(f.filter("raw_url <> url"), F.concat(F.lit("alias:"), "raw_url"), "UrlAlias", F.to_json(F.struct(F.col("raw_url").alias("url")))))
        .unionByName(node(out, page_id(F.col("target")), "Page", F.to_json(F.struct(F.col("target").alias("url"), domain(F.col("target")).alias("domain"), F.lit("discovered").alias("state"))), 1))
        .unionByName(node(out, F.concat(F.lit("domain:"), domain(F.col("target"))), "Domain", F.to_json(F.struct(domain(F.col("target")).alias("domain"))), 1))
    )
    nodes = nodes.groupBy("id").agg(F.min(F.struct("rank", "properties", "labels")).alias("x")).select("id", "x.labels", "x.properties")

    def edge(df: DataFrame, a: Column, kind: str, b: Column) -> DataFrame:
        return df.select(F.concat(a, F.lit(f"|{kind}|"), b).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"))

    edges = (
        edge(f, F.lit(f"run:{run_id}"), "FETCHED", aid).unionByName(edge(f, aid, "RESULTED_IN", pid)).unionByName(edge(f, pid, "HAS_SNAPSHOT", sid)).unionByName(edge(f, pid, "ON_DOMAIN", did))
        .unionByName(edge(f, did, "HAS_ROBOTS", F.concat(F.lit("robots:"), "domain"))).unionByName(edge(f.filter("raw_url <> url"), F.concat(F.lit("alias:"), "raw_url"), "ALIAS_OF", pid))
        .unionByName(edge(out, pid, "LINKS_TO", page_id(F.col("target")))).unionByName(edge(out, page_id(F.col("target")), "ON_DOMAIN", F.concat(F.lit("domain:"), domain(F.col("target")))))
    ).dropDuplicates(["id"])
    return PropertyGraph.of(nodes, edges)


def annotate(g: PropertyGraph, namespace: str, licence: str, ttl_expires_at_ms: int | None = None) -> PropertyGraph:
    """Note scope on every node's properties."""
    extra = {"_namespace": namespace, "_licence": licence} | ({"_ttl_expires_at_ms": ttl_expires_at_ms} if ttl_expires_at_ms is not None else {})
    import json

    tail = json.dumps(extra)[1:]
    props = F.when(F.col("properties") == "{}", F.lit("{" + tail)).otherwise(F.concat(F.expr("substring(properties, 1, length(properties) - 1)"), F.lit(", " + tail)))
    return PropertyGraph.of(g.nodes.withColumn("properties", props).drop("prop_tokens", "content_hash"), g.edges)


def unexpired(nodes: DataFrame, now_ms: int) -> DataFrame:
    """Nodes whose time to live, if they have one, lies ahead."""
    t = F.regexp_extract(F.coalesce(F.col("prop_tokens")["_ttl_expires_at_ms"], F.lit("")), "^int:(.*)$", 1).try_cast("bigint")
    return nodes.filter(t.isNull() | (t > now_ms))


def fragment(pages: DataFrame, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Pages for exchange: url, domain, title hash, text cut at a byte bound (whole characters), links."""
    f = fetched(pages)
    cut = F.regexp_replace(F.expr(f"substring(encode(text, 'UTF-8'), 1, {text_bytes})").cast("string"), "�+$", "")
    return f.select("url", "domain", cut.alias("text"), "body_hash", "links")


def ingest_plan(frag: DataFrame, peer: str) -> PropertyGraph:
    """Peer, domain, page, snapshot, attestation nodes and links of a received fragment."""
    pid = page_id(F.col("url"))
    rec = lambda df, i, label, props: df.select(i.alias("id"), F.array(F.lit(label)).alias("labels"), props.alias("properties"))
    att = F.concat(F.lit(f"attestation:{peer}:"), "url")
    out = frag.select("url", F.explode("links").alias("target"))
    nodes = (
        rec(frag.limit(1), F.lit(f"peer:{peer}"), "Peer", F.lit("{}")).unionByName(rec(frag, F.concat(F.lit("domain:"), "domain"), "Domain", F.to_json(F.struct("domain")))).unionByName(rec(frag, pid, "Page", F.to_json(F.struct("url", "domain"))))
        .unionByName(rec(frag, F.concat(F.lit("snapshot:"), "body_hash"), "ContentSnapshot", F.to_json(F.struct("text")))).unionByName(rec(frag, att, "Attestation", F.to_json(F.struct(F.lit(peer).alias("peer"), "url"))))
        .unionByName(rec(out, page_id(F.col("target")), "Page", F.to_json(F.struct(F.col("target").alias("url"), domain(F.col("target")).alias("domain")))))
    ).dropDuplicates(["id"])
    e = lambda df, a, kind, b: df.select(F.concat(a, F.lit(f"|{kind}|"), b).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"))
    edges = (
        e(frag, pid, "ON_DOMAIN", F.concat(F.lit("domain:"), "domain")).unionByName(e(frag, pid, "HAS_SNAPSHOT", F.concat(F.lit("snapshot:"), "body_hash")))
        .unionByName(e(frag, F.lit(f"peer:{peer}"), "ATTESTS", att)).unionByName(e(frag, att, "ATTESTED", pid)).unionByName(e(out, pid, "LINKS_TO", page_id(F.col("target"))))
    ).dropDuplicates(["id"])
    return PropertyGraph.of(nodes, edges)


def peer_weights(peers: DataFrame) -> DataFrame:
    """(peer, weight) from records (peer, weight?, tier?): any weight of 0 or less forces 0, else the largest."""
    w = F.coalesce("weight", trust_weight(F.col("tier")))
    return peers.select("peer", w.alias("w")).groupBy("peer").agg(F.when(F.min("w") <= 0, F.lit(0.0)).otherwise(F.max("w")).alias("weight"))


def support(attestations: DataFrame, weights: DataFrame) -> DataFrame:
    """Per page: distinct peers, their weights, distinct linking domains, external share, spread in time. Input: (page, peer, domain, page_domain, at_ms)."""
    per_peer = attestations.join(weights, "peer", "left").na.fill({"weight": 0.3}).groupBy("page", "peer").agg(F.max("weight").alias("w"))
    a = per_peer.groupBy("page").agg(F.count(F.lit(1)).alias("peers"), F.sum("w").alias("weight"))
    b = attestations.groupBy("page").agg(F.count_distinct("domain").alias("domains"), F.avg((F.col("domain") != F.col("page_domain")).cast("double")).alias("external"), (F.max("at_ms") - F.min("at_ms")).alias("spread_ms"))
    return a.join(b, "page")


def dispositions(pages: DataFrame, supported: DataFrame) -> DataFrame:
    """(page, disposition): dropped without identity, canonical with independent support, else probationary."""
    j = pages.join(supported, "page", "left")
    blank = (F.coalesce(F.trim("page"), F.lit("")) == "") | (F.coalesce(F.trim("url"), F.lit("")) == "") | (F.coalesce(F.trim("domain"), F.lit("")) == "")
    good = (F.col("peers") >= 2) & (F.col("weight") >= 1.0) & (F.col("domains") >= 2) & (F.col("external") >= 0.5) & (F.col("spread_ms") >= 1)
    return j.select("page", F.when(blank, "dropped").when(F.coalesce(good, F.lit(False)), "canonical").otherwise("probationary").alias("disposition"))
