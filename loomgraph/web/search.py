"""Search over the page graph: lexical and dense ranks fused, rings of links, personalised PageRank; and the crawl gate."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..algorithms.kernels import personalised
from ..functions.scalar import domain, lexical_score, snippet, title_from_url
from ..iterate import numbered, settle
from ..operators.match import reach

DIM, DENSE_LEAST, DENSE_TOP, RRF_K, RINGS = 128, 0.08, 64, 60, 2


def features(text: str) -> list[str]:
    """ASCII words of two characters or more, and their trigrams."""
    out, word = [], []
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word.append(c)
        elif word:
            if len(word) >= 2:
                out.append("".join(word))
            word = []
    return out


def embed(text: str, dim: int = DIM) -> np.ndarray:
    """A signed feature hash, length 1. The hash is SHA-256 (the usual one for this is not in the standard library), so places differ, not the method."""
    v = np.zeros(dim)

    def add(f: str, w: float) -> None:
        h = hashlib.sha256(f.encode()).digest()
        v[int.from_bytes(h[:4], "little") % dim] += w if h[4] & 1 == 0 else -w

    for t in features(text):
        add(t, 1.0)
        for i in range(len(t) - 2):
            add(f"tri:{t[i : i + 3]}", 0.35)
    n = math.sqrt(float(v @ v))
    return v / n if n > 1e-6 else v


def dense_scores(pages: DataFrame, query: str) -> DataFrame:
    """(id, dense): dot product of hashed texts, in Arrow batches."""
    q = embed(query)

    @F.pandas_udf("double")
    def dot(texts: pd.Series) -> pd.Series:
        return pd.Series([float(embed(t or "") @ q) for t in texts])

    return pages.select("id", dot(F.concat_ws(" ", "url", "text")).alias("dense"))


def substrate_search(pages: DataFrame, links: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Ranked pages (node_id, url, title, snippet, ring, label, score) over pages (id, url, text) and links (a, b).

    Lexical and dense ranks are fused (1 / (60 + rank)); the matches are ring 0, rings 1 and 2 come by undirected
    links; scores are PageRank personalised by the fused scores, or those scores; order is score, ring, id. An empty
    query lists pages by id, unranked.
    """
    show = [F.col("id").alias("node_id"), "url", title_from_url(F.col("url")).alias("title"), snippet(F.col("text")).alias("snippet")]
    if not query.strip():
        return pages.orderBy("id").limit(limit).select(*show, F.lit(0).alias("ring"), F.lit("browse").alias("label"), F.lit(0.0).alias("score"))
    terms = sorted({t for t in query.lower().split() if t})
    lex = pages.select("id", lexical_score(F.col("url"), F.col("text"), terms).alias("s")).filter("s > 0")
    dense = dense_scores(pages, query).filter(F.col("dense") >= DENSE_LEAST).select("id", F.col("dense").alias("s")).orderBy(F.desc("s"), "id").limit(DENSE_TOP)
    # ranks are given to hits alone; all of them seed the PageRank
    rank = lambda df: numbered(df, F.desc("s"), F.col("id")).select("id", (1.0 / (RRF_K + F.col("_n"))).alias("r"))
    fused = settle(rank(lex).unionByName(rank(dense)).groupBy("id").agg(F.sum("r").alias("rrf")))
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    rings = reach(fused.select("id"), both, RINGS).withColumnRenamed("depth", "ring")
    if not fused.isEmpty() and not both.isEmpty():
        scores = personalised(both.withColumn("w", F.lit(1.0)), fused.select("id", F.col("rrf").alias("m")), 0.15, 1e-5).filter("score > 0").withColumnRenamed("score", "ppr")  # a match that no push reached falls back to its fused score
    else:
        scores = pages.sparkSession.createDataFrame([], "id string, ppr double")
    j = rings.join(pages, "id").join(scores, "id", "left").join(fused, "id", "left")
    score = F.coalesce("ppr", "rrf", F.lit(0.0))
    label = F.when(F.col("ring") == 0, "match").otherwise(F.concat(F.lit("ring-"), F.col("ring").cast("string")))
    return j.select(*show, "ring", label.alias("label"), score.alias("score")).orderBy(F.desc("score"), "ring", "node_id").limit(limit)


def links_among(hits: DataFrame, links: DataFrame) -> DataFrame:
    ids = hits.select(F.col("node_id").alias("a"))
    return links.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b").distinct().orderBy("a", "b")


def search_stats(hits: DataFrame) -> DataFrame:
    """One row: hits, distinct hosts, mean and population variance of scores."""
    return hits.agg(F.count(F.lit(1)).alias("hit_count"), F.count_distinct(domain(F.col("url"))).alias("distinct_domains"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.coalesce(F.var_pop("score"), F.lit(0.0)).alias("score_variance"))


# Least hits, least domains, least mean score, most variance, seeds.
GATES = {"conservative": (1, 1, 0.01, 1.0, 3), "broad": (3, 2, 0.02, 0.5, 8)}


def trigger_gate(stats: DataFrame, query: str, dial: str = "conservative") -> DataFrame:
    """Whether local results are too thin and a crawl should start, and why; the first rule that holds decides."""
    hits, domains, mean, variance, seeds = GATES[dial]
    reason = (
        F.when(F.lit(not query.strip()), "browse mode does not trigger crawl").when(F.col("hit_count") == 0, "empty results").when(F.col("hit_count") < hits, "too few results")
        .when(F.col("distinct_domains") < domains, "too little domain coverage").when(F.col("mean_score") < mean, "low mean graph score").when(F.col("score_variance") > variance, "score variance is too high")
        .otherwise("local substrate evidence is sufficient")
    )
    calm = reason.isin("browse mode does not trigger crawl", "local substrate evidence is sufficient")
    return stats.select((~calm).alias("should_crawl"), reason.alias("reason"), "*", F.lit(seeds).alias("max_crawl_seeds"))
