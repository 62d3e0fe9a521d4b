"""Quality classifier from weak labels: expectation-maximisation estimates how accurate overlapping heuristic labellers
are, and their posterior labels train a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, smallest_hashes, stored
from .textstats import BUCKETS, COUNTS, counts, shape_features

#: Documents that train the linear scorer, at most; those with the smallest id hashes.
MAX_TRAIN = 20_000
#: A document is rejected if its score (probability of good quality) is below this.
REJECT_BELOW = 0.5


def _rate(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _vote(bad: Column, good: Column) -> Column:
    """-1 for low quality, 1 for good, 0 for no opinion."""
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def labellers() -> dict[str, Column]:
    """The heuristic labellers over the counts of :mod:`textstats`; they overlap and err, which is what EM measures."""
    n = F.col("n_words")
    long = n >= 20
    symbols, repeats, same = _rate("n_symbols", "word_chars"), _rate("n_repeat_words", "n_words"), _rate("n_same_as_before", "n_words")
    bare, ended, short, distinct = _rate("n_bare", "n_words"), _rate("n_ended", "n_words"), _rate("n_short", "n_words"), _rate("n_distinct", "n_words")
    lines, length = _rate("n_dup_lines", "n_lines"), _rate("word_chars", "n_words")
    return {
        "symbols": _vote(symbols > 0.04, symbols < 0.002),
        "repeats": _vote(long & (repeats > 0.3), long & (repeats < 0.1)),
        "same": _vote(same > 0.15, same < 0.01),
        "bare": _vote(bare > 0.1, bare < 0.01),
        "sentences": _vote(long & ((ended < 0.01) | (ended > 0.6)), long & ended.between(0.03, 0.4)),
        "short_words": _vote(long & ((short < 0.1) | (short > 0.8)), long & short.between(0.2, 0.65)),
        "variety": _vote(long & (distinct < 0.15), long & (distinct > 0.35)),
        "lines": _vote(lines > 0.4, lines < 0.1),
        "length": _vote((length < 2) | (length > 14), length.between(3.0, 9.0)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Class prior and, per labeller and class (0 low, 1 good), the chances of the votes -1, 0, 1."""

    prior: np.ndarray
    chance: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of votes."""
        logp = np.log(self.prior)[None, :] + sum(np.log(self.chance[j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        logp -= logp.max(axis=1, keepdims=True)
        p = np.exp(logp)
        return p[:, 1] / p.sum(axis=1)


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> LabelModel:
    """Fit the label model to distinct vote patterns with their counts; at the start a pattern is the less likely good the more labellers call it low."""
    n, m = votes.shape
    low = (votes == -1).sum(axis=1)
    p = np.where(low > 0, 0.5 / (1.0 + low), 0.95) if n else np.zeros(0)
    for _ in range(rounds):
        w = np.stack([weight * (1 - p), weight * p])
        prior = np.clip((w.sum(axis=1) + smooth) / (w.sum() + 2 * smooth), 0.01, 0.99)
        chance = np.stack([np.stack([[w[c][votes[:, j] == v].sum() + smooth for v in (-1, 0, 1)] for c in (0, 1)]) for j in range(m)])
        chance /= chance.sum(axis=2, keepdims=True)
        model = LabelModel(prior, chance)
        q = model.posterior(votes) if n else p
        if np.abs(q - p).max(initial=0) < 1e-6:
            break
        p = q
    return model


def fit_linear(docs: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on sparse hashed features with soft targets (full-batch, adaptive steps); the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    if not docs:
        return w
    row = np.repeat(np.arange(len(docs)), [len(i) for i, _ in docs])
    col = np.concatenate([i for i, _ in docs]).astype(np.int64)
    val = np.concatenate([v for _, v in docs]).astype(float)
    used, col = np.unique(col, return_inverse=True)
    u, b = np.zeros(len(used)), 0.0
    # rare classes count as much as frequent ones, so that the bias can't swallow them
    heavy = np.where(target < 0.5, 0.5 / max(1e-9, (1 - target).sum()), 0.5 / max(1e-9, target.sum()))
    gu, gb = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights=val * u[col], minlength=len(docs)) + b
        err = heavy * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        du = np.bincount(col, weights=val * err[row], minlength=len(used)) + penalty * u / len(docs)
        db = err.sum()
        gu, gb = gu + du * du, gb + db * db
        u -= 1.0 * du / np.sqrt(gu)
        b -= 0.3 * db / np.sqrt(gb)
    w[used], w[-1] = u, b
    return w


def _digest_texts(batches):
    for batch in batches:
        for part in chunks(batch, 1):
            c = counts(part.column(1))
            doc, bucket, share = shape_features(c, part.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=part.num_rows))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c[k]) for k in COUNTS], pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(share.astype(np.float32)))],
                names=["rid", *COUNTS, "f", "v"],
            )


def pc_len(lists: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """What :func:`classify` says of ``docs`` before scoring: a row of counts and features per document, and the scorer's weights."""
    rid = docs.select(F.col(key).cast("long").alias("rid"), F.col(text).cast("string").alias("text"))
    schema = "rid long, " + ", ".join(f"{k} long" for k in COUNTS) + ", f array<smallint>, v array<float>"
    seen = stored(rid.mapInArrow(_digest_texts, schema), "shapes")
    votes = labellers()
    names = list(votes)
    voted = seen.filter("n_words > 0").select("rid", "f", "v", *[votes[k].cast("int").alias(k) for k in names])
    patterns = voted.groupBy(*names).count().toPandas()
    model = expectation_maximisation(patterns[names].to_numpy(np.int64).reshape(-1, len(names)), patterns["count"].to_numpy(float))
    sample: pd.DataFrame = smallest_hashes(voted.filter("rid is not null"), "rid", max_train).toPandas()
    target = model.posterior(sample[names].to_numpy(np.int64).reshape(-1, len(names))) if len(sample) else np.zeros(0)
    return seen, fit_linear([(np.asarray(f), np.asarray(v)) for f, v in zip(sample["f"], sample["v"])], target)


def _scores(weights: np.ndarray, doc: np.ndarray, f: np.ndarray, v: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Probability of good quality of each document from its features; 0 without words."""
    z = np.bincount(doc, weights=weights[f] * v, minlength=len(words)) + weights[-1]
    return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def classify(docs: DataFrame, max_train: int = MAX_TRAIN, reject_below: float = REJECT_BELOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score the quality of every document: rows (key, score, kept, n_words).

    One pass over the texts writes counts and hashed word-shape shares. Vote patterns (at most 3^9) are counted
    over all documents and fitted by EM; at most ``max_train`` documents with the smallest id hashes train the
    linear scorer on their posteriors. The score is the scorer's probability of good quality; a document is
    rejected below ``reject_below``. Labels are never read.

    Null and empty texts have no words and score 0 (rejected); null keys, repeated rows and extra columns are
    allowed, each row gets a result; an empty table gives an empty result.
    """
    seen, weights = fit(docs, max_train, key, text)

    def run(batches):
        for batch in batches:
            f, words = batch.column(2), batch.column(1).to_numpy()
            p = _scores(weights, np.repeat(np.arange(batch.num_rows), pc_len(f)), f.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= reject_below), batch.column(1)], names=["rid", "score", "kept", "n_words"])

    return seen.select("rid", "n_words", "f", "v").mapInArrow(run, "rid long, score double, kept boolean, n_words long").withColumnRenamed("rid", key)


def accepted(docs: DataFrame, max_train: int = MAX_TRAIN, reject_below: float = REJECT_BELOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, all columns untouched.

    Texts are read a second time, each row judged where it lies, so nothing is matched by key and no text is shuffled.
    """
    from pyspark.sql import types as T

    weights = fit(docs, max_train, key, text)[1]
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, at):
                c = counts(part.column(at))
                doc, bucket, share = shape_features(c, part.num_rows)
                yield part.filter(pa.array(_scores(weights, doc, bucket, share.astype(np.float32), c["n_words"]) >= reject_below))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return docs.mapInArrow(run, schema)
