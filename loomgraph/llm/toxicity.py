"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, learned stem, target, negation, reported speech, other, clause end). One transducer
for each phenomenon rewrites hot classes into aimed or weakened ones: a negated insult is another class than an insult.
Those that look back are composed into one machine that runs left to right, those that look ahead into one that runs
right to left. A document's score comes from how many of its clauses hold each rewritten class, never from words alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, smallest_hashes, split_words, stored

#: Labelled rows used to learn, at most; those with the smallest id hashes among rows that may teach.
MAX_LABELS = 20_000
#: A document counts as toxic from this score on.
TOXIC_FROM = 0.3

OTHER, INSULT, THREAT, LEARNED, TARGET, NEGATION, REPORT, END = range(8)
HOT = (INSULT, THREAT, LEARNED)
#: Marks that a transducer puts on a hot class.
AIMED, WEAK = 1, 2
SYMBOLS = 8 + 3 * len(HOT)


def marked(symbol: int, mark: int) -> int:
    """The class ``symbol`` with ``mark`` added; classes that aren't hot have no marks."""
    base, had = unmarked(symbol)
    if base not in HOT:
        return symbol
    had |= mark
    return 8 + 3 * HOT.index(base) + had - 1


def unmarked(symbol: int) -> tuple[int, int]:
    """The class as read from the words, and its marks."""
    return (symbol, 0) if symbol < 8 else (HOT[(symbol - 8) // 3], (symbol - 8) % 3 + 1)


#: What a clause may hold, in the order of the weights: each hot class bare, aimed, weakened, both.
VARIANTS = tuple(marked(h, m) if m else h for h in HOT for m in (0, AIMED, WEAK, AIMED | WEAK))

#: Words of each class before anything is learned, by stem; a stem with $ must be the whole word.
SEED = {
    INSULT: "idiot moron stupid$ loser$ losers$ scum$ trash$ clown$ pathetic$ worthless$ disgusting$ imbecile dumbass filth$ vermin$ garbage$ ugly$ coward",
    THREAT: "kill$ killing$ murder strangle hurt$ destroy$ crush$ beat$ shoot$ stab$ burn$",
    TARGET: "you$ your$ yours$ yourself$ you're$ he$ him$ she$ her$ they$ them$ their$ people$ tu$ vous$ vos$ du$ dich$ dein ihr$ euch$ usted$ ustedes$ eres$",
    NEGATION: "not$ no$ never$ isn't$ aren't$ don't$ doesn't$ didn't$ won't$ without$ nicht$ kein nie$ pas$ jamais$ nunca$ ne$",
    REPORT: "said$ says$ told$ quote$ quoted$ called$ calls$ claimed$ wrote$ reported$ sagte$ dijo$ disait$",
}


# --------------------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """A deterministic transducer: (state, class in) -> (state, class out); state 0 starts every clause. Arcs that aren't listed change nothing."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: list[int]) -> list[int]:
        out, state, arcs = [], 0, self.arcs
        for c in symbols:
            state, c = arcs.get((state, c), (state, c))
            out.append(c)
        return out


def near(trigger: int, reach: int, mark: int, hit: tuple[int, ...] = HOT) -> Transducer:
    """Hot classes of ``hit`` among the ``reach`` words after ``trigger`` get ``mark``; reach 0 means up to the clause's end."""
    n = 2 if reach == 0 else reach + 1
    t = Transducer(n)
    for s in range(n):
        for c in range(SYMBOLS):
            nxt = 0 if c == END else n - 1 if c == trigger else s if reach == 0 else max(0, s - 1)
            t.arcs[s, c] = (nxt, marked(c, mark) if s and unmarked(c)[0] in hit else c)
    return t


def phrase(kind: int) -> Transducer:
    """Words of one hot class in a row are one phrase: all but the first become other words."""
    t = Transducer(2)
    for s in range(2):
        for c in range(SYMBOLS):
            own = unmarked(c)[0] == kind
            t.arcs[s, c] = (int(own), OTHER if s and own else c)
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The cascade a then b as one machine over pairs of states: b reads what a writes."""
    out = Transducer(a.states * b.states)
    for s in range(a.states):
        for r in range(b.states):
            for c in range(SYMBOLS):
                s2, mid = a.step(s, c)
                r2, last = b.step(r, mid)
                out.arcs[s * b.states + r, c] = (s2 * b.states + r2, last)
    return out


@dataclass(frozen=True)
class Grammar:
    """The machine that reads a clause left to right, and the one that reads the result right to left."""

    forward: Transducer
    backward: Transducer

    def rewrite(self, classes: list[int]) -> list[int]:
        return self.backward.run(self.forward.run(classes)[::-1])[::-1]


def grammar() -> Grammar:
    """Insult and threat phrases; weakened up to 3 words after a negation or anywhere after reported speech; insults aimed
    by a target up to 4 words before or 3 after, threats by one up to 3 words after."""
    forward = phrase(INSULT)
    for t in (phrase(THREAT), near(NEGATION, 3, WEAK), near(REPORT, 0, WEAK), near(TARGET, 4, AIMED, (INSULT, LEARNED))):
        forward = compose(forward, t)
    return Grammar(forward, near(TARGET, 3, AIMED))


# --------------------------------------------------------------------------- words to classes


def _normal(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}]+|[^\p{L}]+$", "")


@dataclass(frozen=True)
class Lexicon:
    """Stems by class: a word takes the class of a stem that is its prefix, or with $ the whole word."""

    stems: tuple[tuple[str, int], ...]

    def classes(self, words: list[str]) -> np.ndarray:
        table = dict(self.stems)
        sizes = sorted({len(s) for s in table if s[-1:] != "$"})
        out = np.zeros(len(words), np.int8)
        for i, w in enumerate(words):
            c = table.get(w + "$")
            if c is None:
                for k in sizes:
                    if k > len(w):
                        break
                    if (c := table.get(w[:k])) is not None:
                        break
            out[i] = c or 0
        return out


def seeds() -> dict[str, int]:
    return {s: c for c, text in SEED.items() for s in text.split()}


def matched_clauses(texts: pa.Array, lexicon: Lexicon, g: Grammar) -> np.ndarray:
    """Of each text, how many of its clauses hold each of ``VARIANTS``; a clause ends with a word that ends in one of ``.!?;:``."""
    doc, code, words = split_words(texts)
    out = np.zeros((len(texts), len(VARIANTS)), np.int64)
    if not len(words):
        return out
    normal = _normal(words)
    kind = lexicon.classes(normal.to_pylist())[code]
    ends = pc.match_substring_regex(words, r"[.!?;:]$").to_numpy(zero_copy_only=False)[code]
    clause = np.zeros(len(code), np.int64)
    clause[1:] = np.cumsum(ends[:-1] | (doc[1:] != doc[:-1]))
    column = {v: k for k, v in enumerate(VARIANTS)}
    hot = np.unique(clause[np.isin(kind, HOT)])
    for lo, hi in zip(np.searchsorted(clause, hot).tolist(), np.searchsorted(clause, hot + 1).tolist()):
        for v in {column[c] for c in g.rewrite(kind[lo:hi].tolist()) if c in column}:
            out[doc[lo], v] += 1
    return out


# --------------------------------------------------------------------------- learning


def may_teach(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2


def _terms(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(7, len(word)) + 1)] + [word + "$"] * (len(word) <= 12)


def _count_terms(batches):
    """By term: toxic documents, distinct words of toxic documents, distinct words of all documents; summed batch by batch."""
    for batch in batches:
        for part in chunks(batch, 0):
            doc, code, words = split_words(part.column(0))
            toxic = part.column(1).to_numpy(zero_copy_only=False)
            terms: dict[str, int] = {}
            spelled = [[terms.setdefault(t, len(terms)) for t in _terms(w)] if len(w) >= 3 else [] for w in _normal(words).to_pylist()]
            width = np.fromiter(map(len, spelled), np.int64, len(spelled))
            flat = np.array([t for x in spelled for t in x], np.int64)
            begin = np.cumsum(width) - width
            key = np.unique(doc * (len(words) + 1) + code) if len(code) else np.zeros(0, np.int64)
            d, c = key // (len(words) + 1), key % (len(words) + 1)
            d = np.repeat(d, width[c])
            at = np.repeat(begin[c], width[c]) + np.arange(len(d)) - np.repeat(np.cumsum(width[c]) - width[c], width[c])
            t = flat[at]
            n = np.bincount(t, minlength=len(terms))
            bad = np.bincount(t, weights=toxic[d], minlength=len(terms)).astype(np.int64)
            t = np.unique(d * (len(terms) + 1) + t)[:] if len(d) else np.zeros(0, np.int64)
            docs = np.bincount(t % (len(terms) + 1), weights=toxic[t // (len(terms) + 1)], minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()), pa.array(docs), pa.array(bad), pa.array(n)], names=["term", "docs", "toxic", "n"])


def _wilson(k: Column, n: Column, z: float = 2.6) -> Column:
    """Lower bound of the share k/n."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


#: Least toxic shares (lower bounds) that stems need, pass after pass.
BOUNDS = (0.9, 0.5)


def induce(sample: DataFrame) -> Lexicon:
    """Seed stems, and stems that the labelled texts (text, toxic) show in toxic documents nearly alone, as the class LEARNED.

    Each pass looks at the toxic documents in which no stem is found yet, beside all others: words that only go with
    what is known already, as in copies of one document, teach nothing. Evidence is counted in distinct words per
    document, since a stem of one document may come with many endings. A stem qualifies if it is in two toxic documents
    and the lower bound of its toxic share is above the pass's bound; of nested stems the shortest is kept. The
    sample is bounded, so the stems that reach the driver are.
    """
    table = seeds()
    for bound in BOUNDS:
        lexicon, g = Lexicon(tuple(sorted(table.items()))), grammar()

        def unexplained(batches, lexicon=lexicon, g=g):
            for batch in batches:
                for part in chunks(batch, 0):
                    found = matched_clauses(part.column(0), lexicon, g).sum(axis=1) > 0
                    yield part.filter(pa.array(~found | (part.column(1).to_numpy(zero_copy_only=False) == 0)))

        left = sample.select("text", "toxic").mapInArrow(unexplained, "text string, toxic int")
        counted = left.mapInArrow(_count_terms, "term string, docs long, toxic long, n long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        good = counted.filter("docs >= 2").filter(_wilson(F.col("toxic"), F.col("n")) > bound).select("term").collect()
        for t in sorted((r["term"] for r in good), key=lambda t: (len(t.rstrip("$")), t)):
            if t not in table and not any(t[:k] in table for k in range(3, len(t))):
                table[t] = LEARNED
    return Lexicon(tuple(sorted(table.items())))


#: Weights of ``VARIANTS`` and the bias where labels say nothing: bare words don't make a document toxic, aimed clauses do.
PRIOR = np.array([1.2, 4.0, 0.2, 0.8, 0.3, 4.0, 0.1, 0.8, 1.2, 4.0, 0.2, 0.8])
BIAS = -2.2


def calibrate(counts: np.ndarray, toxic: np.ndarray, plain: np.ndarray, strength: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over log(1 + clauses) by damped Newton steps; ``strength`` pulls towards the prior.

    Rows are distinct clause counts with their numbers of toxic and plain documents. A variant never weighs less aimed
    than bare, nor less bare than weakened.
    """
    x = np.column_stack([np.log1p(counts), np.ones(len(counts))])
    start = np.append(PRIOR, BIAS)
    w, n = start.copy(), toxic + plain
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * p - toxic) + strength * (w - start)
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    of = np.maximum(w[:-1], 0.0).reshape(len(HOT), 4)
    of[:, 1] = np.maximum(of[:, 0], of[:, 1])
    of[:, 2:] = np.minimum(of[:, 2:], of[:, :2])
    return of.ravel(), float(w[-1])


def scores(counts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of toxicity from clause counts."""
    return 1 / (1 + np.exp(-np.clip(np.log1p(counts) @ weights + bias, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """Score every whole text: rows (doc_id, held_out, score, predicted, n_clauses).

    At most ``max_labels`` labelled rows that may teach (crc32 of the id modulo 4 is not 2; smallest id hashes
    first) extend the lexicon and fit the weights of the clause variants. Only the text makes a score; ``n_clauses``
    counts matches, a clause once for each variant that it holds. Null and empty texts match nothing and get the
    lowest score; rows with null ids are scored (held_out false); repeated rows each get a row, repeated labels of one
    id each teach; extra columns are ignored; without labels the seeds and the prior weights are used; an empty table
    gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = labels.filter("doc_id is not null and toxic is not null").filter(may_teach(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = smallest_hashes(some, "doc_id", max_labels)  # a size-bounded side
    sample = stored(texts.join(F.broadcast(some), "doc_id").select("text", "toxic").filter("text is not null"), "labelled")
    lexicon, g = induce(sample), grammar()

    def fit(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                found = matched_clauses(part.column(0), lexicon, g)
                yield pa.RecordBatch.from_arrays([*map(pa.array, found.T), part.column(1)], names=[*names, "toxic"])

    # documents with equal counts are one row, so the driver gets a table of distinct counts of a bounded sample
    names = [f"v{k}" for k in range(len(VARIANTS))]
    seen = sample.mapInArrow(fit, ", ".join(f"{k} long" for k in names) + ", toxic int").groupBy(*names).agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n")).orderBy(*names).toPandas()
    weights, bias = calibrate(seen[names].to_numpy(float).reshape(-1, len(names)), seen["k"].to_numpy(float), (seen["n"] - seen["k"]).to_numpy(float))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                found = matched_clauses(part.column(1), lexicon, g)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(found, weights, bias)), pa.array(found.sum(axis=1))], names=["doc_id", "score", "n_clauses"])

    out = texts.mapInArrow(run, "doc_id long, score double, n_clauses long")
    return out.select("doc_id", F.coalesce(~may_teach(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxic_from).cast("int").alias("predicted"), "n_clauses")


def average_precision(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the precision-recall curve, for held-out checks."""
    order = np.argsort(-score, kind="stable")
    hit = label[order] == 1
    return float((np.cumsum(hit) / np.arange(1, len(hit) + 1))[hit].mean()) if hit.any() else math.nan


__all__ = ["Grammar", "Lexicon", "Transducer", "average_precision", "calibrate", "compose", "grammar", "induce", "marked", "matched_clauses", "may_teach", "near", "phrase", "scores", "seeds", "toxicity", "unmarked"]
