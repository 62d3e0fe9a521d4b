"""Learned decision lists: sequential covering grows and prunes threshold conjunctions on labelled statistics and emits
them as one ordered Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, smallest_hashes, stored
from .textstats import COUNTS, counts

#: Labelled rows used to learn, at most; those with the smallest id hashes.
MAX_LABELS = 20_000


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and the counts of :mod:`textstats` over its whole text (null: empty)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                c = counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c[k]) for k in COUNTS]], names=["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _rate(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """The statistics that rules may test, all from the counts."""
    return {
        "symbol_rate": _rate("n_symbols", "word_chars"),
        "repeat_rate": _rate("n_repeat_words", "n_words"),
        "same_rate": _rate("n_same_as_before", "n_words"),
        "bare_rate": _rate("n_bare", "n_words"),
        "ended_rate": _rate("n_ended", "n_words"),
        "short_rate": _rate("n_short", "n_words"),
        "distinct_rate": _rate("n_distinct", "n_words"),
        "dup_line_rate": _rate("n_dup_lines", "n_lines"),
        "mean_length": _rate("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    """The fixed rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it "at least", threshold) under which a document is dropped."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, least, t in self.tests:
            col = x[:, names.index(f)]
            out &= (col >= t) if least else (col < t)
        return out

    def column(self, f: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, least, t in self.tests:
            out = out & ((f[name] >= F.lit(t)) if least else (f[name] < F.lit(t)))
        return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int = 3, cuts: int = 64) -> Rule:
    """Add the test of highest information gain until only dropped rows are covered or ``most`` tests are there."""
    tests: list[tuple[str, bool, float]] = []
    on = np.ones(len(x), bool)
    while len(tests) < most and not y[on].all():
        p0, n0 = y[on].sum(), (~y[on]).sum()
        best = (0.0, None)
        for j, f in enumerate(names):
            col = x[on, j]
            edges = np.unique(np.quantile(col, np.linspace(0, 1, cuts + 2)[1:-1]))
            pos = np.sort(col[y[on]])
            neg = np.sort(col[~y[on]])
            for least in (True, False):
                p = np.searchsorted(pos, edges) if not least else p0 - np.searchsorted(pos, edges)
                n = np.searchsorted(neg, edges) if not least else n0 - np.searchsorted(neg, edges)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain)) if len(gain) else -1
                if k >= 0 and gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (f, least, float(edges[k])))
        if best[1] is None:
            break
        tests.append(best[1])
        on = Rule(tuple(tests)).holds(x, names)
    return Rule(tuple(tests))


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """Drop tests from the end while (p - n) / (p + n) on held-back rows doesn't fall."""

    def worth(r: Rule) -> float:
        on = r.holds(x, names)
        p, n = int(y[on].sum()), int((~y[on]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.tests) - 1, 0, -1):
        shorter = Rule(rule.tests[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(x: np.ndarray, drop: np.ndarray, names: list[str], most: int = 12, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering: rules in order, each learned on what the ones before leave; empty if nothing is learnable.

    Every third row is held back to prune and to judge: a rule stays if at least ``precision`` of the held-back and
    of the growing rows under it are to be dropped, and it covers ``least`` of them.
    """
    held = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most:
        g, h = left & ~held, left & held
        if drop[g].sum() < least:
            break
        rule = _grow(x[g], drop[g], names)
        if not rule.tests:
            break
        rule = _prune(rule, x[h], drop[h], names)
        on = rule.holds(x, names)
        if any((c := on & part).sum() and drop[c].mean() < precision for part in (g, h)) or drop[on & left].sum() < least:
            break
        rules.append(rule)
        left &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: the first rule that holds drops a document, otherwise it is kept."""
    f = features()
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(f), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(f), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[DataFrame, list[Rule]]:
    """Counts, the fixed rule and the learned verdict of every document; also the rules.

    Rules are learned from at most ``max_labels`` rows of ``labels`` (doc_id, quality 0/1) with the smallest id
    hashes; only their numbers reach the driver. Null texts count as empty (base_failed); rows with null ids or
    labels teach nothing; repeated rows each get a row; extra columns are ignored; without labels nothing but
    the fixed rule drops; an empty table gives an empty result.
    """
    stats = stored(document_counts(docs), "counts")
    some = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = smallest_hashes(some, "doc_id", max_labels)  # a size-bounded side
    f = features()
    names = list(f)
    rows = stats.join(F.broadcast(some), "doc_id").filter(~base_failed()).select("doc_id", "quality", *[f[k].alias(f"f_{k}") for k in names]).orderBy("doc_id").limit(max_labels).toPandas()
    rules = learn(rows[[f"f_{k}" for k in names]].to_numpy(float), (rows["quality"] == 0).to_numpy(), names)
    out = stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out, rules


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
