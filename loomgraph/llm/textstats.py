"""Per-document counts that quality rules and labellers share, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, split_words

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: A word that isn't empty, for lines.
_HAS_WORD = r"[^\x20\x09-\x0D]"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_as_before", "n_distinct", "n_bare", "n_ended", "n_short")
#: Hashed word shapes fall into so many buckets.
BUCKETS = 1 << 12


def _sum(doc: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, weights=value, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def _ids(key: np.ndarray) -> np.ndarray:
    return pd.factorize(key)[0].astype(np.int64)


def repeated_words(doc: np.ndarray, code: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Words that lie in a window of ``window`` (a power of two) words found at least twice in their document.

    Windows get exact numbers by doubling: a window of 2k words is the pair of the numbers of its halves.
    """
    number, reach = code, 1
    while reach < window:
        a, b = number[:-reach] if reach < len(number) else number[:0], number[reach:]
        number = _ids(a * (int(number.max(initial=0)) + 1) + b)
        reach *= 2
    if not len(number):
        return np.zeros(n_docs, np.int64)
    inside = doc[: len(number)] == doc[window - 1 :]
    start = np.flatnonzero(inside)
    key = _ids(doc[start] * (int(number.max()) + 1) + number[start])
    again = start[np.bincount(key)[key] > 1] if len(key) else start
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return _sum(doc, (np.cumsum(cover[:-1]) > 0).astype(np.int64), n_docs)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text; null counts as empty. Also the words as ``doc``, ``code``, ``words``.

    ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``; ``n_lines``: lines with a word;
    ``n_dup_lines``: those equal to an earlier line; ``n_repeat_words``: see :func:`repeated_words`; ``n_same_as_before``:
    words equal to the word before; ``n_bare``: words without letter or digit; ``n_ended``: words that end a
    sentence; ``n_short``: words of at most three characters.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    doc, code, words = split_words(texts)
    out: dict = {"doc": doc, "code": code, "words": words, "n_words": _sum(doc, None, n)}
    of = lambda a: a.to_numpy(zero_copy_only=False)[code] if len(words) else np.zeros(0, np.int64)
    length = of(pc.utf8_length(words))
    out["word_chars"] = _sum(doc, length, n)
    out["n_short"] = _sum(doc, length <= 3, n)
    out["n_bare"] = _sum(doc, of(pc.invert(pc.match_substring_regex(words, r"[\p{L}\p{N}]"))), n)
    out["n_ended"] = _sum(doc, of(pc.match_substring_regex(words, r"[.!?]$")), n)
    data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    symbols = np.append(0, np.cumsum(_SYMBOL[data[offsets[0] : offsets[-1]]]))
    out["n_symbols"] = np.diff(symbols[offsets - offsets[0]]).astype(np.int64)
    lists = pc.split_pattern(texts, "\n")
    line_doc, lines = pc.list_parent_indices(lists).to_numpy().astype(np.int64), pc.list_flatten(lists).dictionary_encode()
    full = pc.match_substring_regex(lines.dictionary, _HAS_WORD).to_numpy(zero_copy_only=False)
    line = lines.indices.to_numpy().astype(np.int64)
    line_doc, line = line_doc[full[line]], line[full[line]]
    first = ~pd.Series(line_doc * (len(full) + 1) + line).duplicated().to_numpy()
    out["n_lines"] = _sum(line_doc, None, n)
    out["n_dup_lines"] = out["n_lines"] - _sum(line_doc[first], None, n)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    out["n_same_as_before"] = _sum(doc, same, n)
    new = ~pd.Series(doc * (len(words) + 1) + code).duplicated().to_numpy()
    out["n_distinct"] = _sum(doc[new], None, n)
    out["n_repeat_words"] = repeated_words(doc, code, n)
    out["same"] = same
    return out


def shapes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The shape of each word: runs of capitals, of other letters and of digits become X, x and 9, runs of one other character that character."""
    s = words.cast(pa.large_string())
    for pattern, by in ((r"\p{Lu}+", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "x"), (r"\p{N}+", "9")):
        s = pc.replace_substring_regex(s, pattern, by)
    s = pc.replace_substring_regex(s, r"([#*$%&|<>.,;:!?_=/+-])[#*$%&|<>.,;:!?_=/+-]+", r"\1")
    s = pc.utf8_slice_codeunits(s, 0, 12).dictionary_encode()
    return s.indices.to_numpy().astype(np.int64), s.dictionary.to_pylist()


def shape_features(c: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed features of each text as (document, bucket, share of its words), sorted: word shapes, and words equal to the one before."""
    import xxhash

    code, names = shapes(c["words"])
    bucket = np.fromiter((xxhash.xxh64_intdigest(s) % (BUCKETS - 1) + 1 for s in names), np.int64, len(names))
    f = bucket[code][c["code"]] if len(c["code"]) else np.zeros(0, np.int64)
    doc = np.concatenate([c["doc"], c["doc"][c["same"]]])
    f = np.concatenate([f, np.zeros(int(c["same"].sum()), np.int64)])
    key, count = np.unique(doc * BUCKETS + f, return_counts=True)
    doc, f = key // BUCKETS, key % BUCKETS
    return doc, f, count / np.maximum(c["n_words"], 1)[doc]


__all__ = ["BUCKETS", "COUNTS", "counts", "mix64", "repeated_words", "shape_features", "shapes"]
