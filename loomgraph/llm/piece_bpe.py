"""SentencePiece BPE by vectorised merge rounds: flat symbol arrays, the minimum pair rank of each word by segmented
reduction, all leftmost merges of that rank in every word at once, compaction of finished words, until no pair remains."""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, give_back

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
#: Segments of more symbols than this find the places of a rank in a table by rank: looking through all of them each round would cost the square of their length.
LONG = 1024
#: Texts are encoded in pieces of about this many bytes: the arrays over a piece take some twenty times as much in each worker.
CHUNK = 2 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: normal pieces with scores, ids of the 256 bytes, number of ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[int, ...]  #: ids of normal pieces
    byte_ids: tuple[int, ...]
    silent: tuple[int, ...]  #: control ids, which decode to nothing

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a BPE model with byte fallback, identity normalisation and a dummy prefix; others are refused."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        bytes_, control = [i for i in ids if m.is_byte(i)], [i for i in ids if m.is_control(i)]
        if len(bytes_) != 256 or any(m.is_unused(i) for i in ids):
            raise ValueError("a model with byte fallback and without unused pieces is needed")
        if m.decode(m.encode(" a  éﬁ ")) != " a  éﬁ " or m.id_to_piece(m.encode("a"))[0][0] != SPACE:
            raise ValueError("a model without normalisation and with a dummy prefix is needed")
        normal = tuple(i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)))
        pieces = tuple(m.id_to_piece(i) for i in ids)
        if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces that hold a space after other characters are not supported")
        by_value = sorted(bytes_, key=lambda i: int(pieces[i][3:5], 16))
        return Vocabulary(pieces, tuple(m.get_score(i) for i in ids), normal, tuple(by_value), tuple(control))


class Encoder:
    """Tables and kernels for one vocabulary. Symbols 0..n-1 are strings: the normal pieces, then single characters in them."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.id_of = {v.pieces[i]: i for i in v.normal}
        self.symbols = list(self.id_of)
        self.symbols += sorted({c for p in self.id_of for c in p} - self.id_of.keys())
        self.number = {s: k for k, s in enumerate(self.symbols)}
        n = len(self.symbols)
        # from here on numbers of at least n stand for characters that no piece holds
        self.size = n
        rank_of = {s: r for r, s in enumerate(sorted(set(-v.scores[i] for i in v.normal)))}
        keys, ranks, results = [], [], []
        joins = set()
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                joins.add((ord(p[k - 1]) << 21) | ord(p[k]))
                a, b = self.number.get(p[:k]), self.number.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank_of[-v.scores[i]])
                    results.append(self.number[p])
        # pairs of symbols in an open-addressing table, so that looking up a whole array takes one or two gathers
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.results = np.zeros(1 << self.bits, np.int64)
        for key, at, r, t in zip(keys, self._slot(np.array(keys, np.int64)).tolist(), ranks, results):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at], self.results[at] = key, r, t
        self.joins = np.append(np.array(sorted(joins), np.int64), np.iinfo(np.int64).max)
        chars = sorted((ord(s), k) for s, k in self.number.items() if len(s) == 1)
        self.char_symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        self.char_symbol[[c for c, _ in chars]] = [k for _, k in chars]
        self.out_id = [self.id_of.get(s, -1) for s in self.symbols]
        self.as_bytes = [b""] * len(v.pieces)
        for i in v.normal:
            self.as_bytes[i] = v.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(v.byte_ids):
            self.as_bytes[i] = bytes([b])
        unknown = next((i for i, p in enumerate(v.pieces) if p == "<unk>"), None)
        if unknown is not None:
            self.as_bytes[unknown] = " ⁇ ".encode()
        self.spelled = pa.array(self.as_bytes, pa.large_binary())
        self.listed = pa.array([f"{i},".encode() for i in range(len(v.pieces))], pa.large_binary())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols."""
        key = np.where((a < self.size) & (b < self.size), a * self.size + b, -2)
        at = self._slot(key)
        found = self.keys[at]
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found[rest] = self.keys[at[rest]]
            rest = rest[(found[rest] != key[rest]) & (found[rest] >= 0)]
        hit = found == key
        return np.where(hit, self.ranks[at], NO_RANK), np.where(hit, self.results[at], 0)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and where each word's ids begin (and the last ends)."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        sym = self.char_symbol[code]
        start = (ends - lengths)[lengths > 0]
        if len(lengths) and lengths.max() > LONG:
            # no merge crosses two characters that no piece holds side by side: such places cut long words into segments
            cut = np.ones(len(code), bool)
            pair = (code[:-1] << 21) | code[1:]
            cut[1:] = self.joins[np.searchsorted(self.joins, pair)] != pair
            cut[start] = True
            start = np.flatnonzero(cut)
        final, where = self._rounds(sym, start)
        ids = np.array(self.out_id + [-1], np.int64)
        got = ids[np.minimum(final, self.size)]
        # a symbol belongs to the word in which its first character lies
        owner = np.repeat(np.arange(len(words)), lengths)[where]
        rest = np.flatnonzero(got < 0)  # characters that are no piece: their bytes
        if len(rest):
            spelled = [[self.v.byte_ids[b] for b in (chr(k - self.size) if k >= self.size else self.symbols[k]).encode()] for k in final[rest].tolist()]
            width = np.ones(len(got), np.int64)
            width[rest] = [len(x) for x in spelled]
            begin = np.cumsum(width) - width
            got, owner = np.repeat(got, width), np.repeat(owner, width)
            for at, x in zip(begin[rest].tolist(), spelled):
                got[at : at + len(x)] = x
        return got, np.append(0, np.cumsum(np.bincount(owner, minlength=len(words)))).astype(np.int64)

    def _rounds(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge segments to the end; final symbols in text order and the places of their first characters."""
        place = np.arange(len(sym))
        size = np.diff(np.append(start, len(sym)))
        done_sym, done_place = [], []

        def flush(mask: np.ndarray) -> None:
            done_sym.append(sym[mask])
            done_place.append(place[mask])

        long = size > LONG
        if long.any():
            for a, n in zip(start[long].tolist(), size[long].tolist()):
                s, p = self._by_rank(sym[a : a + n].copy(), a)
                done_sym.append(s)
                done_place.append(p)
            keep = ~np.repeat(long, size)
            sym, place, size = sym[keep], place[keep], size[~long]
        start = np.cumsum(size) - size
        rank = np.full(len(sym), NO_RANK, np.int32)
        to = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[start + size - 1] = NO_RANK
        while len(sym):
            least = np.minimum.reduceat(rank, start)
            live = least < NO_RANK
            if not live.all():  # compaction: finished words leave
                mask = np.repeat(live, size)
                flush(~mask)
                sym, place, rank, to, size, least = sym[mask], place[mask], rank[mask], to[mask], size[live], least[live]
                start = np.cumsum(size) - size
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            p = hit[_alternate(np.diff(hit) == 1)]
            word = np.searchsorted(start, p, side="right") - 1
            chosen = np.zeros(len(sym) + 2, bool)
            chosen[p] = True
            many = np.flatnonzero(np.bincount(word, minlength=len(start))[word] > 1)
            if len(many):  # several merges of a word are one round as long as none makes a pair that comes before the others
                q, w = p[many], word[many]
                left = np.where((q - 2 >= start[w]) & chosen[q - 2], to[q - 2], sym[q - 1])
                inner = q + 2 < (start + size)[w]
                early = self._early(to[q], left, q > start[w], sym[np.where(inner, q + 2, q)], inner, least[w])
                stop = np.full(len(start), len(p))
                np.minimum.at(stop, w[early], many[early])
                keep = np.arange(len(p)) <= stop[word]
                p, word = p[keep], word[keep]
            sym[p] = to[p]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, place, rank, to = sym[keep], place[keep], rank[keep], to[keep]
            p = p - np.arange(len(p))
            size = size - np.bincount(word, minlength=len(size))
            start = np.cumsum(size) - size
            rank[p] = NO_RANK
            q = p[p < (start + size)[word] - 1]
            rank[q], to[q] = self._pairs(sym[q], sym[q + 1])
            q = p[p > start[word]] - 1
            rank[q], to[q] = self._pairs(sym[q], sym[q + 1])
        s, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_place))
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def _early(self, made: np.ndarray, left: np.ndarray, has_left: np.ndarray, right: np.ndarray, has_right: np.ndarray, rank: np.ndarray | int) -> np.ndarray:
        """Which merges make a pair, with the symbol before or behind, that must not wait for the other pairs of ``rank``."""
        before, behind = self._pairs(left, made)[0], self._pairs(made, right)[0]
        return (has_left & (before <= rank)) | (has_right & (behind <= rank))

    def _by_rank(self, sym: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """The same rounds over one long segment: symbols are linked, and places wait in a table by the rank of their pair."""
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # place n is the end
        rank, to = np.full(n, NO_RANK, np.int32), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[after[places] < n] if len(places) else places
            rank[places], to[places] = self._pairs(sym[places], sym[after[places]])
            places = places[rank[places] < NO_RANK]
            places = places[np.argsort(rank[places], kind="stable")]
            for some in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else []:
                r = int(rank[some[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(some)

        wait(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[rank[hit] == r]
            if not len(hit):
                continue
            p = hit[_alternate(after[hit[:-1]] == hit[1:])]
            second, made = after[p], to[p]
            left, right = before[p], after[second]
            follows = np.append(False, left[1:] == second[:-1])  # the symbol before is made in this round too
            early = self._early(made, np.where(follows, np.append(0, made[:-1]), sym[left]), left >= 0, sym[np.minimum(right, n - 1)], right < n, r)
            if early.any():
                k = int(np.argmax(early)) + 1
                heapq.heappush(heap, r)
                waiting[r] = [hit[hit > p[k - 1]]]
                p, second, made = p[:k], second[:k], made[:k]
            sym[p] = made
            rank[second] = rank[p] = NO_RANK
            sym[second] = -1
            after[p] = after[second]
            before[after[p]] = p
            wait(np.unique(np.concatenate([p, before[p][before[p] >= 0]])))
        alive = np.flatnonzero(sym >= 0)
        return sym[alive], alive + offset

    # ----------------------------------------------------------------- texts

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words of each text with their leading spaces as (first word of each text, codes, distinct words)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, SPACE), pc.equal(texts, "")))
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        plain = pc.list_flatten(lists)
        count = np.zeros(len(texts), np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        count[~is_odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = plain.dictionary_encode()
        words = [SPACE + w for w in coded.dictionary.to_pylist()]
        code = coded.indices.to_numpy().astype(np.int64)
        if is_odd.any():  # runs of spaces are one word with what follows; an empty text has no word
            cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
            found = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.filter(odd).to_pylist()]
            count[is_odd] = [len(x) for x in found]
            more = pa.array([w for x in found for w in x], pa.large_string()).dictionary_encode()
            both = np.empty(int(count.sum()), np.int64)
            of_odd = np.repeat(is_odd, count)
            both[~of_odd] = code
            both[of_odd] = more.indices.to_numpy().astype(np.int64) + len(words)
            words += more.dictionary.to_pylist()
            code = both
        return np.append(0, np.cumsum(count)), code, words

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of each text."""
        first, code, words = self.segments(texts)
        ids, stop = self.words(words)
        return self._lists(first, code, ids, stop)

    def _lists(self, first: np.ndarray, code: np.ndarray, ids: np.ndarray, stop: np.ndarray) -> pa.ListArray:
        lists = pa.LargeListArray.from_arrays(pa.array(stop), pa.array(ids.astype(np.int32))).take(pa.array(code))
        offsets = lists.offsets.to_numpy()[first].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), lists.values)

    def decode(self, ids: list[int]) -> str:
        """The text of token ids: bytes joined, the dummy prefix dropped, broken UTF-8 replaced byte by byte."""
        return self.text(b"".join(map(self.as_bytes.__getitem__, ids)), ids)

    def text(self, raw: bytes, ids: list[int]) -> str:
        lead = next((i for i in ids if i not in self.v.silent), None)
        if lead is not None and self.v.pieces[lead].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))

    def _joined(self, table: pa.Array, first: np.ndarray, code: np.ndarray, ids: np.ndarray, stop: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """What the ids of all texts stand for in ``table``, in one buffer, and where each text begins."""
        flat = table.take(pa.array(ids))
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop) - 1, [None, pa.py_buffer(_offsets(flat)[stop].tobytes()), flat.buffers()[2]]).take(pa.array(code))
        return memoryview(spelled.buffers()[2] or b""), _offsets(spelled)[first]

    def _texts(self, first: np.ndarray, code: np.ndarray, ids: np.ndarray, stop: np.ndarray) -> list[str]:
        raw, at = self._joined(self.spelled, first, code, ids, stop)
        lead = [[int(ids[stop[code[a]]])] if b > a else [] for a, b in zip(first[:-1], first[1:])]
        return [self.text(bytes(raw[at[k] : at[k + 1]]), x) for k, x in enumerate(lead)]

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids in decimal joined by commas, sha256 of the decoded text) of each text."""
        first, code, words = self.segments(texts)
        ids, stop = self.words(words)
        count = np.diff(np.append(0, np.cumsum(np.diff(stop)[code]))[first]).tolist()
        listed, at = self._joined(self.listed, first, code, ids, stop)
        return [
            (n, hashlib.sha256(listed[at[k] : max(at[k], at[k + 1] - 1)]).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            for k, (n, text) in enumerate(zip(count, self._texts(first, code, ids, stop)))
        ]

    def round_trip(self, texts: pa.Array) -> tuple[pa.ListArray, list[str]]:
        """Token ids of each text and what they decode to."""
        first, code, words = self.segments(texts)
        ids, stop = self.words(words)
        return self._lists(first, code, ids, stop), self._texts(first, code, ids, stop)


def _alternate(touches: np.ndarray) -> np.ndarray:
    """Places of a sorted list of which no two neighbours touch, taken from the left; ``touches`` says of each but the first whether it touches the one before."""
    at = np.arange(len(touches) + 1)
    first = np.maximum.accumulate(np.where(np.append(True, ~touches), at, 0))
    return np.flatnonzero((at - first) % 2 == 0)


def _offsets(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]


@lru_cache(maxsize=2)
def encoder(v: Vocabulary) -> Encoder:
    """One encoder a worker process and vocabulary."""
    out = Encoder(v)
    give_back()
    return out


def encode_documents(docs: DataFrame, model: str, text: str = "text", column: str = "tokens") -> DataFrame:
    """Add ``column``: the token ids of the whole text. Null and empty texts give an empty array.

    The vocabulary (tens of thousands of pieces, a fixed size) travels with the function; a task holds one batch
    piece of texts and its distinct words. Other columns, repeated rows and row order pass through; an input
    column of the same name is replaced.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    v = Vocabulary.load(model)
    kept = [c for c in docs.columns if c != column]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(column, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in chunks(batch, at, CHUNK):
                tokens = encoder(v).encode(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, tokens], names=[*part.schema.names, column])

    return docs.select(*[F.col(c) for c in kept]).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str, column: str = "tokens", text: str = "decoded") -> DataFrame:
    """Add ``text``: the decoding of the ids in ``column``; a null array decodes to the empty string."""
    from pyspark.sql import types as T

    v = Vocabulary.load(model)
    if text in encoded.columns:
        encoded = encoded.drop(text)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encoder(v).decode(x or []) for x in lists], pa.string())], names=[*batch.schema.names, text])

    return encoded.mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Encode and decode every whole text; per document ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. Null counts as empty."""
    v = Vocabulary.load(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                n, ids, decoded = zip(*encoder(v).digests(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Training rows: ``doc_id``, ``source``, ``n_tokens``, ``tokens``, ``decoded_sha256`` (of what the ids decode to). Null texts have no token."""
    v = Vocabulary.load(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2, CHUNK):
                lists, decoded = encoder(v).round_trip(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pc.list_value_length(lists).cast(pa.int64()), lists, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])],
                    names=["doc_id", "source", "n_tokens", "tokens", "decoded_sha256"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, tokens array<int>, decoded_sha256 string")
