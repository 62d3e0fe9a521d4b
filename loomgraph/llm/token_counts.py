"""Token counts from flat token files by a separator scan.

A flat token file is nothing but little-endian token ids, each document ended by one end-of-document id: no index, no
lengths. Counting reads such files in blocks, finds the ids in each block by one vectorised search, and stitches
documents that cross blocks with a prefix scan over block summaries.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, scratch_path

#: Bytes of a block of the scan.
BLOCK_BYTES = 2 << 20


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: Token bytes after which a task goes on to its next file, so that none comes near Spark's 2 GB for a binary value.
PIECE_BYTES = 256 << 20


def write_flat_tokens(docs: DataFrame, path: str, ranks_file: str, pattern: str, eod: int, doc_id: str = "doc_id", text: str = "text", piece_bytes: int = PIECE_BYTES) -> None:
    """Tokenise every whole text with a byte-level BPE rank file into flat 16-bit token files under ``path``/kind=tokens.

    Files are written by Spark's own text sink, whose line separator is the end-of-document id, so any store that
    Spark can write to will do. A task starts another file, in the folder piece=1, 2, ..., after ``piece_bytes`` of
    tokens. Beside each file, ``kind=ids`` holds one of the same name and piece with the document ids in the same
    order. Null and empty texts are documents without tokens. The rank file (a fixed vocabulary) travels with the
    function. ``eod`` must be free: above every rank and below 65536.
    """
    with open(ranks_file, "rb") as f:
        ranks = f.read()
    if eod < ranks.count(b"\n") or eod > 0xFFFF:
        raise ValueError("the end-of-document id must be no token and fit 16 bits")

    def run(batches):
        written, piece = 0, 0
        enc = _encoding(ranks, pattern)
        for batch in batches:
            for part in chunks(batch, 1):
                ids = [b"" if i is None else b"%d" % i for i in part.column(0).to_pylist()]
                tokens, pieces = [], []
                for t in part.column(1).to_pylist():
                    tokens.append(np.array(enc.encode_ordinary(t), "<u2").tobytes() if t else b"")
                    pieces.append(piece)
                    written += len(tokens[-1]) + 2
                    if written >= piece_bytes:
                        written, piece = 0, piece + 1
                for kind, rows in (("tokens", tokens), ("ids", ids)):
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([kind] * len(rows)), pa.array(pieces, pa.int32())], names=["row", "kind", "piece"])

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "row binary, kind string, piece int")
    end = eod.to_bytes(2, "little").decode("latin-1")
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "100000")  # all files of a task are written as rows come, without a sort that could change their order
    try:
        sink = rows.select(F.col("row").cast("string").alias("value"), "kind", "piece").write.partitionBy("kind", "piece").option("encoding", "ISO-8859-1").option("lineSep", end)
        sink.option("maxRecordsPerFile", 0).text(path)  # files of both kinds must end at the same documents
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The flat files below ``path`` by their place there, without kind."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"((?:piece=\d+/)?[^/]+)$", 1).alias("file"), "content")


def _scan(eod: int, dtype: str):
    """Per block: number, tokens, where the end-of-document ids are."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                data = np.frombuffer(one.column(2)[0].as_buffer(), dtype)
                at = np.flatnonzero(data == eod).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1), pa.array([len(data)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at))], names=["file", "block", "n", "at"]
                )

    return run


def count_flat_tokens(spark: SparkSession, path: str, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens of every document in the flat files under ``path``: rows (file, nth, n_tokens), nth from 0 in file order.

    The end-of-document id itself isn't counted; tokens after a file's last one are an unfinished document and
    come as its last row; an empty file has no document. A block's summary is its number of tokens, of ends, and
    what follows the last end; one running sum over a file's summaries gives each block the number of documents
    before it and the tokens carried into it. A file is one binary value of at most 2 GB, Spark's limit; larger flat
    files must be cut between documents first, as :func:`write_flat_tokens` does.
    """
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    files = _files(spark, path)
    blocks = files.select("file", "content", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / block_bytes).cast("int"))).alias("block"))
    blocks = blocks.select("file", "block", F.expr(f"substring(content, block * {block_bytes} + 1, {block_bytes})").alias("content"))
    scanned = blocks.mapInArrow(_scan(eod, dtype), "file string, block int, n long, at array<int>")
    ends = F.size("at")
    tail = F.when(ends > 0, F.col("n") - 1 - F.element_at("at", -1)).otherwise(F.col("n"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = scanned.withColumn("_run", F.sum(tail).over(earlier)).withColumn("_docs", F.coalesce(F.sum(ends).over(earlier), F.lit(0)))
    # tokens carried in: the tails since the last block with an end, that block's included
    since = F.last(F.when(ends > 0, F.coalesce("_run", F.lit(0))), ignorenulls=True).over(earlier)
    scanned = scanned.withColumn("_carry", F.coalesce("_run", F.lit(0)) - F.coalesce(since, F.lit(0))).withColumn("_last", F.lead("block").over(order).isNull())
    # the first document of a block has what was carried in; the rest lie between two ends
    counts = F.transform("at", lambda e, i: (e - F.when(i > 0, F.element_at("at", F.when(i > 0, i).otherwise(1))).otherwise(-1) - 1 + F.when(i == 0, F.col("_carry")).otherwise(0)).cast("long"))
    rest = F.when(ends > 0, F.lit(0).cast("long")).otherwise(F.col("_carry")) + tail
    counts = F.concat(counts, F.when(F.col("_last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>")))
    return scanned.select("file", "_docs", F.posexplode(counts).alias("i", "n_tokens")).select("file", (F.col("_docs") + F.col("i")).cast("long").alias("nth"), "n_tokens")


def read_ids(spark: SparkSession, path: str, eod: int) -> DataFrame:
    """Document ids by place: rows (file, nth, doc_id) of the files that :func:`write_flat_tokens` put beside the tokens."""
    end = eod.to_bytes(2, "little")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = content.as_py().split(end)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids)), pa.array(np.arange(len(ids))), pa.array([int(x) if x else None for x in ids], pa.int64())], names=["file", "nth", "doc_id"]
                )

    return _files(spark, path).mapInArrow(run, "file string, nth long, doc_id long")


def token_counts(docs: DataFrame, ranks_file: str, pattern: str, eod: int) -> DataFrame:
    """Tokens of every document, counted from flat token files in the shared scratch folder: rows (doc_id, n_tokens).

    Null and empty texts count 0; each repeated row has a row of its own; null ids stay null; extra columns are
    ignored; an empty table gives an empty result. Nothing but (file, place) meets across tasks: a file's place
    is the join key, so no key is hot.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "flat")
    write_flat_tokens(docs, path, ranks_file, pattern, eod)
    counts = count_flat_tokens(spark, f"{path}/kind=tokens", eod) if _any(spark, f"{path}/kind=tokens") else None
    if counts is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_tokens")).limit(0)
    # a task's file has the same name for both kinds
    return read_ids(spark, f"{path}/kind=ids", eod).join(counts, ["file", "nth"]).select("doc_id", "n_tokens")


def _any(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
