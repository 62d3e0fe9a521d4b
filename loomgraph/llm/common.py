"""Shared pieces of the training-data operators: scratch tables, words, batches, distributed prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..iterate import remove, scratch

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to the numpy kernels in pieces of about this many bytes, so memory follows the longest text, not the batch.
CHUNK_BYTES = 4 << 20

def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver process ends."""
    path = f"{scratch(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by then; the folder is scratch
            pass

    atexit.register(drop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Drop scratch tables that no later plan reads."""
    for f in frames:
        remove(f.sparkSession, f._scratch)


def smallest_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose ``key`` has the smallest hash.

    On a large table a threshold twice as high as needed goes first, so that the top-k gets about 2 ``most`` rows in all,
    not ``most`` from every partition.
    """
    total, top = df.count(), 1 << 30
    h = F.pmod(F.xxhash64(key), F.lit(top))
    if total > 4 * most:
        df = df.filter(h < F.lit(int(top * (2 * most / total))))
    return df.orderBy(h, key).limit(most)


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what one stage freed would count with the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts (column number ``text``) hold about ``limit`` bytes; at least one row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)
    give_back()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text as (document number of each word, code of each word, distinct words)."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat = flat.filter(full)
    doc = doc[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    coded = flat.dictionary_encode()
    return doc, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w.as_buffer()) for w in words), np.uint64, len(words)) if len(words) else np.zeros(0, np.uint64)


def prefix_sums(df: DataFrame, order: list[str], value: str, group: list[str] = []) -> DataFrame:
    """Add ``before`` (sum of ``value`` over earlier rows) and ``row`` (number of earlier rows), per ``group``, in ``group, order``.

    A range shuffle deals the rows evenly whatever the group sizes, each partition sums itself, and the sums
    before each partition come from one total a partition and group. ``order`` must be total up to equal rows;
    those may lie in several ranges, by the input partition that they come from. Null groups form one group; an
    empty table stays empty.
    """
    keyed = df.withColumn("_from", F.spark_partition_id())
    keyed = keyed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*group, *order, "_from"]]).drop("_from").withColumn("_part", F.spark_partition_id())
    keyed = stored(keyed, "ranges")  # the ranges are sampled: totals and running sums must see the same ones
    inside = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn("_nth", F.count(F.lit(1)).over(inside))
    earlier = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    totals = (
        keyed.groupBy("_part", *group).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        .select(F.col("_part").alias("_p"), *names, "_sum", "_n").select("_p", *[f"_g{i}" for i in range(len(group))], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_noff"))
    )
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(totals, same)
    out = out.select(*df.columns, (F.col("_off") + F.col("_run")).cast("long").alias("before"), (F.col("_noff") + F.col("_nth")).cast("long").alias("row"))
    out._stored = keyed.drop("_part")  # the rows as written, for cheap totals
    return out
