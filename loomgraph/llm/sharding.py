"""Contiguous shards of near-equal byte size, cut from one global prefix sum of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus one separator byte; a null text has none of its own."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def byte_shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row to one of ``n_shards`` contiguous shards of near-equal size under the law ``bytes``.

    Rows are put in the order (id, text hash); sizes are summed inside each range partition, partition totals
    give each partition its global offset, and a row goes to the shard in whose equal slice of the grand total
    its middle byte falls. A shard thus misses its target by at most one row's size at either end. Only
    (id, size, hashes) are shuffled, never texts, and rows with equal texts are single rows like any other, so
    a hot group cannot unbalance anything.

    Returns one row per input row: the id, ``size``, ``text_crc32`` (of the UTF-8 bytes; 0 for null or empty),
    ``law``, ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` (null under this law).
    Null ids sort first; null and empty texts have size 1; repeated rows are placed next to each other, each
    with its own slot; extra columns are ignored; an empty table gives an empty result.
    """
    body = F.col(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), byte_size(body).alias("size"), F.crc32(F.encode(F.coalesce(body, F.lit("")), "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("_tie")
    )
    placed = prefix_sums(rows, ["doc_id", "_tie", "size"], "size")
    total = placed._stored.agg(F.sum("size")).first()[0] or 1
    # a row lies in shard k if twice its middle is at least twice the k-th cut, in whole numbers
    cuts = [-(-2 * total * k // n_shards) for k in range(1, n_shards)]
    shard = sum(((F.col("before") * 2 + F.col("size")) >= c).cast("int") for c in cuts) if cuts else F.lit(0)
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    return (
        placed.join(F.broadcast(first), "shard")  # one row a shard
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, text: str = "text") -> None:
    """Write the documents as one folder a shard, each in slot order inside its files.

    Rows are matched by id, size and text hash; copies of one row are interchangeable and fill its slots once each.
    """
    copy = Window.partitionBy("doc_id", "size", "text_crc32")
    left = docs.withColumn("size", byte_size(F.col(text))).withColumn("text_crc32", F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    left = left.withColumn("_copy", F.row_number().over(copy.orderBy(F.xxhash64(text))))
    right = assignment.withColumn("_copy", F.row_number().over(copy.orderBy("shard", "slot")))
    same = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["size"] == right["size"]) & (left["text_crc32"] == right["text_crc32"]) & (left["_copy"] == right["_copy"])
    out = left.join(right.select("doc_id", "size", "text_crc32", "_copy", "shard", "slot"), same).select(*[left[c] for c in docs.columns if c not in ("shard", "slot")], right["shard"], right["slot"])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
