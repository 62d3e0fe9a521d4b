"""Fixpoint loops over DataFrames: lineage is cut every round through the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: str | None = None


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``; where that is unset, a local one in local mode, else an error."""
    global _local
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _local


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame, *, drop: DataFrame | None = None, parts: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Write a round's table to the shared folder, in folders by the columns ``by``, and read it back; ``drop`` is an earlier one that nothing reads any more."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/round-{uuid.uuid4().hex}"
    write = (df.coalesce(parts) if parts else df).write
    (write.partitionBy(*by) if by else write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if drop is not None and hasattr(drop, "_settled"):
        remove(spark, drop._settled)

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; the folder is scratch
            pass

    atexit.register(clean)
    return out


def numbered(df: DataFrame, *order: Column | str, name: str = "_n") -> DataFrame:
    """Add ``name``: 1, 2, ... in the given order, by a range shuffle and one count a range; rows equal in it come in any order.

    The driver holds a number a range. The ranges are sampled, so they are written once before they are counted.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = settle(df.withColumn("_from", F.spark_partition_id()).repartitionByRange(*cols, "_from").drop("_from").withColumn("_range", F.spark_partition_id()))
    sizes = dict(ranges.groupBy("_range").count().collect())
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_range")]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    return ranges.withColumn(name, (offset + inside).cast("long")).drop("_range")


def distinct_by(df: DataFrame, keys: list[str], *order: object) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Rows that one task's heap may hold for a top-k.
HEAP_ROWS = 100_000


def first_rows(df: DataFrame, n: int | None, skip: int = 0) -> DataFrame:
    """The first ``n`` rows of an ordered table after ``skip``; None means all. Beyond ``HEAP_ROWS`` the sorted rows are numbered by ranges instead of meeting in one heap."""
    if n is not None and n + skip > HEAP_ROWS:
        placed = numbered(df.withColumn("_at", F.monotonically_increasing_id()), "_at")
        return placed.filter((F.col("_n") > skip) & (F.col("_n") <= skip + n)).orderBy("_n").drop("_at", "_n")
    if skip:
        df = df.offset(skip)
    return df if n is None else df.limit(n)
