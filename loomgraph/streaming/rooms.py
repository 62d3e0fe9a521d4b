"""Streams: conflict-free joins of mutation streams, latest-wins projections and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..iterate import settle
from ..versioning.crdt import join_cells


class DeltaRoom:
    """Joins every micro-batch of cells into a state table. The join is idempotent, so a batch that is run again after a
    failure changes nothing, and order and lateness don't matter."""

    def __init__(self, state: DataFrame) -> None:
        self.state = state
        self.applied = 0
        self.ignored_stale = 0
        self._last = -1

    def join(self, delta: DataFrame, batch: int = 0) -> None:
        from ..versioning.crdt import join_report

        delta = settle(join_cells(delta))
        if batch > self._last:
            r = join_report(self.state, delta).first()
            self.applied, self.ignored_stale, self._last = self.applied + r[0], self.ignored_stale + r[1], batch
        self.state = settle(join_cells(self.state, delta), drop=self.state if hasattr(self.state, "_settled") else None)

    def pull(self, seen: DataFrame) -> DataFrame:
        """The reply to a PULL: all cells of the room newer than the version vector ``seen`` (actor, physical_ms, logical); joining it brings a member up to date."""
        from ..versioning.crdt import diff_since

        return diff_since(self.state, seen)

    def attach(self, stream: DataFrame, checkpoint: str):
        """Start a query that feeds the room."""
        return stream.writeStream.foreachBatch(lambda df, n: self.join(df, n)).option("checkpointLocation", checkpoint).outputMode("append").start()


def live_records(cells: DataFrame) -> DataFrame:
    """The joined cells of a stream as a running aggregation (complete or update mode): (kind, id, field, value, stamp)."""
    best = F.max_by(F.col("value"), F.struct(F.when(F.col("field") == "confidence", F.coalesce(F.col("value").try_cast("double"), F.lit(-1.0))).otherwise(0.0), "stamp", "value"))
    return cells.groupBy("kind", "id", "field").agg(best.alias("value"), F.max("stamp").alias("stamp"))


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, by: list[str], ts: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Count, sum and extremes by window; on a stream with a watermark, on a table without."""
    return _windowed(_timed(events, ts, late), F.window(ts, size), by, value)


def sliding(events: DataFrame, size: str, slide: str, by: list[str], ts: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    return _windowed(_timed(events, ts, late), F.window(ts, size, slide), by, value)


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Runs of events with gaps shorter than ``gap``."""
    return _windowed(_timed(events, ts, late), F.session_window(ts, gap), by, value)


def _windowed(events: DataFrame, window, by: list[str], value: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "low", "high")


def project(stream: DataFrame, apply: Callable[[DataFrame], None], key: str, generation: str, checkpoint: str, every: str = "400 milliseconds"):
    """Debounced projection: once a trigger, the latest generation of each key is applied."""

    def batch(df: DataFrame, n: int) -> None:
        latest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), generation).alias("x")).select("x.*")
        apply(latest)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
