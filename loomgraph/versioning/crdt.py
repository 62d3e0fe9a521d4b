"""Conflict-free joins of stamped records: last writer wins by hybrid logical clock, per property."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAMP = "struct<physical_ms:bigint,logical:bigint,actor:string>"
#: One row per record and field: fields are ``prop:<key>``, ``label:<name>``, ``alive``, ``dead``, ``from_id``, ``to_id``, ``type``, ``confidence``.
CELLS = f"kind string, id string, field string, value string, stamp {STAMP}"


@dataclass
class Clock:
    """A hybrid logical clock."""

    actor: str
    wall: object = field(default=lambda: int(time.time() * 1000))
    physical: int = 0
    logical: int = 0

    def now(self) -> tuple[int, int, str]:
        t = self.wall()
        if t > self.physical:
            self.physical, self.logical = t, 0
        else:
            self.logical += 1
        return self.physical, self.logical, self.actor

    def observe(self, stamp: tuple[int, int, str]) -> tuple[int, int, str]:
        """Move past a stamp that was received."""
        t, (p, l, _) = self.wall(), stamp
        top = max(t, self.physical, p)
        if top == self.physical == p:
            self.logical = max(self.logical, l) + 1
        elif top == self.physical:
            self.logical += 1
        elif top == p:
            self.logical = l + 1
        else:
            self.logical = 0
        self.physical = top
        return self.physical, self.logical, self.actor


def join_cells(*parts: DataFrame) -> DataFrame:
    """Join any number of replicas: for each (kind, id, field) the value with the largest stamp, ties to the larger value.

    The join is commutative, associative and idempotent, so order, repetition and lateness don't matter. Confidence is
    the exception to last-writer-wins: the higher value stands.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max_by(F.col("value"), F.struct(F.when(F.col("field") == "confidence", F.coalesce(F.col("value").try_cast("double"), F.lit(-1.0))).otherwise(0.0), "stamp", "value"))
    return out.groupBy("kind", "id", "field").agg(best.alias("value"), F.max("stamp").alias("stamp"))


def records(cells: DataFrame) -> DataFrame:
    """(kind, id, labels, properties, tombstone, from_id, to_id, type, confidence, stamp) of joined cells.

    Labels are a grow-only union. A record is dead only if its last death is strictly after its last sign of life.
    """
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    at = lambda f: F.max(F.when(F.col("field") == f, F.col("stamp")))
    entry = F.struct(F.substring("field", 6, 1000).alias("key"), "value")
    props = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").startswith("prop:"), entry))))
    out = cells.groupBy("kind", "id").agg(
        F.array_sort(F.collect_set(F.when(F.col("field").startswith("label:"), F.substring("field", 7, 1000)))).alias("labels"), props.alias("properties"), at("dead").alias("_dead"), at("alive").alias("_alive"),
        of("from_id").alias("from_id"), of("to_id").alias("to_id"), of("type").alias("type"), of("confidence").cast("double").alias("confidence"), F.max("stamp").alias("stamp"),
    )
    return out.withColumn("tombstone", F.col("_dead").isNotNull() & (F.col("_alive").isNull() | (F.col("_dead") > F.col("_alive")))).drop("_dead", "_alive")


def version_vector(cells: DataFrame) -> DataFrame:
    """(actor, high): the largest stamp of each actor."""
    return cells.groupBy(F.col("stamp.actor").alias("actor")).agg(F.max("stamp").alias("high"))


def diff_since(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """All cells of records that hold any stamp above the peer's high-water mark of its actor."""
    v = vector.select(F.col("actor").alias("_actor"), F.col("high").alias("_high"))
    new = cells.join(v, F.col("stamp.actor") == F.col("_actor"), "left").filter(F.col("_high").isNull() | (F.col("stamp") > F.col("_high"))).select("kind", "id").distinct()
    return cells.join(new, ["kind", "id"], "left_semi")


def join_report(state: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: cells of the delta that are applied, and those ignored as stale."""
    old = state.select("kind", "id", "field", F.col("stamp").alias("_old"))
    j = delta.join(old, ["kind", "id", "field"], "left")
    return j.agg(F.count_if(F.col("_old").isNull() | (F.col("stamp") > F.col("_old"))).alias("applied"), F.count_if(F.col("_old").isNotNull() & (F.col("stamp") <= F.col("_old"))).alias("ignored_stale"))
