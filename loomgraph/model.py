"""The data model: nodes and typed, confidence-weighted edges as two DataFrames with a fixed envelope.

``properties`` is JSON text; ``prop_tokens`` maps each scalar property to a type-tagged token (``int:1``, ``float:1.0``,
``str:x``, ``bool:true``, ``null``), on which filters, groups and joins work, so 1 and 1.0 differ and an explicit null
differs from a missing key. Tombstoned records stay in the tables and are hidden by the ``live_*`` views.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISTEMIC_TYPES = ("supports", "contradicts", "tension", "derives", "cites")

PROVENANCE = T.StructType([T.StructField(c, T.StringType()) for c in ("source_id", "timestamp", "method")])
NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("properties", T.StringType()),
        T.StructField("prop_tokens", T.MapType(T.StringType(), T.StringType())),
        T.StructField("version", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("parent_hashes", T.ArrayType(T.StringType())),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("from_id", T.StringType()),
        T.StructField("to_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("prop_tokens", T.MapType(T.StringType(), T.StringType())),
        T.StructField("version", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("epistemic_type", T.StringType()),
        T.StructField("provenance", PROVENANCE),
        T.StructField("content_hash", T.StringType()),
        T.StructField("parent_hashes", T.ArrayType(T.StringType())),
    ]
)


class GraphError(ValueError):
    """An error with a stable code."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


# --------------------------------------------------------------------------- column expressions


def tokens(properties: Column | str) -> Column:
    """Type-tagged tokens of the scalar properties of JSON text; arrays and objects have none."""
    p = F.col(properties) if isinstance(properties, str) else properties
    raw = F.from_json(p, "map<string,string>")
    kinds = F.transform_values(F.from_json(p, "map<string,variant>"), lambda k, v: F.call_function("schema_of_variant", v))

    def tag(k: Column, kind: Column) -> Column:
        text = raw[k]
        return (
            F.when(kind == "BIGINT", F.concat(F.lit("int:"), text))
            .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.concat(F.lit("float:"), text.cast("double").cast("string")))
            .when(kind == "STRING", F.concat(F.lit("str:"), text))
            .when(kind == "BOOLEAN", F.concat(F.lit("bool:"), text))
            .when(kind == "VOID", F.lit("null"))
        )

    return F.coalesce(F.map_filter(F.transform_values(kinds, tag), lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def token_of(value: object) -> str | None:
    """The token of a Python scalar; None for lists and objects, which never match."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"bool:{str(value).lower()}"
    if isinstance(value, int):
        return f"int:{value}"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise GraphError("non_finite_number")
        return f"float:{_double_text(value)}"
    if isinstance(value, str):
        return f"str:{value}"
    return None


def _double_text(v: float) -> str:
    """A double as Spark prints it."""
    a = abs(v)
    if v == 0 or 1e-3 <= a < 1e7:
        return repr(float(v))
    mantissa, _, power = repr(v).partition("e")
    if not power:
        sign = "-" if v < 0 else ""
        plain = mantissa.lstrip("-").rstrip("0").rstrip(".")
        whole, _, frac = plain.partition(".")
        if whole != "0":
            power, body = len(whole) - 1, whole + frac
        else:
            lead = len(frac) - len(frac.lstrip("0"))
            power, body = -lead - 1, frac.lstrip("0")
        body = body.rstrip("0") or "0"
        return f"{sign}{body[0]}.{body[1:] or '0'}E{power}"
    if "." not in mantissa:
        mantissa += ".0"
    return f"{mantissa}E{int(power)}"


def token_text(token: Column) -> Column:
    """The plain text of a token; null for null and missing."""
    return F.when(token == "null", F.lit(None).cast("string")).otherwise(F.regexp_replace(token, "^(?:int|float|str|bool):", ""))


def token_number(token: Column) -> Column:
    """The numeric value of int and float tokens, else null."""
    return F.when(token.startswith("int:") | token.startswith("float:"), F.regexp_extract(token, ":(.*)$", 1).try_cast("double"))


def prop(key: str, alias: str = "prop_tokens") -> Column:
    """Token of a property of the current row; null if missing."""
    return F.col(alias)[F.lit(key)]


def label_set(labels: Column | str) -> Column:
    """Trimmed, without empties, sorted, distinct."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))


def effective_confidence(confidence: Column | str = "confidence") -> Column:
    return F.coalesce(F.col(confidence) if isinstance(confidence, str) else confidence, F.lit(1.0))


def _identity(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def node_hash() -> Column:
    """Content address of a node: kind, id, labels, properties, tombstone."""
    return _identity(F.lit("node").alias("kind"), F.col("id"), F.col("labels"), F.col("properties"), F.col("tombstone"))


def edge_hash() -> Column:
    """Content address of an edge: every identity field."""
    return _identity(*[F.lit("edge").alias("kind"), *[F.col(c) for c in ("id", "from_id", "to_id", "type", "properties", "tombstone", "confidence", "epistemic_type", "provenance")]])


def epistemic(value: Column) -> Column:
    """A known epistemic type in lower case; unknown ones raise."""
    v = F.lower(F.trim(value))
    bad = F.raise_error(F.concat(F.lit("unknown_epistemic_type: "), v)).cast("string")
    return F.when(v.isNull() | v.isin(*EPISTEMIC_TYPES), v).otherwise(bad)


def _fill(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])


def as_nodes(df: DataFrame) -> DataFrame:
    """Bring rows with at least ``id`` into the node envelope; labels are normalised, tokens and hash derived where missing."""
    have = set(df.columns)
    df = df.withColumn("properties", F.coalesce(F.col("properties").cast("string"), F.lit("{}")) if "properties" in have else F.lit("{}"))
    df = df.withColumn("labels", label_set("labels") if "labels" in have else F.array().cast("array<string>"))
    df = df.withColumn("tombstone", F.coalesce("tombstone", F.lit(False)) if "tombstone" in have else F.lit(False))
    if "prop_tokens" not in have:
        df = df.withColumn("prop_tokens", tokens("properties"))
    if "content_hash" not in have:
        df = df.withColumn("content_hash", node_hash())
    return _fill(df, NODE_SCHEMA, {"version": F.lit(0), "parent_hashes": F.array().cast("array<string>")})


def as_edges(df: DataFrame) -> DataFrame:
    """Bring rows with at least ``id, from_id, to_id, type`` into the edge envelope; all optional fields are accepted."""
    have = set(df.columns)
    df = df.withColumn("properties", F.coalesce(F.col("properties").cast("string"), F.lit("{}")) if "properties" in have else F.lit("{}"))
    df = df.withColumn("tombstone", F.coalesce("tombstone", F.lit(False)) if "tombstone" in have else F.lit(False))
    for c, kind in (("confidence", "double"), ("epistemic_type", "string")):
        if c not in have:
            df = df.withColumn(c, F.lit(None).cast(kind))
    if "provenance" not in have:
        df = df.withColumn("provenance", F.lit(None).cast(PROVENANCE))
    df = df.withColumn("epistemic_type", epistemic(F.col("epistemic_type")))
    if "prop_tokens" not in have:
        df = df.withColumn("prop_tokens", tokens("properties"))
    if "content_hash" not in have:
        df = df.withColumn("content_hash", edge_hash())
    return _fill(df, EDGE_SCHEMA, {"version": F.lit(0), "parent_hashes": F.array().cast("array<string>")})


# --------------------------------------------------------------------------- the graph


@dataclass(frozen=True)
class Designation:
    """A property that carries a vector, full text, a point or a geometry."""

    kind: str
    label: str
    properties: tuple[str, ...]
    options: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class PropertyGraph:
    """Two DataFrames and what is designated on them. Immutable: every change gives a new graph."""

    nodes: DataFrame
    edges: DataFrame
    version: int = 0
    designations: tuple[Designation, ...] = ()
    tenant: str = "default"
    vectors: dict[tuple[str, str], DataFrame] = field(default_factory=dict, compare=False)
    label_tables: dict[str, DataFrame] = field(default_factory=dict, compare=False)  #: all nodes of each label, where they are kept apart
    type_tables: dict[str, DataFrame] = field(default_factory=dict, compare=False)  #: all edges of each type, where they are kept apart

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def live_nodes(self) -> DataFrame:
        return self.nodes.filter(~F.col("tombstone"))

    @cached_property
    def live_edges(self) -> DataFrame:
        return self.edges.filter(~F.col("tombstone"))

    @cached_property
    def bound_edges(self) -> DataFrame:
        """Live edges whose two ends are live nodes."""
        ids = self.live_nodes.select("id")
        e = self.live_edges
        return e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*EDGE_SCHEMA.names)

    def labelled(self, label: str | None) -> DataFrame:
        """Live nodes with a label; where nodes are kept apart by label, only that table is read."""
        if label is None:
            return self.live_nodes
        if self.label_tables:
            table = self.label_tables.get(label)
            return self.nodes.limit(0) if table is None else table.filter(~F.col("tombstone"))
        return self.live_nodes.filter(F.array_contains("labels", label))

    def typed(self, edge_type: str | None) -> DataFrame:
        """Live edges of a type; where edges are kept apart by type, only that table is read."""
        if edge_type is None:
            return self.live_edges
        if self.type_tables:
            table = self.type_tables.get(edge_type)
            return self.edges.limit(0) if table is None else table.filter(~F.col("tombstone"))
        return self.live_edges.filter(F.col("type") == edge_type)

    def with_(self, **changes: object) -> PropertyGraph:
        for part, tables in (("nodes", "label_tables"), ("edges", "type_tables")):
            if part in changes and tables not in changes:
                changes[tables] = {}
        return replace(self, **changes)

    @staticmethod
    def of_tables(labels: dict[str, DataFrame], types: dict[str, DataFrame], **options: object) -> PropertyGraph:
        """A graph whose nodes, in the node envelope, come in one table a label (one label a node), its edges in one a type."""
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        return PropertyGraph(union(labels.values()), union(types.values()), label_tables=labels, type_tables=types, **options)

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, **options: object) -> PropertyGraph:
        """A graph from loose tables; see :func:`as_nodes` and :func:`as_edges`."""
        return PropertyGraph(as_nodes(nodes), as_edges(edges), **options)

    @staticmethod
    def local(spark: SparkSession, nodes: list[dict], edges: list[dict], **options: object) -> PropertyGraph:
        """A small graph from Python records, for tests and interactive work."""
        n = [(r["id"], list(r.get("labels", [])), json.dumps(r.get("properties", {})), bool(r.get("tombstone", False)), int(r.get("version", 0))) for r in nodes]
        e = [
            (
                r.get("id") or f"{r['from_id']}-{r['type']}-{r['to_id']}", r["from_id"], r["to_id"], r["type"], json.dumps(r.get("properties", {})), bool(r.get("tombstone", False)), int(r.get("version", 0)),
                None if r.get("confidence") is None else float(r["confidence"]), r.get("epistemic_type"), tuple((r.get("provenance") or {}).get(k) for k in ("source_id", "timestamp", "method")) if r.get("provenance") else None,
            )
            for r in edges
        ]
        ns = T.StructType([NODE_SCHEMA[c] for c in ("id", "labels", "properties", "tombstone", "version")])
        es = T.StructType([EDGE_SCHEMA[c] for c in ("id", "from_id", "to_id", "type", "properties", "tombstone", "version", "confidence", "epistemic_type", "provenance")])
        return PropertyGraph.of(spark.createDataFrame(n, ns), spark.createDataFrame(e, es), **options)


def sanitize_tenant(name: str) -> str:
    """Letters, digits, underscore and hyphen; empty becomes ``default``."""
    import re

    return re.sub(r"[^A-Za-z0-9_-]", "", name) or "default"
