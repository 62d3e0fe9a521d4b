"""Readers: JSON lines, CSV, snapshots and mutation logs, each with a table of rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..iterate import settle
from ..model import PROVENANCE, GraphError, PropertyGraph, as_edges, as_nodes

ERRORS_KEPT = 32


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file and place; CR at the end is dropped. Lines of a few small files are dealt to all tasks before they are parsed."""
    t = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    t = t.filter(F.trim("line") != "")
    tasks = spark.sparkContext.defaultParallelism
    return t.repartition(tasks) if t.rdd.getNumPartitions() < tasks else t


def _object(line: Column) -> Column:
    return F.from_json(line, "map<string,variant>", {"mode": "PERMISSIVE"})


def _string(m: Column, key: str) -> Column:
    v = m[F.lit(key)]
    return F.when(F.call_function("schema_of_variant", v) == "STRING", v.cast("string"))


def nodes_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and rejects (file, at, line, code). ``id`` must be a string; labels that aren't strings are dropped; ``properties`` must be an object."""
    t = _lines(spark, path).withColumn("m", _object(F.col("line")))
    labels = F.transform(F.filter(F.coalesce(F.call_function("try_variant_get", F.col("m")[F.lit("labels")], F.lit("$"), F.lit("array<variant>")), F.array().cast("array<variant>")), lambda v: F.call_function("schema_of_variant", v) == "STRING"), lambda v: v.cast("string"))
    dead = F.coalesce(F.call_function("try_variant_get", F.col("m")[F.lit("tombstone")], F.lit("$"), F.lit("boolean")), F.lit(False))
    t = t.select("file", "at", "line", F.get_json_object("line", "$").isNotNull().alias("ok"), _string(F.col("m"), "id").alias("id"), labels.alias("labels"), F.get_json_object("line", "$.properties").alias("raw"), dead.alias("tombstone"))
    code = (
        F.when(~F.col("ok"), "invalid_json").when(F.col("id").isNull(), "missing_id").when(F.trim("id") == "", "blank_node_id")
        .when(F.col("raw").isNotNull() & ~F.col("raw").startswith("{"), "properties_not_object")
    )
    t = settle(t.withColumn("code", code))  # parsed once, however often good and bad rows are asked for
    good = t.filter("code is null").select("id", "labels", F.coalesce("raw", F.lit("{}")).alias("properties"), "tombstone", F.col("at").alias("seq"))
    return good, t.filter("code is not null").select("file", "at", "line", "code")


def edges_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges and rejects. ``id``, ``from_id``, ``to_id`` and ``type`` (or ``edge_type``) must be strings; confidence, epistemic type and provenance are read too."""
    t = _lines(spark, path).withColumn("m", _object(F.col("line")))
    s = lambda k: _string(F.col("m"), k)
    prov = F.from_json(F.get_json_object("line", "$.provenance"), PROVENANCE)
    t = t.select(
        "file", "at", "line", F.get_json_object("line", "$").isNotNull().alias("ok"), s("id").alias("id"), s("from_id").alias("from_id"), s("to_id").alias("to_id"), F.coalesce(s("type"), s("edge_type")).alias("type"),
        F.get_json_object("line", "$.properties").alias("raw"), F.get_json_object("line", "$.confidence").try_cast("double").alias("confidence"), s("epistemic_type").alias("epistemic_type"), prov.alias("provenance"),
        F.coalesce(F.get_json_object("line", "$.tombstone") == "true", F.lit(False)).alias("tombstone"),
    )
    code = F.when(~F.col("ok"), "invalid_json")
    for c in ("id", "from_id", "to_id", "type"):
        code = code.when(F.coalesce(F.trim(c), F.lit("")) == "", f"missing_{c}")
    code = code.when(F.col("raw").isNotNull() & ~F.col("raw").startswith("{"), "properties_not_object").when(F.col("epistemic_type").isNotNull() & ~F.lower("epistemic_type").isin("supports", "contradicts", "tension", "derives", "cites"), "unknown_epistemic_type")
    t = settle(t.withColumn("code", code))  # parsed once, however often good and bad rows are asked for
    good = t.filter("code is null").select("id", "from_id", "to_id", "type", F.coalesce("raw", F.lit("{}")).alias("properties"), "confidence", "epistemic_type", "provenance", "tombstone", F.col("at").alias("seq"))
    return good, t.filter("code is not null").select("file", "at", "line", "code")


def _csv(spark: SparkSession, path: str, headers: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Lines split at commas (no quoting); the header is the first line unless given."""
    t = _lines(spark, path)
    if headers is None:
        head = t.orderBy("at").first()
        if head is None:
            raise GraphError("empty_csv")
        headers = [h.strip() for h in head["line"].split(",")]
        t = t.filter(~((F.col("at") == head["at"]) & (F.col("file") == head["file"])))
    return t.withColumn("cells", F.transform(F.split("line", ",", -1), lambda x: F.trim(x))), headers


def nodes_csv(spark: SparkSession, path: str, headers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes from a column ``id`` (else the first), an optional ``label`` column, all others string properties; rows of another width are rejects."""
    t, head = _csv(spark, path, headers)
    at = head.index("id") if "id" in head else 0
    wide = F.size("cells") != len(head)
    cell = lambda i: F.get("cells", F.lit(i))
    t = t.withColumn("code", F.when(wide, "width_mismatch").when(cell(at) == "", "missing_id"))
    rest = [(h, i) for i, h in enumerate(head) if i != at and h != "label"]
    props = F.to_json(F.create_map(*[x for h, i in rest for x in (F.lit(h), cell(i))])) if rest else F.lit("{}")
    labels = F.array(cell(head.index("label"))) if "label" in head else F.array().cast("array<string>")
    good = t.filter("code is null").select(cell(at).alias("id"), labels.alias("labels"), props.alias("properties"), F.col("at").alias("seq"))
    return good, t.filter("code is not null").select("file", "at", "line", "code")


def edges_csv(spark: SparkSession, path: str, headers: list[str] | None = None, from_col: str = "from_id", to_col: str = "to_id") -> tuple[DataFrame, DataFrame]:
    """Edges; the type column may be ``edge_type``, ``type`` or ``rel``; a missing column is an error."""
    t, head = _csv(spark, path, headers)
    kind = next((c for c in ("edge_type", "type", "rel") if c in head), None)
    if from_col not in head or to_col not in head or kind is None:
        raise GraphError("missing_column", f"{from_col}, {to_col} and a type column are needed")
    cell = lambda c: F.get("cells", F.lit(head.index(c)))
    key = cell("id") if "id" in head else F.concat_ws("-", cell(from_col), cell(kind), cell(to_col))
    rest = [h for h in head if h not in ("id", from_col, to_col, kind, "confidence")]
    props = F.to_json(F.create_map(*[x for h in rest for x in (F.lit(h), cell(h))])) if rest else F.lit("{}")
    conf = cell("confidence").try_cast("double") if "confidence" in head else F.lit(None).cast("double")
    t = t.withColumn("code", F.when(F.size("cells") != len(head), "width_mismatch").when((cell(from_col) == "") | (cell(to_col) == ""), "missing_endpoint").when(cell(kind) == "", "missing_type"))
    good = t.filter("code is null").select(key.alias("id"), cell(from_col).alias("from_id"), cell(to_col).alias("to_id"), cell(kind).alias("type"), props.alias("properties"), conf.alias("confidence"), F.col("at").alias("seq"))
    return good, t.filter("code is not null").select("file", "at", "line", "code")


def load_nodes(g: PropertyGraph, good: DataFrame, bad: DataFrame) -> tuple[PropertyGraph, dict]:
    """Upsert what was read; the report has counts and the first errors."""
    from ..versioning.mutate import upsert_nodes

    n, failed = good.count(), bad.count()
    return upsert_nodes(g, good, "seq") if n else g, {"inserted": n, "failed": failed, "errors": [r.asDict() for r in bad.orderBy("at").limit(ERRORS_KEPT).collect()]}


def load_edges(g: PropertyGraph, good: DataFrame, bad: DataFrame) -> tuple[PropertyGraph, dict]:
    """As for nodes; edges whose ends are missing or dead are rejects, found by joins, not row by row."""
    from ..versioning.mutate import rejects, upsert_edges

    refused = settle(rejects(g, good))
    fine = good.join(refused.select("id"), "id", "left_anti")
    n, failed = fine.count(), bad.count() + refused.count()
    errors = [r.asDict() for r in bad.orderBy("at").limit(ERRORS_KEPT).collect()] + [r.asDict() for r in refused.orderBy("id").limit(ERRORS_KEPT).collect()]
    return upsert_edges(g, fine, "seq", checked=True) if n else g, {"inserted": n, "failed": failed, "errors": errors[:ERRORS_KEPT]}


# --------------------------------------------------------------------------- snapshots and logs

_NODE = "struct<id:string,labels:array<string>,properties:string,version:bigint,tombstone:boolean,content_hash:string,parent_hashes:array<string>>"
_EDGE = "struct<id:string,from_id:string,to_id:string,type:string,properties:string,version:bigint,tombstone:boolean,confidence:double,epistemic_type:string,provenance:struct<source_id:string,timestamp:string,method:string>,content_hash:string,parent_hashes:array<string>>"


def snapshot_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from a JSON envelope {version, txn_id, graph: {version, nodes, edges}}; edges without ends are dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<version:int,txn_id:bigint,graph:struct<version:bigint,nodes:array<{_NODE}>,edges:array<{_EDGE}>>>").alias("s"))
    head = whole.select("s.version", "s.graph.version").first()
    if head is None or head[1] is None:
        raise GraphError("invalid_snapshot", path)
    n = as_nodes(whole.select(F.explode("s.graph.nodes").alias("n")).select("n.*"))
    e = as_edges(whole.select(F.explode("s.graph.edges").alias("e")).select("e.*"))
    ids = n.select("id")
    e = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return PropertyGraph(n, e.select(*[f for f in as_edges(e).columns]), int(head[1]))


def frame_checksum(body: Column) -> Column:
    return F.sha2(body, 256)


def replay_log(g: PropertyGraph, path: str, after_txn: int = 0) -> tuple[PropertyGraph, dict]:
    """Apply a log of lines {txn, checksum, body}; body is JSON text {nodes, edges}.

    Everything from the first frame on whose checksum or JSON is bad is ignored; frames up to ``after_txn`` are skipped;
    the last record of each id wins.
    """
    spark = g.spark
    t = _lines(spark, path).select("at", F.from_json("line", "struct<txn:bigint,checksum:string,body:string>").alias("f"))
    t = t.select("at", "f.*")
    ok = F.coalesce(F.col("checksum") == frame_checksum(F.col("body")), F.lit(False))
    bad = t.filter(~ok).agg(F.min("at")).first()[0]
    if bad is not None:
        t = t.filter(F.col("at") < bad)
    t = t.filter(ok & (F.col("txn") > after_txn)).withColumn("b", F.from_json("body", f"struct<nodes:array<{_NODE}>,edges:array<{_EDGE}>>"))
    last = lambda df: df.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("txn"), F.desc("pos")))).filter("_rn = 1").drop("_rn", "txn", "pos")
    n = as_nodes(last(t.select("txn", F.posexplode("b.nodes").alias("pos", "r")).select("txn", "pos", "r.*")))
    e = as_edges(last(t.select("txn", F.posexplode("b.edges").alias("pos", "r")).select("txn", "pos", "r.*")))
    stat = t.agg(F.count(F.lit(1)), F.max("txn")).first()
    nodes = g.nodes.join(n.select("id"), "id", "left_anti").select(*n.columns).unionByName(n)
    edges = g.edges.join(e.select("id"), "id", "left_anti").select(*e.columns).unionByName(e)
    return g.with_(nodes=nodes, edges=edges, version=g.version + int(stat[0] or 0)), {"frames": int(stat[0] or 0), "last_txn": int(stat[1] or after_txn), "truncated_at": bad}
