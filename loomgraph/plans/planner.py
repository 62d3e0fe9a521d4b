"""Syntax tree to DataFrame plan. Only the ids and property tokens that a query names enter its joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..iterate import first_rows
from ..model import GraphError, PropertyGraph, token_number, token_text
from ..operators.match import target_equals, token_equals, var_length
from ..versioning.mutate import tombstone_nodes, upsert_edges, upsert_nodes
from .syntax import DEFAULT_LIMIT, Assignment, Item, NodePattern, Query, parse


def _places(q: Query) -> dict[str, int]:
    return {n.name: i for i, n in enumerate(q.pattern.nodes) if n.name}


def _tests(q: Query) -> list[list[Column]]:
    """Predicates of each pattern node; WHERE joins the node that it names."""
    out = []
    places = _places(q)
    for i, n in enumerate(q.pattern.nodes):
        props = dict(n.props)
        if q.where and places.get(q.where[0]) == i:
            _, key, value = q.where
            if key in props and (props[key] != value or type(props[key]) is not type(value)):
                raise GraphError("contradictory_filter", key)
            props[key] = value
        test = token_equals if i == 0 else target_equals
        out.append([test(k, v) for k, v in props.items()])
    if q.where and q.where[0] not in places:
        raise GraphError("unknown_binding", q.where[0])
    return out


def _check(q: Query) -> None:
    known = set(_places(q)) | ({q.pattern.path} if q.pattern.path else set())
    if q.with_items:
        for x in q.with_items:
            if x.name and x.name not in known:
                raise GraphError("unknown_binding", x.name)
        known = {x.alias for x in q.with_items}
    for x in q.items:
        if x.name and x.name not in known:
            raise GraphError("unknown_binding", x.name)
    if q.pattern.hops and not q.with_items and q.pattern.nodes[0].label is None and not q.pattern.nodes[0].props and not (q.where and q.where[0] == q.pattern.nodes[0].name):
        raise GraphError("relationship_scan", "the first node needs a label or a property")


def _needed(q: Query) -> tuple[dict[int, set[str]], set[int]]:
    """Property keys by pattern node, and the nodes that are returned whole."""
    places, keys, whole = _places(q), {}, set()
    refs = [(x.name, x.key, x.aggregate) for x in (*q.with_items, *q.items)] + [(o.name, o.key, None) for o in q.order]
    if q.with_items:
        refs = [(x.name, x.key, x.aggregate) for x in q.with_items]
    for name, key, aggregate in refs:
        if name in places:
            if key:
                keys.setdefault(places[name], set()).add(key)
            elif not aggregate:
                whole.add(places[name])
    return keys, whole


RECORD = ("id", "labels", "properties", "version")


def matches(g: PropertyGraph, q: Query) -> DataFrame:
    """All bindings of the pattern: columns id0, id1, ..., k{i}_{key} tokens, r{i} whole records, path."""
    keys, whole = _needed(q)
    tests = _tests(q)

    def side(i: int) -> DataFrame:
        n = q.pattern.nodes[i]
        df = g.labelled(n.label)
        for t in tests[i]:
            df = df.filter(t)
        cols = [F.col("id").alias(f"id{i}")]
        cols += [F.col("prop_tokens")[F.lit(k)].alias(f"k{i}_{k}") for k in sorted(keys.get(i, ()))]
        if i in whole:
            cols.append(F.struct(*RECORD).alias(f"r{i}"))
        return df.select(*cols)

    rows = side(0)
    hops = q.pattern.hops
    if hops and hops[0].low is not None:
        end = side(1)
        reach = var_length(g, rows.select(F.col("id0").alias("id")).distinct(), hops[0].type, hops[0].low, hops[0].high, end.select(F.col("id1").alias("id")))
        rows = rows.join(reach.select(F.col("seed").alias("id0"), F.col("id").alias("id1"), "path"), "id0").join(end, "id1")
        return rows
    for i, h in enumerate(hops, 1):
        e = g.typed(h.type).select(F.col("from_id").alias(f"id{i - 1}"), F.col("to_id").alias(f"id{i}"))
        rows = rows.join(e, f"id{i - 1}").join(side(i), f"id{i}")
    if q.pattern.path:
        rows = rows.withColumn("path", F.array(*[f"id{i}" for i in range(len(hops) + 1)]))
    return rows


def _aggregate(kind: str, token: Column | None) -> Column:
    if kind == "COUNT" or token is None:
        return F.count(F.lit(1))  # rows, also those without the property
    n = token_number(token)
    return {"SUM": F.coalesce(F.sum(n), F.lit(0.0)), "AVG": F.avg(n), "MIN": F.min(n), "MAX": F.max(n)}[kind]


def _sort(c: Column, down: bool) -> list[Column]:
    """Nulls lowest; numbers by value, other values by text."""
    n, t = token_number(c), token_text(c)
    return [t.isNotNull().desc() if down else t.isNotNull().asc(), n.desc_nulls_last() if down else n.asc_nulls_last(), t.desc() if down else t.asc()]


def read(g: PropertyGraph, q: Query, types: dict[str, str] | None = None, default_limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Rows of a read query; without LIMIT at most ``default_limit`` (None: all, in no order unless one is asked for). Property values come as text, or as the type given for their column; counts as whole numbers, other aggregates as doubles."""
    _check(q)
    places = _places(q)
    rows = matches(g, q)
    limit = default_limit if q.limit is None else q.limit

    def page(df: DataFrame, sort: list[Column], ties: list[Column]) -> DataFrame:
        if limit is not None or q.skip or sort:
            df = df.orderBy(*sort, *ties) if sort or ties else df
        return first_rows(df, limit, q.skip)

    ids = [c for c in rows.columns if c.startswith("id") and c[2:].isdigit()]

    def token(x: Item) -> Column | None:
        return F.col(f"k{places[x.name]}_{x.key}") if x.name in places and x.key else None

    if q.with_items:
        # without aggregates this keeps distinct rows
        keys, aggs = [], []
        for x in q.with_items:
            if x.aggregate:
                aggs.append(_aggregate(x.aggregate, token(x)).alias(x.alias))
            else:
                keys.append((token(x) if x.key else F.col(f"id{places[x.name]}")).alias(x.alias))
        grouped = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
        if aggs and not keys:
            grouped = rows.agg(*aggs, F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")
        kinds = {x.alias: ("agg" if x.aggregate else "token" if x.key else "id") for x in q.with_items}
        out = grouped
        second = [x for x in q.items if x.aggregate]
        if second:
            plain = [F.col(x.name).alias(x.column) for x in q.items if not x.aggregate]
            num = lambda x: F.col(x.name) if kinds.get(x.name) == "agg" else token_number(F.col(x.name))
            fs = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
            aggs = [(F.count(F.lit(1)) if x.aggregate == "COUNT" else fs[x.aggregate](num(x))).alias(x.column) for x in second]
            out = out.groupBy(*plain).agg(*aggs) if plain else out.agg(*aggs)
            kinds = {x.column: ("agg" if x.aggregate else kinds.get(x.name)) for x in q.items}
            shown = [(x.column, x.column) for x in q.items]
        else:
            shown = [(x.name, x.column) for x in q.items]
        sort = []
        for o in q.order:
            if o.text in kinds:
                sort += _sort(F.col(o.text), o.descending) if kinds[o.text] == "token" else [F.col(o.text).desc_nulls_last() if o.descending else F.col(o.text).asc_nulls_first()]
        ties = [F.col(c).asc_nulls_first() for c in out.columns]
        out = page(out, sort, ties)
        return _typed(out.select(*[(token_text(F.col(c)) if kinds[c] == "token" else F.col(c)).alias(a) for c, a in shown]), types)

    aggs = [x for x in q.items if x.aggregate]
    if aggs:
        plain = [x for x in q.items if not x.aggregate]
        if not plain and all(x.aggregate == "COUNT" for x in aggs):
            return rows.agg(*[F.count(F.lit(1)).alias(x.column) for x in aggs])
        keys = [(token(x) if x.key else F.col(f"id{places[x.name]}")).alias(x.column) for x in plain]
        cols = [_aggregate(x.aggregate, token(x)).alias(x.column) for x in aggs]
        out = rows.groupBy(*keys).agg(*cols) if keys else rows.agg(*cols, F.count(F.lit(1)).alias("_n")).filter("_n > 0").drop("_n")
        named = {x.column: x for x in q.items} | {x.text: x for x in q.items}
        sort = []
        for o in q.order:
            x = named.get(o.text)
            if x:
                sort += [F.col(f"`{x.column}`").desc_nulls_last() if o.descending else F.col(f"`{x.column}`").asc_nulls_first()] if x.aggregate or not x.key else _sort(F.col(f"`{x.column}`"), o.descending)
        out = page(out, sort, [F.col(f"`{x.column}`").asc_nulls_first() for x in plain])
        return _typed(out.select(*[(token_text(F.col(f"`{x.column}`")) if x.key and not x.aggregate else F.col(f"`{x.column}`")).alias(x.column) for x in q.items]), types)

    sort = []
    for o in q.order:
        if o.name in places and o.key:
            sort += _sort(F.col(f"k{places[o.name]}_{o.key}"), o.descending)
        else:
            x = next((x for x in q.items if x.column == o.text), None)
            if x is not None and x.key:
                sort += _sort(token(x), o.descending)
    rows = page(rows, sort, [F.col(c) for c in ids])

    def show(x: Item) -> Column:
        if q.pattern.path and x.name == q.pattern.path:
            return F.col("path").alias(x.column)
        if x.key:
            return token_text(token(x)).alias(x.column)
        return F.col(f"r{places[x.name]}").alias(x.column)

    return _typed(rows.select(*[show(x) for x in q.items]), types)


def _typed(df: DataFrame, types: dict[str, str] | None) -> DataFrame:
    return df.select(*[(F.col(f"`{c}`").cast(types[c]) if types and c in types else F.col(f"`{c}`")).alias(c) for c in df.columns])


def explain(text: str, params: dict[str, object] | None = None) -> dict:
    """The plan as a list of steps, without running anything."""
    q = parse(text, params)
    if q.kind == "read":
        _check(q)
    first = q.pattern.nodes[0]
    steps = [{"op": "node_seek" if first.label or first.props or q.where else "node_scan", "label": first.label, "filters": [k for k, _ in first.props]}]
    for h, n in zip(q.pattern.hops, q.pattern.nodes[1:]):
        steps.append({"op": "expand" if h.low is None else "var_length_expand", "type": h.type, "range": None if h.low is None else [h.low, h.high], "label": n.label, "filters": [k for k, _ in n.props]})
    if q.with_items:
        steps.append({"op": "aggregate" if any(x.aggregate for x in q.with_items) else "distinct", "columns": [x.alias for x in q.with_items]})
    if q.kind == "read":
        if any(x.aggregate for x in q.items):
            steps.append({"op": "count" if not q.with_items and all(x.aggregate == "COUNT" for x in q.items) else "aggregate"})
        if q.order:
            steps.append({"op": "sort", "keys": [o.text for o in q.order]})
        if q.skip:
            steps.append({"op": "skip", "n": q.skip})
        steps.append({"op": "limit", "n": DEFAULT_LIMIT if q.limit is None else q.limit})
        steps.append({"op": "project", "columns": [x.column for x in q.items]})
    else:
        steps.append({"op": q.kind})
    return {"kind": q.kind, "steps": steps}


# --------------------------------------------------------------------------- writes


def _merge_json(props: Column, changes: dict[str, Column]) -> Column:
    """JSON text with keys set; values are JSON text."""
    parts = F.transform_values(F.from_json(props, "map<string,variant>"), lambda k, v: F.to_json(v))
    new = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v)])
    kept = F.map_filter(parts, lambda k, v: ~k.isin(*changes))
    both = F.map_concat(kept, new)
    rows = F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]))
    # ["k"]:v -> "k":v
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda r: F.regexp_replace(r, r'^\["((?:[^"\\]|\\.)*)"\]:', r'"$1":')), ","), F.lit("}"))


def _set_columns(sets: tuple[Assignment, ...]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for a in sets:
        if a.increment_of:
            old = F.col("prop_tokens")[F.lit(a.increment_of[1])]
            n = F.when(old.startswith("int:"), F.substring(old, 5, 30).try_cast("bigint"))
            out[a.key] = (F.coalesce(n, F.lit(0)) + F.lit(int(a.value) if isinstance(a.value, int) else 0)).cast("string")
        else:
            out[a.key] = F.lit(json.dumps(a.value))
    return out


def _record(n: NodePattern) -> tuple[str, list[str], dict]:
    props = dict(n.props)
    if not isinstance(props.get("id"), str) or not props["id"].strip():
        raise GraphError("missing_id", "a written node needs a string id")
    node_id = props.pop("id")
    return node_id, [n.label] if n.label else [], props


def write(g: PropertyGraph, q: Query) -> PropertyGraph:
    spark = g.spark
    if q.kind == "create":
        rows = [_record(n) for n in q.pattern.nodes]
        if len(rows) > 2 or any(h.low is not None for h in q.pattern.hops):
            raise GraphError("unsupported_cypher", "CREATE takes a node or one edge")
        nodes = spark.createDataFrame([(i, l, json.dumps(p), k) for k, (i, l, p) in enumerate(rows)], "id string, labels array<string>, properties string, seq int")
        if q.pattern.hops:
            out = upsert_nodes(g, nodes.join(g.live_nodes.select("id"), "id", "left_anti") if any(not n.label and len(n.props) == 1 for n in q.pattern.nodes) else nodes, "seq")
            a, b, t = rows[0][0], rows[1][0], q.pattern.hops[0].type
            return upsert_edges(out, spark.createDataFrame([(f"{a}-{t}-{b}", a, b, t, "{}")], "id string, from_id string, to_id string, type string, properties string"))
        return upsert_nodes(g, nodes, "seq")
    if q.kind == "merge":
        if q.pattern.hops:
            raise GraphError("unsupported_cypher", "MERGE takes a node")
        node_id, labels, props = _record(q.pattern.nodes[0])
        old = g.live_nodes.filter(F.col("id") == node_id)
        if old.isEmpty():
            for a in q.on_create:
                props[a.key] = (props.get(a.increment_of[1], 0) if a.increment_of else 0) + a.value if a.increment_of else a.value
            return upsert_nodes(g, spark.createDataFrame([(node_id, labels, json.dumps(props))], "id string, labels array<string>, properties string"))
        changes = _set_columns(q.on_match)
        new = old.select("id", F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"), (_merge_json(F.col("properties"), changes) if changes else F.col("properties")).alias("properties"))
        return upsert_nodes(g, new)
    if q.pattern.hops:
        raise GraphError("unsupported_cypher", f"{q.kind.upper()} takes a single-node pattern")
    n = q.pattern.nodes[0]
    hit = g.labelled(n.label)
    for t in _tests(q)[0]:
        hit = hit.filter(t)
    if q.kind == "delete":
        if q.target != n.name:
            raise GraphError("unknown_binding", str(q.target))
        return tombstone_nodes(g, hit.select("id"), q.detach)
    if any(a.name != n.name for a in q.sets):
        raise GraphError("unknown_binding", "SET")
    return upsert_nodes(g, hit.select("id", "labels", _merge_json(F.col("properties"), _set_columns(q.sets)).alias("properties")))


def cypher(g: PropertyGraph, text: str, params: dict[str, object] | None = None, types: dict[str, str] | None = None, default_limit: int | None = DEFAULT_LIMIT) -> DataFrame | PropertyGraph:
    """Run a statement: reads give a DataFrame, writes a new graph."""
    q = parse(text, params)
    return read(g, q, types, default_limit) if q.kind == "read" else write(g, q)


__all__ = ["cypher", "explain", "matches", "read", "write"]
