"""CALL: built-in procedures, and user procedures declared as tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.graph import col
from quiver.plans.ast import CallProc, CypherError, Labels, Param
from quiver.plans.scope import Binding, Scope, fresh
from quiver.plans.values import Val, equal, kind, literal

#: Names of the index procedures, with the class of entity and what they do.
INDEX_CALLS = {
    "db.index.createproperty": ("vertex", "create"), "db.index.createedgeproperty": ("edge", "create"),
    "db.index.dropproperty": ("vertex", "drop"), "db.index.dropedgeproperty": ("edge", "drop"),
    "db.index.propertybuildjobs": ("vertex", "jobs"), "db.index.edgebuildjobs": ("edge", "jobs"),
    "db.index.processpropertybuildjobs": ("vertex", "process"), "db.index.processedgebuildjobs": ("edge", "process"),
    "db.index.restartpropertybuild": ("vertex", "restart"), "db.index.restartedgepropertybuild": ("edge", "restart"),
}


@dataclass(frozen=True)
class Procedure:
    """A user procedure: typed inputs and outputs, and rows that are found by equal inputs."""

    inputs: tuple[tuple[str, str], ...]
    outputs: tuple[tuple[str, str], ...]
    rows: DataFrame


def call(planner, scope: Scope, c: CallProc, standalone: bool) -> Scope:
    if c.star and not standalone:
        raise CypherError("UnexpectedSyntax", "YIELD * only in a CALL of its own")
    name = c.name.lower()
    args = c.args
    procedure = planner.graph.procedures.get(c.name)
    if args is None:
        if not standalone:
            raise CypherError("InvalidArgumentPassingMode", "arguments are needed here")
        args = tuple(Param(n) for n, _ in procedure.inputs) if procedure else ()
    values = [planner.compiler(scope)(a) for a in args]
    if procedure is not None:
        df, outputs, keys = user(planner, c.name, procedure, values)
    else:
        df, outputs = builtin(planner, name, values)
        keys = []
    chosen = c.yields if c.yields is not None else tuple((o, o) for o in outputs)
    if c.yields is None and not standalone and outputs:
        raise CypherError("UnexpectedSyntax", "YIELD is needed here")
    for field, _ in chosen:
        if field not in outputs:
            raise CypherError("UndefinedVariable", f"{c.name} yields no {field}")
    if len({n for _, n in chosen}) < len(chosen):
        raise CypherError("VariableAlreadyBound", "two results of one name")
    named = {field: fresh(alias) for field, alias in chosen}
    types = {f.name: f.dataType for f in df.schema.fields}
    right = df.select(*[col(k) for k, _ in keys], *[col(f).alias(n) for f, n in named.items()])
    test = F.lit(True)
    for k, v in keys:
        test = test & F.coalesce(equal(Val(col(k), types[k]), v), F.lit(False))
    joined = (scope.df.join(right, test, "inner") if keys else right if scope.unit else scope.df.crossJoin(right)).drop(*[k for k, _ in keys])
    out = Scope(joined, {**scope.vars, **{alias: Binding("value", {"": (named[f], types[f])}) for f, alias in chosen}})
    return planner.filter(out, c.where) if c.where is not None else out


def user(planner, name: str, p: Procedure, values: list[Val]) -> tuple[DataFrame, list[str], list[tuple[str, Val]]]:
    if len(values) != len(p.inputs):
        raise CypherError("InvalidNumberOfArguments", f"{name} takes {len(p.inputs)} arguments")
    allowed = {"INTEGER": ("integer",), "FLOAT": ("float", "integer"), "NUMBER": ("float", "integer"), "STRING": ("string",), "BOOLEAN": ("boolean",)}
    for (n, t), v in zip(p.inputs, values, strict=True):
        own, nullable = t.rstrip("?").upper(), t.endswith("?")
        k = kind(v.type)
        if k == "null" and not nullable or k != "null" and own in allowed and k not in allowed[own]:
            raise CypherError("InvalidArgumentType", f"{name}: {n} is {t}, not {k}")
    keys = {n: fresh(f"in_{n}") for n, _ in p.inputs}
    rows = p.rows.select(*[col(n).alias(k) for n, k in keys.items()], *[col(o) for o, _ in p.outputs])
    return rows, [o for o, _ in p.outputs], [(keys[n], v) for (n, _), v in zip(p.inputs, values, strict=True)]


def builtin(planner, name: str, values: list[Val]) -> tuple[DataFrame, list[str]]:
    graph = planner.graph
    consts = [v.const for v in values]
    if name in ("db.stats.vertexcount", "db.stats.edgecount"):
        if len(values) > 1 or any(not isinstance(c, str) for c in consts):
            raise CypherError("InvalidArgumentType", f"{name} takes a label")
        labels = Labels((((False, consts[0]),),)) if consts else None
        if name.endswith("vertexcount"):
            return graph.scan_nodes(labels).agg(F.count(F.lit(1)).alias("vertexCount")), ["vertexCount"]
        edges = graph.scan_edges().select("_id", "_src", "_dst")
        if labels is not None:
            # Distinct edges that touch a vertex with the label, at either end.
            ids = graph.scan_nodes(labels).select(col("_id").alias("_vertex"))
            at = lambda end: edges.join(ids, col(end) == col("_vertex"), "left_semi")
            edges = at("_src").union(at("_dst")).select("_id").distinct()
        return edges.agg(F.count(F.lit(1)).alias("edgeCount")), ["edgeCount"]
    if name == "db.labels":
        return graph.scan_nodes().select(F.explode("_labels").alias("label")).distinct(), ["label"]
    if name in ("db.relationshiptypes", "db.edgetypes"):
        return graph.scan_edges().select(col("_type").alias("relationshipType")).distinct(), ["relationshipType"]
    if name in INDEX_CALLS:
        return index(planner, *INDEX_CALLS[name], consts)
    raise CypherError("ProcedureNotFound", name)


def index(planner, cls: str, verb: str, consts: list[Any]) -> tuple[DataFrame, list[str]]:
    """A record of wished indexes.  They count as built at once: tables need none, so nothing is pending."""
    graph = planner.graph
    make = lambda rows, ddl: (graph.spark.createDataFrame(rows, ddl), [c.split()[0] for c in ddl.split(", ")])
    if verb == "process":
        return make([(0, 0)], "processed bigint, pending bigint")
    if verb == "jobs":
        name, counted = ("schema", "indexedEntities") if cls == "vertex" else ("edgeType", "indexedEdges")
        rows = [(graph.tenant or "", s, p, False, "", entities(graph, *x)) for x in graph.indexes if x[0] == cls for _, s, p in [x]]
        return make(rows, f"tenant string, {name} string, property string, pending boolean, checkpointVertexID string, {counted} bigint")
    least, most = (2, 2) if verb == "restart" else (2, 3)
    if not least <= len(consts) <= most or not all(isinstance(c, str) for c in consts[:2]) or not all(isinstance(c, bool) or c is None for c in consts[2:]):
        raise CypherError("InvalidArgumentType", f"index procedures take a schema and a property, and to {verb} a flag")
    entry = (cls, consts[0], consts[1])
    there, lenient = entry in graph.indexes, bool(consts[2:] and consts[2])
    if verb == "restart":
        return make([(there,)], "enqueued boolean")
    if there == (verb == "create") and not lenient:
        raise CypherError("ProcedureCallFailed", f"the index on {entry[1]}.{entry[2]} is {'there already' if there else 'not there'}")
    kept = tuple(x for x in graph.indexes if x != entry)
    planner.graph = replace(graph, indexes=(*kept, entry) if verb == "create" else kept)
    n = entities(graph, *entry) if there != (verb == "create") else 0
    return make([(there != (verb == "create"), n)], ("created boolean, indexedEntities bigint" if verb == "create" else "dropped boolean, deletedEntities bigint"))


def entities(graph, cls: str, schema: str, prop: str) -> int:
    """How many vertices of the label, or edges of the type, have the property."""
    df = graph.scan_nodes(Labels((((False, schema),),))) if cls == "vertex" else graph.scan_edges((schema,))
    return df.where(col(prop).isNotNull()).count() if prop in df.columns else 0
