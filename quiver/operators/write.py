"""Writes: graph and bindings to a new graph and new bindings.

The rows that a write works on are checkpointed first, so each is evaluated once and new ids stay.
New entities get negative ids: the statement's number, the partition and the row within it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.graph import EdgeTable, NodeTable, PropertyGraph, col
from quiver.plans.ast import Clause, Create, CypherError, Delete, MapLit, Match, Merge, Node, NodePattern, Path, Prop, RelPattern, Remove, SetItem, Var, children
from quiver.plans.scope import Binding, Scope, as_entity, fresh
from quiver.plans.values import LONG, STRING, Val, cast, kind, unify

LABEL_KINDS = ("labels", "unlabel")
#: Statements whose new rows a made table takes before its parts are written together.
COMPACT = 16
#: Rows of one entity that SET takes one after another, at most; more are an error.
MOST_TURNS = 64
STORABLE = ("boolean", "integer", "float", "string", "bytes", "date", "localtime", "time", "localdatetime", "datetime", "duration", "point", "any")


def apply(planner, scope: Scope, c: Clause) -> Scope:
    from quiver.plans.planner import checkpoint

    if isinstance(c, Create):
        scope = replace(scope, df=checkpoint(scope.df))
        return create(planner, scope, c.paths)
    if isinstance(c, Merge):
        return merge(planner, scope, c)
    scope = replace(scope, df=checkpoint(scope.df))
    if isinstance(c, Delete):
        return delete(planner, scope, c)
    items = c.items  # type: ignore[attr-defined]
    if isinstance(c, Remove):
        items = tuple(replace(i, kind="unlabel") if i.kind == "labels" else i for i in items)
    return change(planner, scope, items, None)


def count(planner, what: str, n: int) -> None:
    planner.stats[what] = planner.stats.get(what, 0) + n


def storable(key: str, v: Val) -> Val:
    k = kind(v.type)
    if k == "list":
        storable(key, Val(v.col, v.type.elementType))  # type: ignore[attr-defined]
    elif k not in (*STORABLE, "null"):
        raise CypherError("InvalidPropertyType", f"{key}: a {k} can't be stored")
    return v


# -- CREATE


def new_ids(planner, n: int) -> list[Column]:
    """n id columns for each row: statement, partition, row and place, in 10, 16, 33 - and 4 bits."""
    planner.graph = replace(planner.graph, serial=planner.graph.serial + 1)
    row = F.monotonically_increasing_id()
    place = F.shiftright(row, 33) * F.lit(1 << 37) + row.bitwiseAND(F.lit((1 << 33) - 1)) * 16
    if n > 16:
        raise CypherError("InvalidClauseComposition", "more than 16 new entities in one CREATE")
    base = planner.graph.serial << 53
    return [-(place + F.lit(base + i)) for i in range(n)]


def properties(planner, scope: Scope, props: Node | None) -> dict[str, Val]:
    m = planner.matcher()
    return {k: storable(k, v) for k, v in m.properties(props, scope)}


def create(planner, scope: Scope, paths: tuple[Path, ...], at_once: bool = True) -> Scope:
    """New nodes and relationships for each row; scope.df must be evaluated once."""
    from quiver.plans.planner import checkpoint

    new_nodes: list[tuple[str, NodePattern]] = []
    new_rels: list[tuple[str, RelPattern, str, str]] = []
    seen = set(scope.vars)
    names: dict[int, str] = {}
    for v in [v for p in paths for n in p.nodes if (v := n.var) and v in scope.vars]:
        scope = as_entity(scope, v)
    serial = 0
    for p in paths:
        ends = []
        for n in p.nodes:
            var = n.var or f" node{serial}"
            serial += 1
            if var not in seen:
                seen.add(var)
                new_nodes.append((var, n))
            ends.append(var)
        for i, r in enumerate(p.rels):
            var = r.var or f" rel{serial}"
            serial += 1
            a, z = (ends[i], ends[i + 1]) if r.direction >= 0 else (ends[i + 1], ends[i])
            new_rels.append((var, r, a, z))
            names[id(r)] = var
    ids = new_ids(planner, len(new_nodes) + len(new_rels))
    # Property expressions see earlier entities of the same clause only by their ids and properties.
    columns: dict[str, Column] = {}
    fields: dict[str, dict[str, tuple[str, T.DataType]]] = {}
    for (var, *_), c in zip([*new_nodes, *new_rels], ids, strict=True):
        name = fresh(f"{var.strip()}@_id")
        columns[name] = c
        fields[var] = {"_id": (name, LONG)}
    df = scope.df.withColumns(columns)
    vars_ = dict(scope.vars)
    for var, n in new_nodes:
        labels = sorted({x for g in n.labels.any_of for _, x in g}) if n.labels else []
        lab = fresh(f"{var.strip()}@_labels")
        df = df.withColumn(lab, F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>"))
        fields[var]["_labels"] = (lab, T.ArrayType(STRING))
        df = put_properties(planner, Scope(df, vars_), n.props, var, fields[var])
        vars_[var] = Binding("node", fields[var], frozenset(labels))
    for var, r, a, z in new_rels:
        own = fields[var]
        for f, c, t in (("_type", F.lit(r.types[0]), STRING), ("_src", col(vars_[a].key), LONG), ("_dst", col(vars_[z].key), LONG)):
            name = fresh(f"{var.strip()}@{f}")
            df = df.withColumn(name, c)
            own[f] = (name, t)
        df = put_properties(planner, Scope(df, vars_), r.props, var, own)
        vars_[var] = Binding("relationship", own)
    df = checkpoint(df)
    rows = df.count()
    graph = planner.graph
    for var, n in new_nodes:
        b = vars_[var]
        graph = add_nodes(graph, df.select(*[col(c).alias(f) for f, (c, _) in b.fields.items()]), b.labels or frozenset())
    for var, r, _, _ in new_rels:
        b = vars_[var]
        ends_known = df.where(col(b.fields["_src"][0]).isNotNull() & col(b.fields["_dst"][0]).isNotNull())
        graph = add_edges(graph, ends_known.select(*[col(c).alias(f) for f, (c, _) in b.fields.items()]), r.types[0])
    planner.graph = graph
    count(planner, "nodes_created", rows * len(new_nodes))
    count(planner, "relationships_created", rows * len(new_rels))
    out = Scope(df, vars_)
    for p in paths:
        if p.var:
            out = path_value(out, p, new_nodes, names)
    kept = {k: b for k, b in out.vars.items() if not k.startswith(" ")}
    return Scope(out.df, kept)


def path_value(scope: Scope, p: Path, new_nodes: list, names: dict[int, str]) -> Scope:
    anonymous = iter([v for v, n in new_nodes if n.var is None])
    nodes = [scope.vars[n.var or next(anonymous)].val() for n in p.nodes]
    rels = [scope.vars[names[id(r)]].val() for r in p.rels]
    from quiver.plans.values import array

    a, r = array(nodes), array(rels)
    t = T.StructType([T.StructField("nodes", a.type), T.StructField("relationships", r.type)])
    name = fresh(p.var or "path")
    return Scope(scope.df.withColumn(name, F.struct(a.col.alias("nodes"), r.col.alias("relationships"))), {**scope.vars, p.var: Binding("value", {"": (name, t)})})  # type: ignore[dict-item]


def put_properties(planner, scope: Scope, props: Node | None, var: str, fields: dict[str, tuple[str, T.DataType]]) -> DataFrame:
    new = {}
    for k, v in properties(planner, scope, props).items():
        if kind(v.type) == "null":
            continue
        name = fresh(f"{var.strip()}@{k}")
        new[name] = v.col
        fields[k] = (name, v.type)
    return scope.df.withColumns(new) if new else scope.df


def add_nodes(graph: PropertyGraph, rows: DataFrame, labels: frozenset[str]) -> PropertyGraph:
    """The new nodes beside those that earlier statements made with the same labels; tables from outside keep their files."""
    return replace(graph, nodes=grown(graph.nodes, NodeTable(rows, labels, made=1), lambda t: t.labels == labels and not t.more))


def add_edges(graph: PropertyGraph, rows: DataFrame, kind_: str) -> PropertyGraph:
    return replace(graph, edges=grown(graph.edges, EdgeTable(rows, kind_, made=1), lambda t: t.type == kind_))


def grown(tables: tuple, new: Any, alike: Callable[[Any], bool]) -> tuple:
    """The tables with one more, or with its rows in a made table of the same schema, which is checkpointed now and then."""
    from quiver.plans.planner import checkpoint

    for i, t in enumerate(tables):
        if t.made and alike(t) and t.df.schema == new.df.schema:
            both = t.df.union(new.df)
            return (*tables[:i], replace(t, df=checkpoint(both) if (t.made + 1) % COMPACT == 0 else both, made=t.made + 1), *tables[i + 1 :])
    return (*tables, new)


# -- MERGE


def merge(planner, scope: Scope, c: Merge) -> Scope:
    """Match the pattern for each distinct key of the rows, create it for the keys without a match, and join back."""
    from quiver.plans.planner import checkpoint

    bound = [n.var for n in c.path.nodes if n.var and n.var in scope.vars]
    for v in bound:
        scope = as_entity(scope, v)
    # Inline properties become columns, and the pattern refers to them.
    keys: dict[str, Column] = {}
    parts: list[Any] = []
    vars_ = dict(scope.vars)
    for part in c.path.parts:
        new = {}
        for k, v in properties(planner, scope, part.props).items():  # type: ignore[attr-defined]
            name = fresh(f"merge@{k}")
            keys[name] = v.col if not isinstance(v.type, T.NullType) else F.lit(None).cast("string")
            alias = f" {name}"
            vars_[alias] = Binding("value", {"": (name, v.type)})
            new[k] = Var(alias)
        parts.append(replace(part, props=MapLit(tuple(new.items())) if new else None))  # type: ignore[type-var]
    path = Path(c.path.var, tuple(parts))
    df = checkpoint(scope.df.withColumns(keys) if keys else scope.df)
    if keys and not df.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        raise CypherError("MergeReadOwnWrites", "MERGE with a null property")
    scope = Scope(df, vars_)
    names = sorted(set(bound)) + [k for k in vars_ if k.startswith(" merge@")]
    own, renamed = planner.distinct_of(scope, names)
    own = Scope(checkpoint(own.df), own.vars)
    used, planner.used = planner.used, planner.used | {n.var for n in path.parts if n.var}  # type: ignore[attr-defined]
    matched = planner.match(own, Match(False, (path,), None))
    planner.used = used
    new_vars = [v for v in ([n.var for n in path.parts if n.var] + ([path.var] if path.var else [])) if v not in scope.vars]  # type: ignore[attr-defined]
    key_columns = list(renamed.values())
    found = Scope(checkpoint(matched.df), matched.vars)
    if key_columns:
        missing = own.df.join(found.df.select(*[col(k) for k in key_columns]).distinct(), key_columns, "left_anti")
    else:
        missing = own.df if found.df.isEmpty() else own.df.limit(0)
    made = create(planner, Scope(checkpoint(missing), own.vars), (directed(path),))
    if c.on_create:
        made = change(planner, made, c.on_create, new_vars)
    if c.on_match:
        found = change(planner, found, c.on_match, new_vars)
    both, fields = stack(found, made, key_columns, new_vars)
    both = checkpoint(both)
    test = planner.on_keys({old: new for old, new in renamed.items()})
    joined = scope.df.join(both, test, "inner").drop(*key_columns)
    kept = {k: b for k, b in scope.vars.items() if not k.startswith(" ")}
    return Scope(joined, {**kept, **fields})


def directed(p: Path) -> Path:
    return replace(p, parts=tuple(replace(x, direction=1) if isinstance(x, RelPattern) and x.direction == 0 else x for x in p.parts))


def stack(a: Scope, b: Scope, keys: list[str], names: list[str]) -> tuple[DataFrame, dict[str, Binding]]:
    """Rows of both scopes with the same fields for the named variables."""
    fields: dict[str, Binding] = {}
    left, right = [col(k) for k in keys], [col(k) for k in keys]
    for n in names:
        x, y = a.vars[n], b.vars[n]
        own = {}
        for f in list(dict.fromkeys([*x.fields, *y.fields])):
            vx, vy = x.get(f), y.get(f)
            t = unify([v.type for v in (vx, vy) if v is not None])
            name = fresh(f"{n}@{f}")
            for side, v in ((left, vx), (right, vy)):
                side.append((cast(v, t) if v is not None else F.lit(None).cast(t)).alias(name))
            own[f] = (name, t)
        fields[n] = Binding(x.kind, own)
    return a.df.select(*left).union(b.df.select(*right)), fields


# -- SET and REMOVE


def change(planner, scope: Scope, items: tuple[SetItem, ...], only: list[str] | None) -> Scope:
    """SET and REMOVE row by row: where an entity has several rows, each sees what the rows before it did.

    Where no value reads what is set, the last row of each entity is enough.  Rows come in their order, or
    without one in that of the checkpoint that holds them.
    """
    of = lambda i: i.target.base if isinstance(i.target, Prop) else i.target
    targets = sorted({of(i).name for i in items if isinstance(of(i), Var)})
    for v in targets:
        scope = as_entity(scope, v)
    keys = {v: scope.vars[v].key for v in targets if scope.vars[v].kind != "value"}
    most = max((scope.df.where(col(k).isNotNull()).groupBy(col(k)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for k in keys.values()), default=0)
    if most <= 1 or all(i.kind in LABEL_KINDS for i in items):
        return change_once(planner, scope, items)
    from quiver.plans.planner import checkpoint

    place, turn = fresh("place"), fresh("turn")
    rows = checkpoint(scope.df.withColumn(place, F.monotonically_increasing_id()))
    by = scope.sort_columns() or [col(place)]
    if not reads_own(items):
        for v, k in keys.items():
            last = rows.withColumn(turn, F.row_number().over(Window.partitionBy(col(k)).orderBy(*reversed_order(scope, place)))).where((col(turn) == 1) & col(k).isNotNull())
            change_once(planner, Scope(last.drop(turn), scope.vars), tuple(i for i in items if of(i).name == v))
        return read_again(planner, Scope(rows.drop(place), scope.vars), targets)
    if len(keys) > 1 or most > MOST_TURNS:
        raise CypherError("InvalidClauseComposition", f"SET on one entity in {most} rows, whose values depend on each other; aggregate them first")
    (key,) = keys.values()
    rows = checkpoint(rows.withColumn(turn, F.row_number().over(Window.partitionBy(col(key)).orderBy(*by))))
    for n in range(1, most + 1):
        change_once(planner, read_again(planner, Scope(rows.where((col(turn) == n) & col(key).isNotNull()).drop(turn, place), scope.vars), targets), items)
        if n % 8 == 0:
            labels = scope.vars[targets[0]].labels
            if scope.vars[targets[0]].kind == "node":
                planner.graph = replace(planner.graph, nodes=tuple(replace(t, df=checkpoint(t.df)) if not labels or labels <= (t.labels | t.more) else t for t in planner.graph.nodes))
    return read_again(planner, Scope(rows.drop(turn, place), scope.vars), targets)


def reversed_order(scope: Scope, place: str) -> list[Column]:
    """The last row first."""
    return [col(c).asc_nulls_last() if down else col(c).desc_nulls_first() for c, down in scope.order] + [col(place).desc()]


def reads_own(items: tuple[SetItem, ...]) -> bool:
    """Whether a value reads a property that one of the items sets, or an entity as a whole."""
    written = {i.target.key for i in items if isinstance(i.target, Prop)}
    whole = any(i.kind in ("replace", "merge") for i in items)
    names = {(i.target.base if isinstance(i.target, Prop) else i.target).name for i in items}

    def reads(e: Any) -> bool:
        if isinstance(e, Prop) and isinstance(e.base, Var):
            return e.key in written or (whole and e.base.name in names)
        if isinstance(e, Var):
            return e.name in names
        return any(reads(c) for c in children(e))

    return any(isinstance(i.value, Node) and reads(i.value) for i in items)


def read_again(planner, scope: Scope, names: list[str]) -> Scope:
    """The variables' fields as the graph has them now."""
    for v in names:
        b = scope.vars[v]
        if b.kind != "value":
            scope = reread(planner, scope, v, b)
    return scope


def change_once(planner, scope: Scope, items: tuple[SetItem, ...]) -> Scope:
    for item in items:
        target = item.target.base if isinstance(item.target, Prop) else item.target
        if not isinstance(target, Var):
            raise CypherError("InvalidArgumentType", "SET and REMOVE take properties and labels of variables")
        scope = as_entity(scope, target.name)
        b = scope.vars[target.name]
        if b.kind == "value":
            if kind(b.val().type) == "null":
                continue
            raise CypherError("InvalidArgumentType", f"{target.name} is no node or relationship")
        new, clear = updates(planner, scope, b, item)
        scope = rewrite_entity(planner, scope, target.name, b, new, clear, item)
    return scope


def updates(planner, scope: Scope, b: Binding, item: SetItem) -> tuple[dict[str, Val], bool]:
    """New values by property, and whether all other properties go."""
    if item.kind in LABEL_KINDS:
        return {}, False
    scope2, known = planner.subqueries(scope, [item.value] if isinstance(item.value, Node) else [])
    if item.kind == "prop":
        v = planner.compiler(scope2, known)(item.value) if item.value is not None else Val(F.lit(None).cast("string"), T.NullType())
        return {item.target.key: storable(item.target.key, v)}, False  # type: ignore[attr-defined]
    v = planner.compiler(scope2, known)(item.value)
    if kind(v.type) not in ("map", "node", "relationship"):
        raise CypherError("InvalidArgumentType", "a map is needed")
    return {f: storable(f, v.field(f)) for f in v.fields if f and not f.startswith("_")}, item.kind == "replace"


def rewrite_entity(planner, scope: Scope, var: str, b: Binding, new: dict[str, Val], clear: bool, item: SetItem) -> Scope:
    """Tables with the changed rows, and the variable's fields as they are now."""
    from quiver.plans.planner import checkpoint

    graph: PropertyGraph = planner.graph
    key = "_changed"
    values = {f"_new_{f}": (F.lit(None).cast("string") if isinstance(v.type, T.NullType) else v.col) for f, v in new.items()}
    rows = scope.df.select(col(b.key).alias(key), *[c.alias(n) for n, c in values.items()]).where(col(key).isNotNull())
    rows = checkpoint(rows.dropDuplicates([key]))
    n = rows.count()
    count(planner, "labels_changed" if item.kind in LABEL_KINDS else "properties_set", n * max(1, len(new) or len(item.value or ())))
    tables = graph.nodes if b.kind == "node" else graph.edges
    fixed = ("_id", "_labels") if b.kind == "node" else ("_id", "_type", "_src", "_dst")
    removing = item.kind == "unlabel"
    out = []
    for t in tables:
        if b.kind == "node" and b.labels and not b.labels <= (t.labels | t.more):
            out.append(t)
            continue
        types = {f.name: f.dataType for f in t.df.schema.fields}
        joined = t.df.join(rows, col("_id") == col(key), "left")
        hit = col(key).isNotNull()
        columns = [col(f) for f in fixed if f != "_labels"]
        if b.kind == "node":
            labels = col("_labels")
            if item.kind in LABEL_KINDS:
                names = F.array(*map(F.lit, item.value))
                labels = F.when(hit, F.array_except(labels, names) if removing else F.array_sort(F.array_union(labels, names))).otherwise(labels)
            columns.append(labels.alias("_labels"))
        for f, old in types.items():
            if f in fixed:
                continue
            if f in new:
                u = unify([old, new[f].type])
                columns.append(F.when(hit, cast(Val(col(f"_new_{f}"), new[f].type if not isinstance(new[f].type, T.NullType) else STRING), u) if not isinstance(new[f].type, T.NullType) else F.lit(None).cast(u)).otherwise(cast(Val(col(f), old), u)).alias(f))
            else:
                columns.append(F.when(~hit, col(f)).alias(f) if clear else col(f))
        for f, v in new.items():
            if f not in types and not isinstance(v.type, T.NullType):
                columns.append(col(f"_new_{f}").alias(f))
        df = joined.select(*columns)
        if isinstance(t, NodeTable):
            sure, more = t.labels, t.more
            if item.kind in LABEL_KINDS:
                own = frozenset(item.value)
                sure, more = (sure - own, more | (sure & own)) if removing else (sure, more | own)
            out.append(replace(t, df=df, labels=sure, more=more - sure))
        else:
            out.append(replace(t, df=df))
    planner.graph = replace(graph, **{"nodes" if b.kind == "node" else "edges": tuple(out)})
    return reread(planner, scope, var, replace(b, labels=None) if item.kind in LABEL_KINDS else b)


def reread(planner, scope: Scope, var: str, b: Binding) -> Scope:
    frame = planner.graph.scan_nodes(None, b.labels) if b.kind == "node" else planner.graph.scan_edges()
    fields = {f.name: (fresh(f"{var}@{f.name}"), f.dataType) for f in frame.schema.fields}
    frame = frame.select(*[col(f).alias(c) for f, (c, _) in fields.items()])
    joined = scope.df.join(frame, col(b.key) == col(fields["_id"][0]), "left")
    joined = joined.drop(*b.columns)
    return Scope(joined, {**scope.vars, var: Binding(b.kind, fields, b.labels)})


# -- DELETE


def delete(planner, scope: Scope, c: Delete) -> Scope:
    from quiver.plans.planner import checkpoint

    node_ids: DataFrame | None = None
    rel_ids: DataFrame | None = None

    def add(old: DataFrame | None, ids: DataFrame) -> DataFrame:
        ids = ids.toDF("_gone").where(col("_gone").isNotNull())
        return ids if old is None else old.union(ids)

    for e in c.exprs:
        v = planner.compiler(scope)(e)
        k = kind(v.type)
        if k == "node":
            node_ids = add(node_ids, scope.df.select(v.col["_id"]))
        elif k == "relationship":
            rel_ids = add(rel_ids, scope.df.select(v.col["_id"]))
        elif k == "path":
            node_ids = add(node_ids, scope.df.select(F.explode(F.transform(v.col["nodes"], lambda x: x["_id"]))))
            rel_ids = add(rel_ids, scope.df.select(F.explode(F.transform(v.col["relationships"], lambda x: x["_id"]))))
        elif k == "list" and kind(v.type.elementType) in ("node", "relationship"):  # type: ignore[attr-defined]
            ids = scope.df.select(F.explode(F.transform(v.col, lambda x: x["_id"])))
            if kind(v.type.elementType) == "node":  # type: ignore[attr-defined]
                node_ids = add(node_ids, ids)
            else:
                rel_ids = add(rel_ids, ids)
        elif k != "null":
            raise CypherError("InvalidArgumentType", f"DELETE of a {k}")
    graph: PropertyGraph = planner.graph
    edges = graph.edges
    if rel_ids is not None:
        gone = checkpoint(rel_ids.distinct())
        count(planner, "relationships_deleted", gone.count())
        edges = tuple(replace(t, df=t.df.join(gone, col("_id") == col("_gone"), "left_anti")) for t in edges)
    nodes = graph.nodes
    if node_ids is not None:
        gone = checkpoint(node_ids.distinct())
        count(planner, "nodes_deleted", gone.count())
        kept = []
        for t in edges:
            free_ = t.df.join(gone, col("_src") == col("_gone"), "left_anti").join(gone, col("_dst") == col("_gone"), "left_anti")
            if not c.detach:
                touched = t.df.join(gone, col("_src") == col("_gone"), "left_semi").union(t.df.join(gone, col("_dst") == col("_gone"), "left_semi"))
                if not touched.isEmpty():
                    raise CypherError("DeleteConnectedNode", "a node with relationships; DETACH DELETE deletes both")
            kept.append(replace(t, df=free_))
        edges = tuple(kept)
        nodes = tuple(replace(t, df=t.df.join(gone, col("_id") == col("_gone"), "left_anti")) for t in nodes)
    planner.graph = replace(graph, nodes=nodes, edges=edges)
    return scope

