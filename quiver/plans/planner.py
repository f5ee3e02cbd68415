"""Clauses to DataFrames: a binding table goes from clause to clause, and with it the graph that writes change."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.graph import PropertyGraph, col
from quiver.operators import procedures, write
from quiver.operators.aggregate import aggregate
from quiver.operators.match import Matcher, Reads, field_readers, path_reads
from quiver.plans import checks
from quiver.plans.ast import (
    Call, CallProc, Clause, Create, CypherError, Delete, Exists, Item, Match, Merge, Node, Order, PatternList, PatternTest, Projection, Query, Remove,
    Set, Unary, Unwind, Var, rewrite, walk,
)
from quiver.plans.expressions import AGGREGATES, SUBQUERIES, Compiler, conjuncts, free, has_aggregate
from quiver.plans.scope import Binding, Scope, as_entity, fresh
from quiver.plans.values import BOOL, Val, cast, identity, kind, mixed, null_of, order_key

#: Edges of a walk without upper bound, at most.
WALK_CAP = 64
#: Bytes of files from which on a query's shuffles are dealt finely; of them to a shuffle partition, and of shuffled bytes to a task.
LARGE, INPUT_BYTES, SHUFFLE_BYTES = 32 << 20, 2 << 20, 8 << 20
#: Settings made by dealt(), by session and name; only these are changed again.
_SET: dict[tuple[str, int, str], str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; on one machine without one, in a temporary folder."""
    import tempfile

    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """Large inputs in more and smaller shuffle partitions, so that a task's memory doesn't grow with them; finer settings of the session stay."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(x.stats().sizeInBytes()) for x in found if x.getClass().getSimpleName() == "LogicalRelation")
    number, target = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
    for name, value, usual in ((number, -(-size // INPUT_BYTES), spark.conf.get("spark.sql.shuffle.partitions")), (target, SHUFFLE_BYTES, None)):
        if spark.conf.get(name, None) not in (None, "64MB", "67108864b", _SET.get((*key, name))):
            continue
        if size >= LARGE and (usual is None or value > int(usual)):
            _SET[*key, name] = str(value)
            spark.conf.set(name, value)
        elif _SET.pop((*key, name), None):
            spark.conf.unset(name)
    return df


@dataclass
class Planner:
    graph: PropertyGraph
    params: dict[str, Any] = field(default_factory=dict)
    walk_cap: int = WALK_CAP
    stats: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    used: set[str] = field(default_factory=set)
    reads: dict[str, Reads] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.graph.spark

    # -- queries

    def query(self, q: Query) -> tuple[DataFrame, list[str]]:
        """The result and its column names in order (none if the query returns nothing)."""
        checks.query(q, self.graph, self.params)
        results = [self.single(p, Scope(self.spark.range(1).select(), unit=True)) for p in q.parts]
        df, names = results[0]
        for more, own in results[1:]:
            if own != names:
                raise CypherError("DifferentColumnsInUnion", f"{names} and {own}")
            df = union(df, more)
        if q.all and not q.all[0]:
            df = distinct(df, [(f.name, f.dataType) for f in df.schema.fields])
        return dealt(df), names

    def single(self, clauses: tuple[Clause, ...], scope: Scope) -> tuple[DataFrame, list[str]]:
        self.used, self.reads = field_readers(clauses), path_reads(clauses)
        if "*" in self.used:
            self.used |= {n.name for c in clauses for n in walk(c) if isinstance(n, Var)} | {v for c in clauses for n in walk(c) if (v := getattr(n, "var", None))}
        if any(isinstance(c, (Create, Merge, Set, Remove, Delete)) for c in clauses):
            self.used |= {v for c in clauses for n in walk(c) if (v := getattr(n, "var", None))}
        for i, c in enumerate(clauses):
            if isinstance(c, Projection) and c.final:
                scope = self.project(scope, c)
                return self.result(scope)
            if isinstance(c, CallProc) and len(clauses) == 1:
                scope = procedures.call(self, scope, c, standalone=True)
                return self.result(scope)
            scope = self.clause(scope, c)
        return scope.df.limit(0).select(), []

    def clause(self, scope: Scope, c: Clause) -> Scope:
        if isinstance(c, Projection):
            return self.project(scope, c)
        if isinstance(c, Match):
            out = self.match(scope, c)
        elif isinstance(c, Unwind):
            out = self.unwind(scope, c)
        elif isinstance(c, CallProc):
            out = procedures.call(self, scope, c, standalone=False)
        else:
            out = write.apply(self, scope, c)
        return out.ordered_as(scope)

    def result(self, scope: Scope) -> tuple[DataFrame, list[str]]:
        out = []
        for name, b in scope.vars.items():
            v = b.val()
            out.append((v.col if not isinstance(v.type, T.NullType) else F.lit(None).cast("string")).alias(name))
        return scope.df.select(*out), list(scope.vars)

    def compiler(self, scope: Scope, known: dict[Node, Val] | None = None) -> Compiler:
        return Compiler(scope, self.params, known)

    # -- MATCH

    def matcher(self) -> Matcher:
        m = Matcher(self.graph, self.params, self.walk_cap, checkpoint, self.used, self.compiler, self.warnings)
        m.reads = self.reads
        return m

    def match(self, scope: Scope, c: Match) -> Scope:
        if c.optional:
            return self.optional(scope, c)
        m = self.matcher()
        out = m.run(scope, c.paths, c.where)
        for t in m.pending:
            out = self.filter(out, t)
        return out

    def optional(self, scope: Scope, c: Match) -> Scope:
        """Left join with what the whole pattern and its WHERE find for the distinct bindings that they use."""
        bound = free(c.paths) | (free(c.where) if c.where is not None else set())
        keys = sorted(bound & set(scope.vars))
        for k in keys:
            scope = as_entity(scope, k)
        new = {v for p in c.paths for n in walk(p) if (v := getattr(n, "var", None))} - set(scope.vars)
        direct = self.direct(scope, replace(c, optional=False), keys, self.used - set(keys))
        if direct is not None:
            found, renamed = direct
            test = None
            for old, own_key in renamed.items():
                t = col(old) == col(own_key)
                test = t if test is None else test & t
            df = scope.df.join(found.df, test, "left").drop(*renamed.values())
            return Scope(df, {**scope.vars, **{k: b for k, b in found.vars.items() if k in new}})
        own, renamed = self.distinct_of(scope, keys)
        found = self.match(own, replace(c, optional=False))
        found_vars = {k: b for k, b in found.vars.items() if k in new}
        right = found.df.select(*[col(x) for x in renamed.values()], *[col(x).alias(x) for b in found_vars.values() for x in b.columns])
        hit = fresh("hit")
        right = right.withColumn(hit, F.lit(True))
        test = self.on_keys(renamed)
        df = scope.df.join(right, test, "left").drop(*renamed.values(), hit)
        return Scope(df, {**scope.vars, **found_vars})

    def distinct_of(self, scope: Scope, keys: list[str]) -> tuple[Scope, dict[str, str]]:
        """The distinct bindings of some variables under fresh column names, and old -> new names of their keys."""
        if not keys:
            return Scope(self.spark.range(1).select(), unit=True), {}
        columns, vars_, renamed = [], {}, {}
        for k in keys:
            b = scope.vars[k]
            fields = {f: (fresh(c.split("#")[0]), t) for f, (c, t) in b.fields.items()}
            columns += [col(c).alias(fields[f][0]) for f, (c, _) in b.fields.items()]
            vars_[k] = replace(b, fields=fields)
            renamed[b.key] = vars_[k].key
        df = distinct(scope.df.select(*columns), [key_field(vars_[k]) for k in keys])
        return Scope(df, vars_), renamed

    def on_keys(self, renamed: dict[str, str]) -> Column:
        test = None
        for old, new in renamed.items():
            t = col(old).eqNullSafe(col(new))
            test = t if test is None else test & t
        return F.lit(True) if test is None else test

    # -- WHERE and subqueries

    def filter(self, scope: Scope, e: Node) -> Scope:
        """Rows for which e is true; existence tests become semi and anti joins."""
        for t in conjuncts(e):
            negated, inner = False, t
            while isinstance(inner, Unary) and inner.op == "not":
                negated, inner = not negated, inner.arg
            if isinstance(inner, (PatternTest, Exists)):
                scope = self.semi(scope, inner, "left_anti" if negated else "left_semi")
            else:
                scope, known = self.subqueries(scope, [t])
                scope = scope.where(self.compiler(scope, known).truth(t))
        return scope

    def correlated(self, scope: Scope, e: Node) -> tuple[Scope, list[str]]:
        keys = sorted(free(e) & set(scope.vars))
        for k in keys:
            scope = as_entity(scope, k)
        return scope, keys

    def inner(self, scope: Scope, e: PatternTest | Exists) -> tuple[Scope, DataFrame, dict[str, str]]:
        """The distinct keys of the scope for which the subquery has a row."""
        scope, keys = self.correlated(scope, e)
        if isinstance(e, PatternTest) or self.plain(e):
            match = Match(False, (e.path,), None) if isinstance(e, PatternTest) else e.query.parts[0][0]
            direct = self.direct(scope, match, keys, set())
            if direct is not None:
                found, renamed = direct
                return scope, found.df.select(*[col(x) for x in renamed.values()]), renamed
        own, renamed = self.distinct_of(scope, keys)
        used, found = self.used, None
        queries = (((Match(False, (e.path,), None)),),) if isinstance(e, PatternTest) else e.query.parts
        for clauses in queries:
            self.used = used | field_readers(clauses)
            s = own
            for c in clauses:
                if isinstance(c, Projection) and c.final and c.limit is None and c.skip is None and not has_aggregate(c.items):
                    continue
                if isinstance(c, Projection):
                    # Bound variables stay to tell the rows of different bindings apart.
                    extra = tuple(Item(Var(k), k, True) for k in keys if not any(i.name == k for i in c.items))
                    c = replace(c, items=c.items + extra, final=False, order=(), skip=None, limit=None)
                s = self.clause(s, c)
            part = s.df.select(*[col(x) for x in [s.vars[k].key for k in keys]]).toDF(*renamed.values()).distinct() if keys else s.df.limit(1).select(F.lit(1).alias(fresh("one")))
            found = part if found is None else found.union(part)
        self.used = used
        return scope, found, renamed  # type: ignore[return-value]

    @staticmethod
    def plain(e: Node) -> bool:
        return isinstance(e, Exists) and len(e.query.parts) == 1 and len(e.query.parts[0]) == 1 and isinstance(e.query.parts[0][0], Match) and not e.query.parts[0][0].optional

    def direct(self, scope: Scope, c: Match, keys: list[str], later: set[str]) -> tuple[Scope, dict[str, str]] | None:
        """The pattern matched by itself, without the scope's rows, if it meets them in nodes of known identity only."""
        nodes = {n.var: n for p in c.paths for n in p.nodes if n.var}
        if not keys or not all(k in nodes and scope.vars[k].kind == "node" for k in keys) or any(r.varlen for p in c.paths for r in p.rels):
            return None
        if any(isinstance(x, SUBQUERIES) for x in walk(c.where)) or any(p.var for p in c.paths):
            return None
        read = field_readers((replace(c, paths=()),))
        if any(k in read and scope.vars[k].labels is None for k in keys):
            return None
        used, self.used = self.used, read | later
        found = self.matcher().run(Scope(self.spark.range(1).select(), unit=True), c.paths, c.where)
        self.used = used
        renamed = {scope.vars[k].key: found.vars[k].key for k in keys}
        return found, renamed

    def semi(self, scope: Scope, e: PatternTest | Exists, how: str) -> Scope:
        scope, found, renamed = self.inner(scope, e)
        if not renamed:
            return Scope(scope.df.join(found, F.lit(True), how), scope.vars)
        test = None
        for old, new in renamed.items():
            t = col(old) == col(new) if how == "left_semi" or "_id" in old else col(old).eqNullSafe(col(new))
            test = t if test is None else test & t
        return Scope(scope.df.join(found, test, how), scope.vars)

    def subqueries(self, scope: Scope, exprs: list[Node]) -> tuple[Scope, dict[Node, Val]]:
        """Columns for the existence tests, pattern lists and endpoint lookups inside expressions."""
        known: dict[Node, Val] = {}
        todo: list[Node] = []
        for x in exprs:
            self._find(x, todo)
        for e in todo:
            if e in known:
                continue
            if isinstance(e, (PatternTest, Exists)):
                scope, found, renamed = self.inner(scope, e)
                flag = fresh("found")
                found = found.distinct().withColumn(flag, F.lit(True))
                df = scope.df.join(found, self.on_keys(renamed), "left").drop(*renamed.values())
                df = df.withColumn(flag, F.coalesce(col(flag), F.lit(False)))
                scope = Scope(df, scope.vars)
                known[e] = Val(col(flag), BOOL)
            elif isinstance(e, PatternList):
                scope, known[e] = self.pattern_list(scope, e)
            else:
                scope, known[e] = self.endpoint(scope, e)  # type: ignore[arg-type]
        return scope, known

    def _find(self, e: Node, out: list[Node]) -> None:
        from quiver.plans.ast import children

        if isinstance(e, SUBQUERIES):
            out.append(e)
            return
        if isinstance(e, Call) and e.name in ("startnode", "endnode", "startvertex", "endvertex"):
            out.append(e)
            return
        for c in children(e):
            self._find(c, out)

    def pattern_list(self, scope: Scope, e: PatternList) -> tuple[Scope, Val]:
        """A list per row: collected for distinct bindings, joined back, empty where nothing is found."""
        scope, keys = self.correlated(scope, e)
        own, renamed = self.distinct_of(scope, keys)
        used, self.used = self.used, self.used | field_readers((Projection(True, False, False, (Item(e.body, "x", True),)), Match(False, (e.path,), e.where))) | ({e.path.var} if e.path.var else set())
        found = self.match(own, Match(False, (e.path,), e.where))
        found, known = self.subqueries(found, [e.body])
        v = self.compiler(found, known)(e.body)
        self.used = used
        name = fresh("list")
        element = v.col if not isinstance(v.type, T.NullType) else F.lit(None).cast("string")
        # Nulls are elements of such a list; collect_list leaves them out, so they are wrapped.
        lists = found.df.groupBy(*[col(x) for x in renamed.values()]).agg(F.collect_list(F.struct(element.alias("x"))).alias(name))
        df = scope.df.join(lists, self.on_keys(renamed), "left").drop(*renamed.values())
        t = T.ArrayType(v.type)
        out = F.coalesce(F.transform(col(name), lambda x: x["x"]), F.array().cast(T.ArrayType(T.StringType()) if isinstance(v.type, T.NullType) else t))
        return Scope(df, scope.vars), Val(out, t)

    def endpoint(self, scope: Scope, e: Call) -> tuple[Scope, Val]:
        """startNode and endNode: the node table joined on the relationship's end."""
        r = self.compiler(scope)(e.args[0])
        if kind(r.type) == "null":
            return scope, null_of(r.type)
        if kind(r.type) != "relationship":
            raise CypherError("InvalidArgumentValue", f"{e.name}() takes a relationship")
        nodes = self.graph.scan_nodes()
        t = T.StructType(nodes.schema.fields)
        key, node = fresh("end"), fresh("endnode")
        nodes = nodes.select(col("_id").alias(key), F.struct(*[col(f.name) for f in t.fields]).alias(node))
        end = r.col["_src" if e.name.startswith("start") else "_dst"]
        return Scope(scope.df.join(nodes, end == col(key), "left").drop(key), scope.vars), Val(col(node), t)

    # -- UNWIND

    def unwind(self, scope: Scope, c: Unwind) -> Scope:
        scope, known = self.subqueries(scope, [c.expr])
        v = self.compiler(scope, known)(c.expr)
        name = fresh(c.var)
        if kind(v.type) == "null":
            return Scope(scope.df.where(F.lit(False)).withColumn(name, F.lit(None).cast("string")), {**scope.vars, c.var: Binding("value", {"": (name, T.NullType())})})
        if kind(v.type) != "list":
            v = Val(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))
        element = v.type.elementType  # type: ignore[attr-defined]
        vars_ = {**scope.vars, c.var: Binding("value", {"": (name, element)})}
        if not scope.order and not scope.unit:
            return Scope(scope.df.withColumn(name, F.explode(v.col)), vars_)
        place = fresh("place")
        df = scope.df.select("*", F.posexplode(v.col).alias(place, name))
        return Scope(df, vars_, order=(*scope.order, (place, False)), sorted=scope.sorted)

    # -- WITH and RETURN

    def project(self, scope: Scope, c: Projection) -> Scope:
        items, came = list(c.items), scope
        if c.star:
            if c.final and not scope.vars:
                raise CypherError("NoVariablesInScope", "RETURN * without variables")
            items = [Item(Var(v), v, True) for v in sorted(scope.vars)] + items
        if not c.final:
            for i in items:
                if not i.aliased:
                    raise CypherError("NoExpressionAlias", i.name)
        if len({i.name for i in items}) < len(items):
            raise CypherError("ColumnNameConflict", "two columns of one name")
        order = [Order(self.resolve(o.expr, items), o.descending) for o in c.order]
        grouped = any(has_aggregate(i.expr) for i in items) or any(has_aggregate(o.expr) for o in order)
        where = c.where
        if grouped or c.distinct:
            out = self.grouped(scope, items, [o.expr for o in order]) if grouped else self.plain_items(scope, items)
            df, vars_, known = out
            if c.distinct:
                df = distinct(df, [key_field(b) for b in vars_.values()])
            new = Scope(df, vars_)
            after = Scope(df, vars_)
        else:
            df, vars_, known = self.plain_items(scope, items)
            new = Scope(df, vars_)
            after = Scope(df, {**scope.vars, **vars_})
        keys: list[Column] = []
        placed: dict[str, Column] = {}
        by: list[tuple[str, bool]] = []
        if order:
            after, more = self.subqueries(after, [o.expr for o in order])
            compiler = self.compiler(after, {**known, **more})
            for o in order:
                k = order_key(compiler(o.expr))
                keys.append(k.desc_nulls_first() if o.descending else k.asc_nulls_last())
                by.append((fresh("order"), o.descending))
                placed[by[-1][0]] = k
        elif not grouped and not c.distinct:
            by = list(came.order)
            keys = came.sort_columns() if came.sorted else []
        df = after.df
        if placed and not c.final:
            # The order goes on with the rows, for what collects them later.
            df = df.withColumns(placed)
            keys = Scope(df, order=tuple(by)).sort_columns()
        skip, limit = (None if x is None else checks.count_of(x, self.params) for x in (c.skip, c.limit))
        if keys and (c.final or skip is not None or limit is not None):
            df = df.orderBy(*keys)
        if skip:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        if where is not None:
            # Sees the new names and, without grouping, the old ones.
            df = self.filter(Scope(df, after.vars), where).df
        if c.final:
            by = []
        columns = [col(x) for b in new.vars.values() for x in b.columns]
        return Scope(df.select(*columns, *[col(x) for x, _ in by]), new.vars, order=tuple(by), sorted=bool(by) and (bool(order) or came.sorted))

    def resolve(self, e: Node, items: list[Item]) -> Node:
        """Order expressions that repeat an item mean its column."""
        table = {i.expr: Var(i.name) for i in items if not isinstance(i.expr, Var)}
        return rewrite(e, lambda n: table.get(n))

    def plain_items(self, scope: Scope, items: list[Item]) -> tuple[DataFrame, dict[str, Binding], dict[Node, Val]]:
        scope, known = self.subqueries(scope, [i.expr for i in items])
        compiler = self.compiler(scope, known)
        new: dict[str, Column] = {}
        vars_: dict[str, Binding] = {}
        for i in items:
            if isinstance(i.expr, Var) and i.expr.name in scope.vars:
                vars_[i.name] = scope.vars[i.expr.name]
                continue
            v = compiler(i.expr)
            name = fresh(i.name.replace(".", "@"))
            new[name] = v.col if not isinstance(v.type, T.NullType) else F.lit(None).cast("string")
            vars_[i.name] = Binding("value", {"": (name, v.type)})
        return (scope.df.withColumns(new) if new else scope.df), vars_, {}

    def grouped(self, scope: Scope, items: list[Item], order: list[Node]) -> tuple[DataFrame, dict[str, Binding], dict[Node, Val]]:
        """Implicit grouping: items without aggregates are keys; aggregates are computed once each."""
        exprs, came = [i.expr for i in items], scope
        plain = [i for i in items if not has_aggregate(i.expr)]
        calls: dict[Node, Val] = {}
        for e in exprs + order:
            for n in walk(e):
                if isinstance(n, Call) and n.name in AGGREGATES:
                    calls.setdefault(n, None)  # type: ignore[arg-type]
        scope, known = self.subqueries(scope, [i.expr for i in plain] + [a for n in calls for a in n.args])  # type: ignore[attr-defined]
        compiler = self.compiler(scope, known)
        keyed: dict[str, Column] = {}
        vars_: dict[str, Binding] = {}
        extra: list[Column] = []
        group: list[str] = []
        known_keys: dict[Node, Val] = {}
        for i in plain:
            if isinstance(i.expr, Var) and i.expr.name in scope.vars and scope.vars[i.expr.name].kind != "value":
                b = scope.vars[i.expr.name]
                group.append(b.key)
                extra += [F.first(col(x)).alias(x) for x in b.columns if x != b.key]
                vars_[i.name] = b
            else:
                v = compiler(i.expr)
                name = fresh(i.name.replace(".", "@"))
                keyed[name] = v.col if not isinstance(v.type, T.NullType) else F.lit(None).cast("string")
                vars_[i.name] = Binding("value", {"": (name, v.type)})
                if mixed(v.type):
                    # Variants are no keys: grouped by what tells them apart.
                    group.append(fresh("key"))
                    keyed[group[-1]] = identity(v)
                    extra.append(F.first(col(name)).alias(name))
                else:
                    group.append(name)
            known_keys[i.expr] = vars_[i.name].val()
        df = scope.df.withColumns(keyed) if keyed else scope.df
        put: dict[str, Column] = {}

        def named(x: Column) -> str:
            name = fresh("arg")
            put[name] = x
            return name

        ranks: list[str] = []

        def rank() -> Column:
            if not ranks:
                ranks.append(fresh("rank"))
            return col(ranks[0])

        made = []
        for n in calls:
            v = aggregate(n, scope, compiler, named, rank if came.order else None)  # type: ignore[arg-type]
            name = fresh("agg")
            made.append(v.col.alias(name))
            calls[n] = Val(col(name), v.type)
        if put:
            df = df.withColumns(put)
        group = list(dict.fromkeys(group))
        if ranks:
            df = df.withColumn(ranks[0], F.row_number().over(Window.partitionBy(*[col(g) for g in group]).orderBy(*came.sort_columns())))
        df = df.groupBy(*[col(g) for g in group]).agg(*made, *extra)
        after = self.compiler(Scope(df, {}), {**calls, **known_keys})
        new: dict[str, Column] = {}
        for i in items:
            if has_aggregate(i.expr):
                v = after(i.expr)
                name = fresh(i.name.replace(".", "@"))
                new[name] = v.col if not isinstance(v.type, T.NullType) else F.lit(None).cast("string")
                vars_[i.name] = Binding("value", {"": (name, v.type)})
        if new:
            df = df.withColumns(new)
        return df, {i.name: vars_[i.name] for i in items}, {**calls, **known_keys}


def key_field(b: Binding) -> tuple[str, T.DataType]:
    return b.fields["_id" if b.kind != "value" else ""]


def distinct(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    """One row for each combination of values of the columns."""
    keys = {fresh("key"): identity(Val(col(c), t)) for c, t in columns if mixed(t)}
    if not keys:
        return df.dropDuplicates([c for c, _ in columns])
    return df.withColumns(keys).dropDuplicates([c for c, t in columns if not mixed(t)] + list(keys)).drop(*keys)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns in a's order, of types that hold both."""
    from quiver.plans.values import unify

    if not a.columns:
        return a
    types = {f.name: unify([f.dataType, b.schema[f.name].dataType]) for f in a.schema.fields}
    fit = lambda df: df.select(*[cast(Val(col(n), df.schema[n].dataType), t).alias(n) for n, t in types.items()])
    return fit(a).union(fit(b))

