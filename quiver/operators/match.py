"""Pattern matching as joins.

A pattern extends a binding table hop by hop.  Endpoint tables are joined only where something of
them is needed: labels that the edge table doesn't already promise, inline properties, or fields that
the query reads.  Predicates are applied as soon as their variables are bound.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.graph import EdgeTable, PropertyGraph, col, label_test, label_verdict, row_count
from quiver.plans.ast import CypherError, Labels, MapLit, Node, NodePattern, Param, Path, Prop, RelPattern, Var
from quiver.plans.expressions import SUBQUERIES, Compiler, conjuncts, free
from quiver.plans.scope import Binding, Scope, as_entity, bind_frame, fresh
from quiver.plans.ast import walk
from quiver.plans.values import LONG, Val, equal, kind, unify

#: Hops up to which a variable length is unrolled into joins; beyond, each hop is checkpointed.
UNROLL = 8
#: Edges of an average node from which on a hop from it back over such edges multiplies rows, and such rows in a task.
HUB, PAIRS = 256, 4_000_000


#: Properties that a query reads of a path's nodes and of its relationships; None: all.
Reads = tuple[frozenset[str] | None, frozenset[str] | None]


class Matcher:
    """Matches the paths of one clause."""

    def __init__(self, graph: PropertyGraph, params: dict, cap: int, checkpoint, used: set[str], compiler, warnings: list[str]) -> None:
        self.warnings = warnings
        self.graph, self.params, self.cap, self.checkpoint, self.used = graph, params, cap, checkpoint, used
        self.compile = compiler  # f(scope) -> Compiler
        self.single: list[tuple[str, frozenset[str]]] = []  # edge id columns and their types
        self.many: list[str] = []  # columns of edge id lists
        self.pending: list[Node] = []
        self.reads: dict[str, Reads] = {}
        self.kept: Reads = (None, None)  # of the path at hand

    def run(self, scope: Scope, paths: tuple[Path, ...], where: Node | None) -> Scope:
        """All extensions of the scope's rows.  Conjuncts with subqueries stay in self.pending."""
        tests = conjuncts(where)
        self.pending = [t for t in tests if any(isinstance(x, SUBQUERIES) for x in walk(t))]
        self.tests = [t for t in tests if t not in self.pending]
        left = list(paths)
        for p in left:
            for part in p.parts:
                if getattr(part, "var", None) in scope.vars:
                    scope = as_entity(scope, part.var)  # type: ignore[attr-defined]
        while left:
            near = next((p for p in left if any(x.var in scope.vars for x in (*p.nodes, *p.rels) if x.var)), left[0])
            left.remove(near)
            scope = self.path(scope, near)
        scope = self.apply(scope, final=True)
        return scope

    def apply(self, scope: Scope, final: bool = False) -> Scope:
        rest = []
        for t in self.tests:
            if final or free(t) <= set(scope.vars):
                scope = scope.where(self.compile(scope).truth(t))
            else:
                rest.append(t)
        self.tests = rest
        return scope

    # -- one path

    def path(self, scope: Scope, p: Path) -> Scope:
        keep = p.var is not None
        self.kept = self.reads.get(p.var, (None, None)) if keep else (None, None)  # type: ignore[arg-type]
        nodes, rels = p.nodes, p.rels
        start = next((i for i, n in enumerate(nodes) if n.var and n.var in scope.vars), None)
        known = None if start is not None else next((i for i, r in enumerate(rels) if self.has_ends(scope, r)), None)
        start = start or known or 0
        ids: dict[int, str] = {}
        structs: dict[int, str] = {}
        hops: dict[int, tuple[str, str | None]] = {}  # rel number -> (column of relationship structs, column of inner node structs)
        if known is None:
            scope, ids[start], structs[start] = self.first(scope, nodes[start], rels, start, keep)
        else:
            scope, ids[start], structs[start] = self.end_of(scope, nodes[start], rels[start], keep)
        scope = self.apply(scope)
        for i in range(start, len(rels)):
            pairs = self.pairs(nodes[i - 1 : i + 2], rels[i - 1 : i + 1]) if i > start and known is None and not any(x.props for x in (*nodes[: i + 1], *rels[:i])) else (0, 0)
            scope, ids[i + 1], structs[i + 1], hops[i] = self.hop(scope, ids[i], rels[i], nodes[i + 1], False, keep, nodes[i], pairs)
            scope = self.apply(scope)
        for i in range(start - 1, -1, -1):
            scope, ids[i], structs[i], hops[i] = self.hop(scope, ids[i + 1], rels[i], nodes[i], True, keep, nodes[i + 1])
            scope = self.apply(scope)
        return self.named(scope, p, structs, hops) if keep else scope

    def named(self, scope: Scope, p: Path, structs: dict[int, str], hops: dict) -> Scope:
        df = scope.df
        kinds = {f.name: f.dataType for f in df.schema.fields}
        node_t = unify([kinds[c] for c in structs.values()] + [kinds[h[1]].elementType for h in hops.values() if h[1]])  # type: ignore[union-attr]
        rel_ts = [kinds[h[0]].elementType if isinstance(kinds[h[0]], T.ArrayType) else kinds[h[0]] for h in hops.values()]
        rel_t = unify(rel_ts) if rel_ts else T.StructType([T.StructField("_id", LONG), T.StructField("_type", T.StringType()), T.StructField("_src", LONG), T.StructField("_dst", LONG)])
        from quiver.plans.values import cast

        one = lambda c, t: F.array(cast(Val(col(c), kinds[c]), t))
        listed = lambda c, t: cast(Val(col(c), kinds[c]), T.ArrayType(t))
        node_parts, rel_parts = [one(structs[0], node_t)], []
        for i in range(len(p.rels)):
            rel, inner = hops[i]
            rel_parts.append(listed(rel, rel_t) if isinstance(kinds[rel], T.ArrayType) else one(rel, rel_t))
            if inner:
                node_parts.append(listed(inner, node_t))
            else:
                node_parts.append(one(structs[i + 1], node_t))
        rel_all = F.concat(*rel_parts) if rel_parts else F.array().cast(T.ArrayType(rel_t))
        t = T.StructType([T.StructField("nodes", T.ArrayType(node_t)), T.StructField("relationships", T.ArrayType(rel_t))])
        name = fresh(p.var or "path")
        df = df.withColumn(name, F.struct(F.concat(*node_parts).alias("nodes"), rel_all.alias("relationships")))
        return Scope(df, {**scope.vars, p.var: Binding("value", {"": (name, t)})})  # type: ignore[dict-item]

    # -- nodes

    def needed(self, n: NodePattern, keep: bool) -> bool:
        return keep or n.props is not None or (n.var is not None and n.var in self.used)

    def first(self, scope: Scope, n: NodePattern, rels: tuple[RelPattern, ...], at: int, keep: bool) -> tuple[Scope, str, str]:
        if n.var and n.var in scope.vars:
            return self.rebound(scope, n, keep)
        among, sure = None, False
        if rels and at == 0 and rels[0].direction and (not rels[0].varlen or (rels[0].low or 0) > 0):
            # The first edge table may promise the labels, so that it is the scan itself.
            among = self.graph.ends(rels[0].types, rels[0].direction > 0)
            sure = not rels[0].varlen and among is not None and label_verdict(n.labels, among, frozenset()) is True
        if sure and not self.needed(n, keep) and self.graph.edge_tables(rels[0].types):
            marker = fresh(f"{n.var or 'n'}@_id")
            self.deferred = marker
            vars_ = {**scope.vars, n.var: Binding("node", {"_id": (marker, LONG)}, among)} if n.var else scope.vars
            return replace(scope, vars=vars_), marker, marker
        df, b = bind_frame(self.graph.scan_nodes(n.labels, among), n.var or "n", "node", self.graph.known_labels(n.labels, among))
        base = scope.df if not scope.unit else None
        joined = df if base is None else base.crossJoin(df)
        out = Scope(joined, {**scope.vars, n.var: b} if n.var else dict(scope.vars))
        out = self.inline(out, b, n.props)
        return self.struct(out, b, keep)

    def has_ends(self, scope: Scope, r: RelPattern) -> bool:
        """Whether bound relationships tell where the pattern begins."""
        b = scope.vars.get(r.var) if r.var else None
        return b is not None and (isinstance(b.val().type, T.ArrayType) if r.varlen else b.kind == "relationship")

    def end_of(self, scope: Scope, n: NodePattern, r: RelPattern, keep: bool) -> tuple[Scope, str, str]:
        """Bind the node before bound relationships by the first of them; only empty lists meet every node."""
        at = fresh(f"{n.var or 'n'}@_id")
        among = self.graph.ends(r.types, r.direction > 0) if r.direction else None
        own = scope.vars[r.var].val()  # type: ignore[index]
        df = scope.df
        if r.varlen and isinstance(own.type.elementType, T.LongType):  # type: ignore[attr-defined]
            key = fresh("_id")
            df = df.join(self.edges(r, False).select(col("_id").alias(key), col("_from").alias(at)), F.try_element_at(own.col, F.lit(1)) == col(key), "inner").drop(key)
        else:
            one = F.try_element_at(own.col, F.lit(1)) if r.varlen else own.col
            ends = [one["_src"]] * (r.direction >= 0) + [one["_dst"]] * (r.direction <= 0)
            df = df.withColumn(at, F.explode(F.array_distinct(F.array(*ends))))
        if r.varlen and not r.low:
            among = None
            rest = scope.df.where(F.size(own.col) == 0).crossJoin(self.graph.scan_nodes(n.labels).select(col("_id").alias(at)))
            df = df.union(rest.select(*[col(c) for c in df.columns]))
        return self.arrive(replace(scope, df=df), at, n, among, keep, False)

    def rebound(self, scope: Scope, n: NodePattern, keep: bool) -> tuple[Scope, str, str]:
        b = scope.vars[n.var]  # type: ignore[index]
        if b.kind != "node":
            raise CypherError("VariableTypeConflict", f"{n.var} is no node")
        if n.labels is not None and "_labels" in b.fields:
            scope = scope.where(label_test(n.labels, col(b.fields["_labels"][0])))
        scope = self.inline(scope, b, n.props)
        return self.struct(scope, b, keep)

    def struct(self, scope: Scope, b: Binding, keep: bool) -> tuple[Scope, str, str]:
        if not keep:
            return scope, b.key, b.key
        name = fresh("node")
        return replace(scope, df=scope.df.withColumn(name, trimmed(b, self.kept[0]).col), unit=False), b.key, name

    def inline(self, scope: Scope, b: Binding, props: Node | None) -> Scope:
        """Keep rows whose fields equal the pattern's property map."""
        for key, value in self.properties(props, scope):
            own = b.get(key)
            test = equal(own, value) if own is not None and not key.startswith("_") else F.lit(False)
            scope = scope.where(test)
        return scope

    def properties(self, props: Node | None, scope: Scope) -> list[tuple[str, Val]]:
        if props is None:
            return []
        compiler = self.compile(scope)
        if isinstance(props, MapLit):
            return [(k, compiler(v)) for k, v in props.items]
        if isinstance(props, Param):
            v = compiler(props)
            if kind(v.type) != "map":
                raise CypherError("InvalidParameterUse", f"${props.name} is no map")
            return [(f, compiler.property(v, f)) for f in v.fields if f]
        raise CypherError("InvalidParameterUse", "properties are a map or a parameter")

    # -- hops

    def unfit(self, scope: Scope, r: RelPattern, before: NodePattern, after: NodePattern) -> tuple[EdgeTable, ...]:
        """Edge tables of a directed pattern (before)-[r]->(after) that can't join such nodes."""
        if not r.direction or r.varlen:
            return ()
        a, z = ((n.labels, scope.vars[n.var].labels if n.var in scope.vars and scope.vars[n.var].kind == "node" else None) for n in (before, after))
        return tuple(t for t in self.graph.edge_tables(r.types) if not self.graph.joins(t, *((a, z) if r.direction > 0 else (z, a))))

    def pairs(self, nodes: tuple[NodePattern, ...], rels: tuple[RelPattern, ...]) -> tuple[int, int]:
        """Rows of (a)-[]->(hub)<-[]-(b), or the other way, and hubs, from the tables' sizes; 0 if a hub has few edges or sizes aren't known."""
        r, s = rels
        if r.varlen or s.varlen or not r.direction or r.direction != -s.direction:
            return 0, 0
        counts = []
        for x, (a, z) in ((r, nodes[:2]), (s, nodes[1:])):
            without = self.unfit(Scope(None, {}), x, a, z)  # type: ignore[arg-type]
            counts.append([row_count(t.df) for t in self.graph.edge_tables(x.types) if not any(t is w for w in without)])
            among = self.graph.ends(x.types, (x.direction > 0) is (x is s), without)
        if None in counts[0] + counts[1]:
            return 0, 0
        hubs = [row_count(t.df) for t, _ in self.graph.node_tables(nodes[1].labels, among)]
        if None in hubs or not sum(hubs) or sum(counts[1]) < HUB * sum(hubs):
            return 0, 0
        return sum(counts[0]) * sum(counts[1]) // sum(hubs), sum(hubs)

    def edges(self, r: RelPattern, backwards: bool, without: tuple[EdgeTable, ...] = ()) -> DataFrame:
        """Edges with _from and _to as the hop walks them; undirected ones both ways, loops once."""
        e = self.graph.scan_edges(r.types, without)
        out = e.withColumns({"_from": col("_src"), "_to": col("_dst")})
        back = e.withColumns({"_from": col("_dst"), "_to": col("_src")})
        direction = -r.direction if backwards else r.direction
        if direction == 0:
            return out.union(back.where(col("_src") != col("_dst")))
        return out if direction > 0 else back

    def hop(self, scope: Scope, at: str, r: RelPattern, n: NodePattern, backwards: bool, keep: bool, came: NodePattern, pairs: tuple[int, int] = (0, 0)) -> tuple[Scope, str, str, tuple[str, str | None]]:
        """One edge further; pairs: rows to come of it, if by far more than there were, and nodes that they meet in."""
        if r.varlen:
            return self.walk(scope, at, r, n, backwards, keep)
        unfit = self.unfit(scope, r, *((n, came) if backwards else (came, n)))
        frame, b = bind_frame(self.edges(r, backwards, unfit), r.var or "r", "relationship")
        start, to = b.fields["_from"][0], b.fields["_to"][0]
        own = Binding("relationship", {k: v for k, v in b.fields.items() if k not in ("_from", "_to")})
        tests: list[Column] = []
        if getattr(self, "deferred", None) == at:
            self.deferred = None
            frame = frame.withColumn(at, col(start))
            df = frame if scope.unit else scope.df.crossJoin(frame)
            scope = replace(scope, df=df, unit=False)
            joined = True
        else:
            tests.append(col(at) == col(start))
            joined = False
        if r.var and r.var in scope.vars:
            old = scope.vars[r.var]
            if old.kind != "relationship":
                raise CypherError("VariableTypeConflict", f"{r.var} is no relationship")
            tests.append(col(old.key) == col(own.key))
        bound = n.var is not None and n.var in scope.vars
        if bound:
            scope = as_entity(scope, n.var)  # type: ignore[arg-type]
            tests.append(col(scope.vars[n.var].key) == col(to))  # type: ignore[index]
        types = frozenset(t.type for t in self.graph.edge_tables(r.types))
        tests += [col(c) != col(own.key) for c, ts in self.single if ts & types]
        tests += [~F.array_contains(col(c), col(own.key)) for c in self.many]
        direction = -r.direction if backwards else r.direction
        among = self.graph.ends(r.types, direction < 0, unfit) if direction else None
        if not direction:
            a, z = self.graph.ends(r.types, True), self.graph.ends(r.types, False)
            among = a if a == z else None
        early = None
        if pairs[0] > PAIRS and not bound and n.props is None:
            # Rows multiply here: the far node joins the edges before, and each hub's rows are dealt over many tasks.
            far, here, shape = self.arrive(Scope(frame), to, n, among, keep, False)
            early, frame = (far.vars, here, shape), far.df
            parts, salt, other = -(-pairs[0] // PAIRS), fresh("salt"), fresh("salt")
            salts = -(-parts // pairs[1])
            left = scope.df.withColumn(salt, F.pmod(F.xxhash64(*[col(c) for c, _ in self.single]), F.lit(salts)))
            scope = replace(scope, df=left.repartition(parts, col(at), col(salt)))
            frame = frame.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))).repartition(parts, col(start), col(other)).hint("merge")
            tests.insert(1, col(salt) == col(other))
        test = None
        for t in tests:
            test = t if test is None else test & t
        df = scope.df if joined else scope.df.join(frame, test, "inner")
        if joined and test is not None:
            df = df.where(test)
        scope = Scope(df, {**scope.vars, r.var: own} if r.var and r.var not in scope.vars else dict(scope.vars))
        self.single.append((own.key, types))
        scope = self.inline(scope, own, r.props)
        rel = own.key
        if keep:
            rel = fresh("rel")
            scope = replace(scope, df=scope.df.withColumn(rel, trimmed(own, self.kept[1]).col))
        if early is None:
            scope, here, shape = self.arrive(scope, to, n, among, keep, bound)
        else:
            vars_, here, shape = early
            scope = replace(scope, vars={**scope.vars, **vars_})
        return scope, here, shape, (rel, None)

    def arrive(self, scope: Scope, to: str, n: NodePattern, among: frozenset[str] | None, keep: bool, bound: bool) -> tuple[Scope, str, str]:
        """Bind the node that a hop reaches."""
        if bound:
            return self.rebound(scope, n, keep)
        sure = n.labels is None or (among is not None and label_verdict(n.labels, among, frozenset()) is True)
        if sure and not self.needed(n, keep):
            vars_ = {**scope.vars, n.var: Binding("node", {"_id": (to, LONG)}, among)} if n.var else dict(scope.vars)
            return Scope(scope.df, vars_), to, to
        df, b = bind_frame(self.graph.scan_nodes(n.labels, among), n.var or "n", "node", self.graph.known_labels(n.labels, among))
        scope = Scope(scope.df.join(df, col(to) == col(b.key), "inner"), {**scope.vars, n.var: b} if n.var else dict(scope.vars))
        scope = self.inline(scope, b, n.props)
        return self.struct(scope, b, keep)

    # -- variable length

    def walk(self, scope: Scope, at: str, r: RelPattern, n: NodePattern, backwards: bool, keep: bool) -> tuple[Scope, str, str, tuple[str, str | None]]:
        """Walks of low to high edges, no edge twice.

        Up to UNROLL edges the plan has one join a hop: from the hop on whose walks count, they stay beside
        their continuations.  Longer ones are checkpointed hop by hop, and end when a hop finds nothing.
        """
        low, high = r.low or 0, r.high if r.high is not None and r.high >= 0 else None
        last = self.cap if high is None else high
        edges = self.edges(r, backwards)
        fields = [f for f in edges.columns if f not in ("_from", "_to")]
        for key, value in self.properties(r.props, scope):
            own = Val(col(key), edges.schema[key].dataType) if key in edges.columns else None
            edges = edges.where(equal(own, value) if own is not None else F.lit(False))
        list_wanted = keep or (r.var is not None and r.var in self.used) or (r.var is not None and r.var in scope.vars)
        if not list_wanted:
            edges = edges.select("_id", "_from", "_to")
        if self.kept[1] is not None and not (r.var is not None and (r.var in self.used or r.var in scope.vars)):
            fields = [f for f in fields if f.startswith("_") or f in self.kept[1]]
        rel_t = T.StructType([edges.schema[f] for f in fields if f in edges.columns])
        direction = -r.direction if backwards else r.direction
        reached = self.graph.ends(r.types, direction < 0)
        if not direction and reached != self.graph.ends(r.types, True):
            reached = None
        node_frame = self.graph.scan_nodes(None, reached) if keep else None
        if node_frame is not None and self.kept[0] is not None:
            node_frame = node_frame.select(*[col(f) for f in node_frame.columns if f.startswith("_") or f in self.kept[0]])
        node_t = T.StructType(node_frame.schema.fields) if node_frame is not None else None
        here, ids, rels, mids = fresh("at"), fresh("ids"), fresh("rels"), fresh("mids")
        level = scope.df.withColumns({here: col(at), ids: F.array().cast("array<bigint>"), rels: F.array().cast(T.ArrayType(rel_t)) if list_wanted else F.lit(None).cast("string"), mids: F.array().cast(T.ArrayType(node_t)) if keep else F.lit(None).cast("string")})
        kept = level.columns
        listed = None
        if r.var and r.var in scope.vars:
            old = scope.vars[r.var].val()
            listed = old.col if isinstance(old.type.elementType, T.LongType) else F.transform(old.col, lambda x: x["_id"])  # type: ignore[attr-defined]

        def step(walks: DataFrame, stay: Column | None, depth: int) -> DataFrame:
            """The walks with one more edge, and beside them those that stay; a bound list names the edge."""
            named = {c: fresh(c) for c in edges.columns}
            e = edges.select(*[col(c).alias(x) for c, x in named.items()])
            on = (col(here) == col(named["_from"])) & ~F.array_contains(col(ids), col(named["_id"]))
            if listed is not None:
                on = on & (F.try_element_at(listed, F.lit(-depth if backwards else depth)) == col(named["_id"]))
            goes = fresh("goes")
            if stay is None:
                out = walks.join(e, on)
            else:
                out = walks.withColumn(goes, F.explode(stay)).join(e, on & col(goes), "left")
                out = out.where(~col(goes) | col(named["_id"]).isNotNull())
            change = {ids: F.concat(col(ids), F.array(col(named["_id"])))}
            if list_wanted:
                one = F.struct(*[col(named[f]).alias(f) for f in fields])
                change[rels] = F.concat(F.array(one), col(rels)) if backwards else F.concat(col(rels), F.array(one))
            if keep:
                # Nodes between and at the walk's far end, in order of the path.
                nf, nb = bind_frame(node_frame, "mid", "node")  # type: ignore[arg-type]
                out = out.join(nf, col(named["_to"]) == col(nb.key), "inner" if stay is None else "left")
                if stay is not None:
                    out = out.where(~col(goes) | col(nb.key).isNotNull())
                one = nb.val().col
                change[mids] = F.concat(F.array(one), col(mids)) if backwards else F.concat(col(mids), F.array(one))
            change[here] = col(named["_to"])
            if stay is not None:
                change = {c: F.when(col(goes), x).otherwise(col(c)) for c, x in change.items()}
            return out.withColumns(change).select(*[col(c) for c in kept])

        if high is not None and high <= UNROLL:
            for depth in range(1, last + 1):
                goes_on = F.when(F.size(col(ids)) == depth - 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
                level = step(level, goes_on if depth > low else None, depth)
            df = level if last >= low else level.where(F.lit(False))
        else:
            out = [level] if low == 0 else []
            for depth in range(1, last + 1):
                level = self.checkpoint(step(level, None, depth))
                if level.isEmpty():
                    break
                if depth >= low:
                    out.append(level)
            else:
                if high is None and not step(level, None, last + 1).isEmpty():
                    self.warnings.append(f"WALK_CAP_REACHED: walks of over {self.cap} edges are left out")
            df = out[0] if out else level.where(F.lit(False))
            for more in out[1:]:
                df = df.union(more)
        self_ids = ids
        for c, _ in self.single:
            df = df.where(~F.array_contains(col(self_ids), col(c)))
        for c in self.many:
            df = df.where(~F.arrays_overlap(col(self_ids), col(c)) | (F.size(col(c)) == 0) | (F.size(col(self_ids)) == 0))
        self.many.append(self_ids)
        vars_ = dict(scope.vars)
        if listed is not None:
            df = df.where(listed == F.transform(col(rels), lambda x: x["_id"]))
        elif r.var and list_wanted:
            vars_[r.var] = Binding("value", {"": (rels, T.ArrayType(rel_t))})
        elif r.var:
            # Only ids, in the pattern's order.
            name = fresh(r.var)
            df = df.withColumn(name, F.reverse(col(ids)) if backwards else col(ids))
            vars_[r.var] = Binding("value", {"": (name, T.ArrayType(LONG))})
        scope = Scope(df, vars_)
        bound = n.var is not None and n.var in scope.vars
        if bound:
            scope = scope.where(col(scope.vars[n.var].key) == col(here))  # type: ignore[index]
        if low == 0 and reached is not None:
            # Such a walk may end where it starts.
            start = next((b.labels for b in scope.vars.values() if b.kind == "node" and b.key == at), None)
            reached = (reached & (start or frozenset())) or None
        scope, place, shape = self.arrive(scope, here, n, reached, keep, bound)
        if keep and backwards:
            # mids runs from the far end to the node before the start; the path lists what follows its own start.
            scope = replace(scope, df=scope.df.withColumn(mids, F.slice(F.concat(col(mids), F.array(self._node_of(scope, at, node_t))), 2, F.size(col(mids)))))
        return scope, place, shape, (rels, mids if keep else None)

    def _node_of(self, scope: Scope, at: str, t: T.StructType | None) -> Column:
        """The struct of the bound node whose id column is at."""
        from quiver.plans.values import cast

        for b in scope.vars.values():
            if b.kind == "node" and b.key == at:
                return cast(trimmed(b, self.kept[0]), t)  # type: ignore[arg-type]
        return F.lit(None).cast(t)  # type: ignore[arg-type]


def trimmed(b: Binding, fields: frozenset[str] | None) -> Val:
    """The entity with no more than these properties."""
    return b.val() if fields is None else replace(b, fields={f: x for f, x in b.fields.items() if f.startswith("_") or f in fields}).val()


def path_reads(clauses) -> dict[str, Reads]:
    """What a query reads of its paths, where that is only lengths, sizes and properties inside list comprehensions."""
    from quiver.plans.ast import Call, Comprehension, Projection, children

    found: dict[str, list[set[str] | None]] = {}

    def part(e) -> tuple[str, int] | None:
        """The variable, and whether its nodes (0) or relationships (1) are listed."""
        if isinstance(e, Call) and e.name in ("nodes", "relationships") and len(e.args) == 1 and isinstance(e.args[0], Var):
            return e.args[0].name, int(e.name != "nodes")
        return None

    def properties(e, var: str) -> set[str] | None:
        if isinstance(e, Prop) and e.base == Var(var):
            return {e.key}
        if isinstance(e, Var) and e.name == var or getattr(e, "var", None) == var:
            return None
        parts = [properties(c, var) for c in children(e)]
        return None if None in parts else set().union(*parts)  # type: ignore[arg-type]

    def go(e) -> bool:
        """Whether all is told apart; a star reads everything."""
        if isinstance(e, Projection) and e.star:
            return False
        if isinstance(e, Var):
            found[e.name] = [None, None]
            return True
        rest = list(children(e))
        if isinstance(e, Call) and e.name == "length" and len(e.args) == 1 and isinstance(e.args[0], Var):
            found.setdefault(e.args[0].name, [set(), set()])
            rest = []
        elif isinstance(e, Call) and e.name == "size" and len(e.args) == 1 and part(e.args[0]):
            found.setdefault(part(e.args[0])[0], [set(), set()])  # type: ignore[index]
            rest = []
        elif isinstance(e, Comprehension) and (at := part(e.source)):
            rest = [x for x in (e.where, e.body) if x is not None]
            own = found.setdefault(at[0], [set(), set()])
            parts = [properties(x, e.var) for x in rest] if e.body is not None else [None]
            own[at[1]] = None if None in parts or own[at[1]] is None else own[at[1]].union(*parts)  # type: ignore[union-attr, arg-type]
        return all([go(c) for c in rest])

    if not all([go(c) for c in clauses]):
        return {}
    return {k: (None if a is None else frozenset(a), None if z is None else frozenset(z)) for k, (a, z) in found.items()}


def field_readers(clauses) -> set[str]:
    """Variables of which a query reads more than identity: all but those only counted or compared by id."""
    from quiver.plans.ast import Call, Node as N, NodePattern as NP, Path as P, Projection, RelPattern as RP, children

    out: set[str] = set()

    def go(e) -> None:
        if isinstance(e, Projection) and e.star:
            out.add("*")
        if isinstance(e, Call) and e.name in ("count", "id", "elementid") and len(e.args) == 1 and isinstance(e.args[0], Var):
            return
        if isinstance(e, Var):
            out.add(e.name)
        if isinstance(e, (NP, RP, P)):
            for c in children(e):
                go(c)
            return
        if isinstance(e, N):
            for c in children(e):
                go(c)

    for c in clauses:
        go(c)
    return out


__all__ = ["Compiler", "Labels", "Matcher", "Prop", "field_readers"]
