"""Expressions to columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions import basic, space, temporal
from quiver.functions.registry import FUNCTIONS, call
from quiver.graph import label_test
from quiver.plans.ast import (
    Binary, Call, Case, Chain, Comprehension, CypherError, Exists, Index, IsNull, LabelTest, ListLit, Lit, MapLit, Node, Param, PatternList, PatternTest,
    Prop, Quantifier, Reduce, Slice, Unary, Var, children,
)
from quiver.plans.scope import Scope
from quiver.plans.values import BOOL, DOUBLE, LONG, NULL, STRING, Val, array, cast, compare, equal, kind, literal, null_of, numeric, record, unify

AGGREGATES = frozenset(
    "count sum avg min max collect collect_list stdev stdev_samp stdevp stdev_pop percentiledisc percentile_disc percentilecont percentile_cont".split()
)
SUBQUERIES = (PatternTest, Exists, PatternList)


def has_aggregate(e: Any) -> bool:
    """Whether there is an aggregate outside subqueries."""
    if isinstance(e, tuple):
        return any(map(has_aggregate, e))
    if isinstance(e, Exists):
        return False
    return isinstance(e, Call) and e.name in AGGREGATES or any(map(has_aggregate, children(e)))


def bound_inside(e: Node) -> set[str]:
    """Variables that an expression binds for itself."""
    if isinstance(e, (Comprehension, Quantifier)):
        return {e.var}
    if isinstance(e, Reduce):
        return {e.var, e.acc}
    return set()


def free(e: Any, inner: frozenset[str] = frozenset()) -> set[str]:
    """Names of variables that an expression or pattern uses from outside."""
    from quiver.plans.ast import NodePattern, Path, RelPattern

    if isinstance(e, tuple):
        return set().union(*[free(x, inner) for x in e]) if e else set()
    if isinstance(e, Var):
        return {e.name} - inner
    own = inner | bound_inside(e) if isinstance(e, Node) else inner
    out: set[str] = set()
    if isinstance(e, (NodePattern, RelPattern)) and e.var:
        out |= {e.var} - inner
    if isinstance(e, Path) and e.var:
        own = own | {e.var}
    for c in children(e):
        out |= free(c, own)
    return out


class Compiler:
    """Compiles expressions over a scope.

    known: values of whole subtrees that were computed before (aggregates, subqueries, grouping keys).
    """

    def __init__(self, scope: Scope, params: dict[str, Any], known: dict[Node, Val] | None = None, local: dict[str, Val] | None = None) -> None:
        self.scope, self.params, self.known, self.local = scope, params, known or {}, local or {}

    def inside(self, **local: Val) -> "Compiler":
        return Compiler(self.scope, self.params, self.known, {**self.local, **local})

    def __call__(self, e: Node) -> Val:
        if self.known:
            try:
                if e in self.known:
                    return self.known[e]
            except TypeError:
                pass
        f: Callable[[Any], Val] | None = getattr(self, "on_" + type(e).__name__.lower(), None)
        if f is None:
            raise CypherError("InvalidSyntax", f"no place for {type(e).__name__} here")
        return f(e)

    # -- leaves

    def on_lit(self, e: Lit) -> Val:
        return literal(e.value)

    def on_param(self, e: Param) -> Val:
        if e.name not in self.params:
            raise CypherError("ParameterMissing", f"no parameter ${e.name}")
        return literal(self.params[e.name])

    def on_var(self, e: Var) -> Val:
        if e.name in self.local:
            return self.local[e.name]
        if e.name not in self.scope.vars:
            raise CypherError("UndefinedVariable", f"no variable {e.name}")
        return self.scope.vars[e.name].val()

    def on_listlit(self, e: ListLit) -> Val:
        return array([self(x) for x in e.items])

    def on_maplit(self, e: MapLit) -> Val:
        return record({k: self(v) for k, v in e.items})

    # -- access

    def on_prop(self, e: Prop) -> Val:
        if isinstance(e.base, Var) and e.base.name not in self.local and e.base not in self.known:
            b = self.scope.vars.get(e.base.name)
            if b is not None and b.kind != "value":
                found = b.get(e.key) if not e.key.startswith("_") else None
                return found if found is not None else null_of(NULL)
        return self.property(self(e.base), e.key)

    def property(self, v: Val, key: str) -> Val:
        k = kind(v.type)
        if k == "null":
            return v
        if k in ("node", "relationship"):
            return v.field(key) if key in v.fields and not key.startswith("_") else null_of(NULL)
        if k == "map":
            if key not in v.fields:
                return null_of(NULL)
            out = v.field(key)
            if isinstance(v.const, dict) and key in v.const and v.known:
                out.const, out.known = v.const[key], True
            return out
        if k in temporal.KINDS:
            part = temporal.accessor(v, key)
        elif k == "point":
            part = space.point_part(v, key)
        elif k == "path" and key in ("nodes", "relationships"):
            part = v.field(key)
        elif k == "any":
            return Val(F.try_variant_get(v.col, f"$.{key}", "variant"), T.VariantType())
        else:
            raise CypherError("InvalidArgumentTypePropertyAccess", f"no properties in a {k}")
        return part if part is not None else null_of(NULL)

    def on_index(self, e: Index) -> Val:
        base, at = self(e.base), self(e.at)
        k = kind(base.type)
        if k == "null" or kind(at.type) == "null":
            return null_of(NULL)
        if k in ("map", "node", "relationship"):
            if kind(at.type) != "string":
                raise CypherError("MapElementAccessByNonString", f"a key is a string, not a {kind(at.type)}")
            if at.known:
                return self.property(base, at.const)
            own = [f for f in base.fields if f and not f.startswith("_")]
            t = unify([base.field(f).type for f in own])
            out = F.lit(None).cast("string" if isinstance(t, T.NullType) else t)
            for f in own:
                out = F.when(at.col == f, cast(base.field(f), t)).otherwise(out)
            return Val(out, t)
        if k == "list":
            if kind(at.type) != "integer":
                raise CypherError("ListElementAccessByNonInteger", f"an index is an integer, not a {kind(at.type)}")
            n = F.size(base.col)
            place = F.when(at.col < 0, n + at.col).otherwise(at.col)
            return Val(F.when(place >= 0, F.get(base.col, place.cast("int"))), base.type.elementType)  # type: ignore[attr-defined]
        raise CypherError("InvalidArgumentType", f"no elements in a {k}")

    def on_slice(self, e: Slice) -> Val:
        base = self(e.base)
        k = kind(base.type)
        ends = [None if x is None else self(x) for x in (e.low, e.high)]
        if k == "null" or any(x is not None and kind(x.type) == "null" for x in ends):
            return null_of(base.type)
        n = F.char_length(base.col) if k == "string" else F.size(base.col)

        def place(x: Val | None, default: Column) -> Column:
            if x is None:
                return default
            return F.least(F.greatest(F.when(x.col < 0, n + x.col).otherwise(x.col), F.lit(0)), n).cast("int")

        low, high = place(ends[0], F.lit(0)), place(ends[1], n)
        size = F.greatest(high - low, F.lit(0))
        return Val(F.substring(base.col, low + 1, size) if k == "string" else F.slice(base.col, low + 1, size), base.type)

    # -- operators

    def truth(self, e: Node) -> Column:
        """A boolean; other types count as unknown."""
        v = self(e)
        return v.col.cast("boolean") if kind(v.type) == "boolean" else F.lit(None).cast("boolean")

    def on_unary(self, e: Unary) -> Val:
        if e.op == "not":
            return Val(~self.truth(e.arg), BOOL)
        v = self(e.arg)
        if kind(v.type) == "duration" and e.op == "-":
            return temporal.scale(v, F.lit(-1))
        if not numeric(v.type):
            return null_of(NULL)
        return v if e.op == "+" else Val(-v.col, v.type)

    def on_chain(self, e: Chain) -> Val:
        values = [self(x) for x in e.operands]
        out = None
        for op, a, b in zip(e.ops, values, values[1:], strict=False):
            c = compare(op, a, b)
            out = c if out is None else out & c
        return Val(out, BOOL)  # type: ignore[arg-type]

    def on_isnull(self, e: IsNull) -> Val:
        if isinstance(e.arg, Var) and e.arg.name not in self.local and e.arg.name in self.scope.vars:
            from quiver.graph import col

            c = col(self.scope.vars[e.arg.name].key)
        else:
            c = self(e.arg).col
        return Val(c.isNotNull() if e.negated else c.isNull(), BOOL)

    def on_binary(self, e: Binary) -> Val:
        if e.op in ("and", "or", "xor"):
            a, b = self.truth(e.left), self.truth(e.right)
            return Val({"and": a & b, "or": a | b}[e.op] if e.op != "xor" else a != b, BOOL)
        a, b = self(e.left), self(e.right)
        if e.op == "in":
            return self.contains(a, b)
        if e.op in ("starts with", "ends with", "contains"):
            if kind(a.type) != "string" or kind(b.type) != "string":
                return null_of(BOOL)
            f = {"starts with": a.col.startswith, "ends with": a.col.endswith, "contains": a.col.contains}[e.op]
            return Val(f(b.col), BOOL)
        return arithmetic(e.op, a, b)

    def contains(self, x: Val, items: Val) -> Val:
        if kind(items.type) == "null":
            return null_of(BOOL)
        if kind(items.type) != "list":
            raise CypherError("InvalidArgumentType", f"IN needs a list, not a {kind(items.type)}")
        if items.known and items.const == []:
            return literal(False)
        t = items.type.elementType  # type: ignore[attr-defined]
        if kind(x.type) == "null":
            return Val(F.when(F.size(items.col) == 0, False), BOOL)
        plain = ("string", "integer", "float", "boolean", "date")
        if kind(x.type) in plain and kind(t) in plain and (kind(x.type) == kind(t) or (numeric(x.type) and numeric(t))):
            if items.known:
                return Val(x.col.isin(*[F.lit(c) for c in items.const]), BOOL)
            return Val(F.when(F.size(items.col) == 0, False).otherwise(F.array_contains(items.col, x.col.cast(unify([x.type, t])) if x.type == t else x.col.cast(t))), BOOL) if kind(x.type) == kind(t) else Val(F.exists(items.col, lambda y: equal(x, Val(y, t))), BOOL)
        return Val(F.exists(items.col, lambda y: equal(x, Val(y, t))), BOOL)

    def on_labeltest(self, e: LabelTest) -> Val:
        v = self(e.base)
        k = kind(v.type)
        if k == "null":
            return null_of(BOOL)
        if k == "node":
            return Val(label_test(e.labels, v.col["_labels"], exact=True), BOOL)
        if k == "relationship":
            out = F.lit(False)
            for group in e.labels.any_of:
                out = out | (v.col["_type"].isin(*[x for _, x in group]) if len(group) == 1 else F.lit(False))
            return Val(out, BOOL)
        raise CypherError("InvalidArgumentType", f"no labels on a {k}")

    def on_case(self, e: Case) -> Val:
        tests = []
        operand = None if e.operand is None else self(e.operand)
        for test, then in e.whens:
            tests.append((self.truth(test) if operand is None else equal(operand, self(test)), self(then)))
        default = literal(None) if e.default is None else self(e.default)
        t = unify([v.type for _, v in tests] + [default.type])
        if isinstance(t, T.NullType):
            return literal(None)
        out = None
        for test, then in tests:
            out = F.when(test, cast(then, t)) if out is None else out.when(test, cast(then, t))
        return Val(out.otherwise(cast(default, t)), t)  # type: ignore[union-attr]

    # -- lists

    def source(self, e: Node) -> Val | None:
        v = self(e)
        if kind(v.type) == "null":
            return None
        if kind(v.type) != "list":
            raise CypherError("InvalidArgumentType", f"a list is needed, not a {kind(v.type)}")
        return v

    def on_comprehension(self, e: Comprehension) -> Val:
        v = self.source(e.source)
        if v is None:
            return null_of(T.ArrayType(NULL))
        t = v.type.elementType  # type: ignore[attr-defined]
        out = v.col
        if e.where is not None:
            where = e.where
            out = F.filter(out, lambda x: F.coalesce(self.inside(**{e.var: Val(x, t)}).truth(where), F.lit(False)))
        if e.body is None:
            return Val(out, v.type)
        body, made = e.body, []

        def one(x: Column) -> Column:
            y = self.inside(**{e.var: Val(x, t)})(body)
            made.append(y.type)
            return y.col if not isinstance(y.type, T.NullType) else F.lit(None).cast("string")

        out = F.transform(out, one)
        return Val(out, T.ArrayType(made[0]))

    def on_quantifier(self, e: Quantifier) -> Val:
        v = self.source(e.source)
        if v is None:
            return null_of(BOOL)
        t = v.type.elementType  # type: ignore[attr-defined]
        where = e.where if e.where is not None else Var(e.var)

        def test(x: Column) -> Column:
            return self.inside(**{e.var: Val(x, t)}).truth(where)

        if e.kind == "all":
            return Val(F.forall(v.col, test), BOOL)
        if e.kind == "any":
            return Val(F.exists(v.col, test), BOOL)
        if e.kind == "none":
            return Val(~F.exists(v.col, test), BOOL)
        found = F.transform(v.col, test)
        yes = F.size(F.filter(found, lambda x: F.coalesce(x, F.lit(False))))
        unknown = F.size(F.filter(found, lambda x: x.isNull()))
        return Val(F.when(v.col.isNull(), F.lit(None)).when(yes > 1, False).when(unknown > 0, F.lit(None)).otherwise(yes == 1), BOOL)

    def on_reduce(self, e: Reduce) -> Val:
        v, start = self.source(e.source), self(e.start)
        if v is None:
            return null_of(start.type)
        element = v.type.elementType  # type: ignore[attr-defined]
        # The accumulator has the type that the body gives it.
        t = start.type
        for _ in range(3):
            out, wider = self.fold(e, v, start, t, element)
            if wider == t:
                return Val(out, t)
            t = wider
        raise CypherError("InvalidArgumentType", "reduce() has no stable type")

    def fold(self, e: Reduce, v: Val, start: Val, t: T.DataType, element: T.DataType) -> tuple[Column, T.DataType]:
        """The fold with an accumulator of type t, and the type that t and the body's type need."""
        made: list[T.DataType] = []

        def step(acc: Column, x: Column) -> Column:
            y = self.inside(**{e.acc: Val(acc, t), e.var: Val(x, element)})(e.body)
            made.append(unify([t, y.type]))
            return cast(y, made[-1])

        return F.aggregate(v.col, cast(start, t), step), made[0]

    # -- calls

    def on_call(self, e: Call) -> Val:
        if e.name in AGGREGATES:
            raise CypherError("InvalidAggregation", f"{e.name}() has no place here")
        if e.name in ("startnode", "endnode", "startvertex", "endvertex") and e in self.known:
            return self.known[e]
        if e.name == "size" and len(e.args) == 1 and isinstance(e.args[0], PatternTest):
            raise CypherError("UnexpectedSyntax", "size() takes no pattern")
        values = [self(a) for a in e.args]
        return call(e.name, values)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    ka, kb = kind(a.type), kind(b.type)
    if op == "+":
        if ka == "list" and kb == "list":
            t = unify([a.type, b.type])
            return Val(F.concat(cast(a, t), cast(b, t)), t)
        if ka == "list" or kb == "list":
            return Val(*_append(a, b) if ka == "list" else _prepend(a, b))
    if "null" in (ka, kb):
        return null_of(a.type if kb == "null" else b.type)
    if op == "+" and "string" in (ka, kb) and {ka, kb} <= {"string", "integer", "float", "boolean"}:
        return Val(F.concat(basic.text_of(a), basic.text_of(b)), STRING)
    if ka in temporal.KINDS or kb in temporal.KINDS:
        return _temporal(op, a, b, ka, kb)
    if not (numeric(a.type) and numeric(b.type)):
        raise CypherError("InvalidArgumentType", f"no {ka} {op} {kb}")
    whole = ka == kb == "integer"
    if op == "^":
        return Val(F.pow(a.col.cast("double"), b.col.cast("double")), DOUBLE)
    t = LONG if whole else DOUBLE
    x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
    if op == "+":
        return Val(x + y, t)
    if op == "-":
        return Val(x - y, t)
    if op == "*":
        return Val(x * y, t)
    nonzero = b.known and b.const != 0
    if op == "/":
        if whole:  # integers stay integers; over 0 there is no integer result
            out = F.call_function("div", x, y)
            return Val(out if nonzero else F.when(y != 0, out), LONG)
        inf = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return Val(x / y if nonzero else F.when(y == 0, F.when(x.isNotNull(), inf)).otherwise(x / y), DOUBLE)
    return Val(x % y if nonzero else F.when(y != 0, x % y), t)


def _append(a: Val, b: Val) -> tuple[Column, T.DataType]:
    t = unify([a.type.elementType, b.type])  # type: ignore[attr-defined]
    own = b.type if not isinstance(t, T.NullType) else STRING
    return F.concat(cast(a, T.ArrayType(t)), F.array(cast(Val(b.col, own), t) if not isinstance(t, T.NullType) else F.lit(None).cast("string"))), T.ArrayType(t)


def _prepend(a: Val, b: Val) -> tuple[Column, T.DataType]:
    t = unify([b.type.elementType, a.type])  # type: ignore[attr-defined]
    return F.concat(F.array(cast(a, t) if not isinstance(t, T.NullType) else F.lit(None).cast("string")), cast(b, T.ArrayType(t))), T.ArrayType(t)


def _temporal(op: str, a: Val, b: Val, ka: str, kb: str) -> Val:
    if ka == kb == "duration" and op in "+-":
        return temporal.add_durations(a, b, 1 if op == "+" else -1)
    if kb == "duration" and ka in temporal.KINDS and op in "+-":
        return temporal.shift(a, b, 1 if op == "+" else -1)
    if ka == "duration" and kb in temporal.KINDS and op == "+":
        return temporal.shift(b, a, 1)
    if ka == "duration" and numeric(b.type) and op in "*/":
        return temporal.scale(a, b.col if op == "*" else 1 / b.col.cast("double"))
    if kb == "duration" and numeric(a.type) and op == "*":
        return temporal.scale(b, a.col)
    raise CypherError("InvalidArgumentType", f"no {ka} {op} {kb}")


def conjuncts(e: Node | None) -> list[Node]:
    if e is None:
        return []
    if isinstance(e, Binary) and e.op == "and":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


__all__ = ["AGGREGATES", "FUNCTIONS", "SUBQUERIES", "Compiler", "conjuncts", "free", "has_aggregate"]
