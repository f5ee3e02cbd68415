"""Aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.graph import col
from quiver.plans.ast import Call, CypherError, Var
from quiver.plans.scope import Scope
from quiver.plans.values import DOUBLE, LONG, NULL, Val, identity, kind, mixed, null_of, numeric, order_key


def aggregate(e: Call, scope: Scope, compile_: Callable, put: Callable[[Column], str], rank: Callable[[], Column] | None = None) -> Val:
    """The aggregate as a column over groups of the scope's rows; put names a column of those rows.

    rank gives the place of a row within its group, where the rows are ordered.
    """
    name = e.name
    if e.star:
        if name != "count":
            raise CypherError("InvalidAggregation", f"no {name}(*)")
        if e.distinct:
            return Val(F.count_distinct(F.struct(*[identity(Val(col(b.key), b.fields[""][1])) if b.kind == "value" else col(b.key) for b in scope.vars.values()])), LONG)
        return Val(F.count(F.lit(1)), LONG)
    low = 2 if name.startswith("percentile") else 1
    if len(e.args) != low:
        raise CypherError("InvalidNumberOfArguments", f"{name}() takes {low} arguments")
    arg = e.args[0]
    if isinstance(arg, Var) and name == "count" and arg.name in scope.vars:
        b = scope.vars[arg.name]
        c = col(b.key)
        if b.kind != "value" or not (isinstance(b.fields[""][1], T.StructType) or mixed(b.fields[""][1])):
            return Val(F.count_distinct(c) if e.distinct else F.count(c), LONG)
    v = compile_(arg)
    k = kind(v.type)
    if name == "count":
        return Val(F.count_distinct(identity(v)) if e.distinct else F.count(v.col), LONG)
    if name in ("collect", "collect_list"):
        if k == "null":
            return Val(F.array().cast("array<string>"), T.ArrayType(NULL))
        return Val(collected(v, e.distinct, rank() if rank else None), T.ArrayType(v.type))
    if k == "null":
        return Val(F.max(F.lit(None).cast("double")), DOUBLE) if name not in ("min", "max") else Val(F.max(F.lit(None).cast("string")), null_of(NULL).type)
    if name in ("min", "max"):
        f = F.min if name == "min" else F.max
        key = order_key(v)
        if k in ("node", "relationship", "path", "time", "datetime", "duration", "any"):
            by = F.min_by if name == "min" else F.max_by
            return Val(by(v.col, key), v.type)
        return Val(f(v.col), v.type)
    if k == "duration" and name in ("sum", "avg"):
        parts = {f: (F.sum if name == "sum" else F.avg)(v.col[f]).cast("bigint").alias(f) for f in v.fields}
        return Val(F.struct(*parts.values()), v.type)
    if not numeric(v.type):
        raise CypherError("InvalidArgumentType", f"{name}() takes numbers, not a {k}")
    whole = k == "integer"
    if name == "sum":
        return Val(F.sum_distinct(v.col) if e.distinct else F.sum(v.col), LONG if whole else DOUBLE)
    x = v.col.cast("double")
    if name.startswith("percentile"):
        return percentile(name, x, compile_(e.args[1]), e.distinct, put)
    if e.distinct:
        # Over the set of values.
        x = F.collect_set(x)
        n = F.size(x)
        total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        mean = F.when(n > 0, total / F.greatest(n, F.lit(1)))
        if name == "avg":
            return Val(mean, DOUBLE)
        square = F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - total / F.greatest(n, F.lit(1))) * (b - total / F.greatest(n, F.lit(1))))
        sample = name in ("stdev", "stdev_samp")
        return Val(F.when(n > (1 if sample else 0), F.sqrt(square / F.greatest(n - 1 if sample else n, F.lit(1)))), DOUBLE)
    plain: dict[str, Callable[[Column], Column]] = {"avg": F.avg, "stdev": F.stddev_samp, "stdev_samp": F.stddev_samp, "stdevp": F.stddev_pop, "stdev_pop": F.stddev_pop}
    return Val(plain[name](x), DOUBLE)


def collected(v: Val, distinct: bool, rank: Column | None) -> Column:
    """The values that aren't null as a list, in the order of the rank if there is one."""
    if rank is None and not (distinct and mixed(v.type)):
        return F.collect_set(v.col) if distinct else F.collect_list(v.col)
    rank = F.lit(0) if rank is None else rank
    rows = F.collect_list(F.when(v.col.isNotNull(), F.struct(rank.alias("at"), v.col.alias("x"), *([identity(v).alias("key")] if mixed(v.type) else []))))
    # Structs with variants have no order of their own.
    rows = F.array_sort(rows, lambda a, b: (a["at"] - b["at"]).cast("int")) if mixed(v.type) else F.sort_array(rows)
    if distinct and mixed(v.type):
        keys = F.transform(rows, lambda r: r["key"])
        rows = F.filter(rows, lambda r, i: F.array_position(keys, r["key"]) == i + 1)
    found = F.transform(rows, lambda r: r["x"])
    return F.array_distinct(found) if distinct and not mixed(v.type) else found


def percentile(name: str, x: Column, p: Val, distinct: bool, put: Callable[[Column], str]) -> Val:
    if kind(p.type) == "null":
        return Val(F.max(F.lit(None).cast("double")), DOUBLE)
    if not p.known:
        raise CypherError("NonConstantExpression", "the percentile must be constant")
    if not 0 <= float(p.const) <= 1:
        raise CypherError("NumberOutOfRange", f"{p.const} is no percentile")
    if distinct:
        raise CypherError("InvalidAggregation", f"no DISTINCT in {name}()")
    if name in ("percentilecont", "percentile_cont"):
        return Val(F.percentile(x, F.lit(float(p.const))), DOUBLE)
    # The least value whose share of the sorted values reaches p.
    return Val(F.expr(f"percentile_disc({float(p.const)!r}) within group (order by `{put(x)}`)").cast("double"), DOUBLE)
