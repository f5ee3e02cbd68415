"""String, number, list and conversion functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions import temporal
from quiver.functions.registry import ARITY, FUNCTIONS, function, need, of_kind, raise_if, simple
from quiver.plans.ast import CypherError
from quiver.plans.values import BOOL, DOUBLE, LONG, NULL, STRING, Val, cast, kind, literal, null_of, record, unify

S, N, I = ("string",), ("integer", "float"), ("integer",)

# -- strings

for _n, _f in {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim}.items():
    simple(_n, _f, STRING, S)
for _n in ("char_length", "character_length"):
    simple(_n, lambda s: F.char_length(s).cast("bigint"), LONG, S)
simple("left", lambda s, n: F.left(s, n.cast("int")), STRING, S, I)
simple("right", lambda s, n: F.right(s, n.cast("int")), STRING, S, I)
simple("replace", F.replace, STRING, S, S, S)
simple("split", lambda s, d: F.when(d == "", F.split(s, "")).otherwise(F.split(s, F.concat(F.lit(r"\Q"), d, F.lit(r"\E")))), T.ArrayType(STRING), S, S, strict=True)


@function("btrim", args=(1, 2))
def btrim(s: Val, chars: Val | None = None) -> Val:
    if not of_kind(s, "string"):
        return null_of(STRING)
    return Val(F.btrim(s.col, chars.col) if chars else F.btrim(s.col), STRING)


@function("normalize", args=(1, 2))
def normalize(s: Val, form: Val | None = None) -> Val:
    name = form.const if form else "NFC"
    if name not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise CypherError("InvalidArgumentValue", f"no normal form {name}")

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.normalize(name)

    return Val(run(s.col), STRING) if of_kind(s, "string") else null_of(STRING)


@function("reverse", args=1)
def reverse(v: Val) -> Val:
    need("reverse", v, "string", "list")
    return Val(F.reverse(v.col), v.type)


@function("substring", args=(2, 3))
def substring(s: Val, start: Val, size: Val | None = None) -> Val:
    if not of_kind(s, "string"):
        return null_of(STRING)
    n = F.char_length(s.col)
    at = F.when(start.col < 0, F.greatest(n + start.col, F.lit(0))).otherwise(start.col).cast("int")
    length = n if size is None else F.greatest(size.col, F.lit(0)).cast("int")
    return Val(F.substring(s.col, at + 1, length), STRING)


@function("randomuuid", args=0)
def random_uuid() -> Val:
    return Val(F.expr("uuid()"), STRING)


# -- conversions


def text_of(v: Val) -> Column:
    k = kind(v.type)
    if k in temporal.KINDS:
        return temporal.text(v)
    if k == "float":
        # Java writes 1.0E10 from 10^7 on; so does this language's text form.
        return v.col.cast("double").cast("string")
    if k == "point":
        xy = F.concat(F.lit("point({x: "), v.col["x"].cast("string"), F.lit(", y: "), v.col["y"].cast("string"))
        return F.concat(xy, F.coalesce(F.concat(F.lit(", z: "), v.col["z"].cast("string")), F.lit("")), F.lit(", crs: '"), _crs(v.col["srid"]), F.lit("'})"))
    if k == "list" and kind(v.type.elementType) in ("integer", "float"):  # type: ignore[attr-defined]
        return F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: x.cast("string")), ", "), F.lit("]"))
    return v.col.cast("string")


def _crs(srid: Column) -> Column:
    return F.when(srid == 4326, "wgs-84").when(srid == 4979, "wgs-84-3d").when(srid == 9157, "cartesian-3d").otherwise("cartesian")


SCALAR = ("string", "integer", "float", "boolean")


def _converter(name: str, allowed: tuple[str, ...], out: T.DataType, f) -> None:
    def strict(v: Val) -> Val:
        need(name, v, *allowed)
        return Val(f(v), out) if kind(v.type) != "null" else null_of(out)

    def lenient(v: Val) -> Val:
        return Val(f(v), out) if kind(v.type) in (*allowed, "any") else null_of(out)

    def listed(v: Val) -> Val:
        if kind(v.type) != "list":
            return null_of(T.ArrayType(out))
        t = v.type.elementType  # type: ignore[attr-defined]
        return Val(F.transform(v.col, lambda x: lenient(Val(x, t)).col), T.ArrayType(out))

    low = name.lower()
    for n, g in ((low, strict), (low + "ornull", lenient), (low + "list", listed)):
        FUNCTIONS[n] = g
        ARITY[n] = (1, 1)


def _integer(v: Val) -> Column:
    k = kind(v.type)
    if k == "string":
        return F.coalesce(v.col.try_cast("bigint"), v.col.try_cast("double").try_cast("bigint"))
    return v.col.try_cast("bigint") if k != "any" else F.try_variant_get(v.col, "$", "bigint")


def _float(v: Val) -> Column:
    return F.try_variant_get(v.col, "$", "double") if kind(v.type) == "any" else v.col.try_cast("double")


def _boolean(v: Val) -> Column:
    k = kind(v.type)
    if k == "boolean":
        return v.col
    if k == "integer":
        return v.col != 0
    low = F.lower(F.trim(v.col.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


_converter("toInteger", ("string", "integer", "float", "boolean"), LONG, _integer)
_converter("toFloat", ("string", "integer", "float"), DOUBLE, _float)
_converter("toBoolean", ("string", "boolean"), BOOL, _boolean)
_converter("toString", (*SCALAR, "point", "list", *temporal.KINDS), STRING, text_of)


def to_string(v: Val) -> Val:
    if kind(v.type) == "list" and kind(v.type.elementType) not in ("integer", "float"):  # type: ignore[attr-defined]
        raise CypherError("InvalidArgumentValue", "toString takes no lists")
    need("toString", v, *SCALAR, "point", "list", *temporal.KINDS)
    return Val(text_of(v), STRING) if kind(v.type) != "null" else null_of(STRING)


FUNCTIONS["tostring"] = to_string

#: Names of types in valueType().
TYPE_NAMES = {
    "null": "NULL", "boolean": "BOOLEAN", "integer": "INTEGER", "float": "FLOAT", "string": "STRING", "bytes": "BYTES", "list": "LIST", "map": "MAP",
    "node": "VERTEX", "relationship": "RELATIONSHIP", "path": "PATH", "date": "DATE", "localtime": "LOCAL TIME", "time": "ZONED TIME",
    "localdatetime": "LOCAL DATETIME", "datetime": "ZONED DATETIME", "duration": "DURATION", "point": "POINT", "any": "ANY",
}


@function("valuetype", args=1)
def value_type(v: Val) -> Val:
    name = TYPE_NAMES[kind(v.type)]
    if isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.FloatType):
        name = "VECTOR"
    if kind(v.type) == "any":
        of = F.regexp_extract(F.schema_of_variant(v.col), r"^\w+", 0)
        found = F.when(v.col.isNull() | (of == "VOID"), "NULL").when(of.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "INTEGER").when(of.isin("DOUBLE", "FLOAT", "DECIMAL"), "FLOAT")
        found = found.when(of == "OBJECT", "MAP").when(of == "ARRAY", "LIST").when(of == "TIMESTAMP_NTZ", "LOCAL DATETIME").when(of == "BINARY", "BYTES")
        return Val(found.otherwise(of), STRING)
    return Val(F.when(v.col.isNull(), F.lit("NULL")).otherwise(F.lit(name)), STRING) if kind(v.type) != "null" else literal("NULL")


@function("nullif", args=2)
def null_if(a: Val, b: Val) -> Val:
    from quiver.plans.values import equal

    return Val(F.when(F.coalesce(equal(a, b), F.lit(False)), F.lit(None)).otherwise(a.col), a.type)


@function("coalesce", args=(1, 99))
def coalesce(*values: Val) -> Val:
    t = unify([v.type for v in values])
    return Val(F.coalesce(*[cast(v, t) for v in values]), t)


@function("exists", args=1)
def exists(v: Val) -> Val:
    return Val(v.col.isNotNull(), BOOL) if kind(v.type) != "null" else literal(False)


@function("isempty", args=1)
def is_empty(v: Val) -> Val:
    if of_kind(v, "string"):
        return Val(v.col == "", BOOL)
    if of_kind(v, "list"):
        return Val(F.when(v.col.isNotNull(), F.size(v.col) == 0), BOOL)
    return null_of(BOOL)


# -- numbers


@function("abs", args=1)
def abs_(v: Val) -> Val:
    need("abs", v, *N)
    return Val(F.abs(v.col), v.type)


simple("sign", lambda x: F.signum(x.cast("double")).cast("bigint"), LONG, N)
for _n in ("ceil", "ceiling"):
    simple(_n, lambda x: F.ceil(x.cast("double")).cast("double"), DOUBLE, N)
simple("floor", lambda x: F.floor(x.cast("double")).cast("double"), DOUBLE, N)
simple("isnan", lambda x: F.isnan(x.cast("double")), BOOL, N)
for _n, _f in {
    "sqrt": F.sqrt, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "cot": F.cot,
    "degrees": F.degrees, "radians": F.radians,
}.items():
    simple(_n, lambda x, f=_f: f(x.cast("double")), DOUBLE, N)
for _n, _b in (("log", math.e), ("ln", math.e), ("log10", 10.0)):
    # No logarithm of a negative number; of 0 minus infinity.
    simple(_n, lambda x, b=_b: F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.log(x.cast("double")) if b == math.e else F.log10(x.cast("double"))), DOUBLE, N)
simple("atan2", lambda y, x: F.atan2(y.cast("double"), x.cast("double")), DOUBLE, N, N)
simple("haversin", lambda x: (1 - F.cos(x.cast("double"))) / 2, DOUBLE, N)


@function("e", args=0)
def e() -> Val:
    return literal(math.e)


@function("pi", args=0)
def pi() -> Val:
    return literal(math.pi)


@function("rand", args=0)
def rand() -> Val:
    return Val(F.rand(), DOUBLE)


@function("round", args=(1, 3))
def round_(x: Val, precision: Val | None = None, mode: Val | None = None) -> Val:
    need("round", x, *N)
    how = str(mode.const).upper() if mode else "HALF_UP"
    digits = int(precision.const) if precision else 0
    scale = 10.0**digits
    y = x.col.cast("double") * F.lit(scale)
    size = F.abs(y)
    base = F.floor(size).cast("double")
    rest = size - base
    # round() without precision rounds ties up, towards plus infinity.
    modes = {
        "UP": F.signum(y) * F.ceil(size), "DOWN": F.signum(y) * base, "CEILING": F.ceil(y), "FLOOR": F.floor(y),
        "HALF_UP": F.floor(y + 0.5) if precision is None else F.signum(y) * F.floor(size + 0.5),
        "HALF_DOWN": F.signum(y) * F.ceil(size - 0.5),
        "HALF_EVEN": F.signum(y) * F.when(rest == 0.5, base + base % 2).otherwise(F.floor(size + 0.5)),
    }
    if how not in modes:
        raise CypherError("InvalidArgumentValue", f"no rounding mode {how}")
    return Val(modes[how].cast("double") / F.lit(scale), DOUBLE)


@function("range", args=(2, 3))
def range_(a: Val, b: Val, step: Val | None = None) -> Val:
    for v in (a, b, step):
        if v is not None:
            need("range", v, "integer")
    if step is not None and step.known and step.const == 0:
        raise CypherError("NumberOutOfRange", "the step of range() can't be 0")
    s = step.col if step is not None else F.lit(1).cast("bigint")
    some = F.when(F.signum((b.col - a.col).cast("double")) * F.signum(s.cast("double")) >= 0, F.sequence(a.col, b.col, s)).otherwise(F.array().cast("array<bigint>"))
    return Val(some if step is None or step.known else raise_if(s == 0, "NumberOutOfRange", "the step of range() can't be 0", some), T.ArrayType(LONG))


# -- lists and maps


def element(v: Val) -> T.DataType:
    return v.type.elementType if isinstance(v.type, T.ArrayType) else NULL


@function("head", args=1)
def head(v: Val) -> Val:
    need("head", v, "list")
    return Val(F.get(v.col, F.lit(0)), element(v)) if of_kind(v, "list") else null_of(NULL)


@function("last", args=1)
def last(v: Val) -> Val:
    need("last", v, "list")
    return Val(F.try_element_at(v.col, F.lit(-1)), element(v)) if of_kind(v, "list") else null_of(NULL)


@function("tail", args=1)
def tail(v: Val) -> Val:
    need("tail", v, "list")
    return Val(F.slice(v.col, 2, F.greatest(F.size(v.col), F.lit(1))), v.type) if of_kind(v, "list") else v


@function("size", args=1)
def size(v: Val) -> Val:
    k = kind(v.type)
    if k == "string":
        return Val(F.char_length(v.col).cast("bigint"), LONG)
    if k == "list":
        return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("bigint"), LONG)
    if k == "map":
        return literal(len([f for f in v.fields if f]))
    return null_of(LONG)


def property_names(v: Val) -> list[str]:
    return sorted(f for f in v.fields if f and not f.startswith("_"))


@function("keys", args=1)
def keys(v: Val) -> Val:
    if of_kind(v, "null"):
        return null_of(T.ArrayType(STRING))
    need("keys", v, "map", "node", "relationship")
    own = [F.when(v.col[f].isNotNull(), F.lit(f)) for f in property_names(v)]
    out = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
    return Val(F.when(v.col.isNotNull(), out), T.ArrayType(STRING))


@function("properties", args=1)
def properties(v: Val) -> Val:
    if of_kind(v, "null"):
        return v
    need("properties", v, "map", "node", "relationship")
    out = record({f: v.field(f) for f in property_names(v)})
    return Val(F.when(v.col.isNotNull(), out.col), out.type)


@function("labels", args=1)
def labels(v: Val) -> Val:
    need("labels", v, "node")
    return v.field("_labels") if of_kind(v, "node") else null_of(T.ArrayType(STRING))


@function("type", args=1)
def type_(v: Val) -> Val:
    need("type", v, "relationship")
    return v.field("_type") if of_kind(v, "relationship") else null_of(STRING)


@function("id", args=1)
def id_(v: Val) -> Val:
    need("id", v, "node", "relationship")
    return v.field("_id") if of_kind(v, "node", "relationship") else null_of(LONG)


@function("elementid", args=1)
def element_id(v: Val) -> Val:
    return Val(id_(v).col.cast("string"), STRING)


@function("nodes", "vertexes", args=1)
def nodes(v: Val) -> Val:
    need("nodes", v, "path")
    return v.field("nodes") if of_kind(v, "path") else null_of(T.ArrayType(NULL))


@function("relationships", "rels", "edges", args=1)
def relationships(v: Val) -> Val:
    need("relationships", v, "path")
    return v.field("relationships") if of_kind(v, "path") else null_of(T.ArrayType(NULL))


@function("length", "path_length", args=1)
def length(v: Val) -> Val:
    need("length", v, "path")
    return Val(F.when(v.col.isNotNull(), F.size(v.col["relationships"])).cast("bigint"), LONG) if of_kind(v, "path") else null_of(LONG)

