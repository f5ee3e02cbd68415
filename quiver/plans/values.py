"""Typed values: a Spark column with the type that the planner knows for it."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.plans.ast import CypherError

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
DATE, LOCALDATETIME, VARIANT = T.DateType(), T.TimestampNTZType(), T.VariantType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Values that Spark has no collectable or precise type for are structs; their field names tell them apart.
LOCALTIME = struct(day_nanos=LONG)
TIME = struct(day_nanos=LONG, offset_s=LONG)
DATETIME = struct(utc=LOCALDATETIME, zone=STRING)
DURATION = struct(months=LONG, days=LONG, seconds=LONG, nanos=LONG)
POINT = struct(srid=LONG, x=DOUBLE, y=DOUBLE, z=DOUBLE)


@dataclass
class Val:
    col: Column
    type: T.DataType
    const: Any = None  # the Python value, if known when planning
    known: bool = False

    def field(self, name: str) -> "Val":
        t = next(f.dataType for f in self.type.fields if f.name == name)  # type: ignore[attr-defined]
        return Val(self.col.getField(name), t)

    @property
    def fields(self) -> list[str]:
        return [f.name for f in self.type.fields] if isinstance(self.type, T.StructType) else []


def names(t: T.DataType) -> tuple[str, ...]:
    return tuple(f.name for f in t.fields) if isinstance(t, T.StructType) else ()


def kind(t: T.DataType) -> str:
    """The query language's name of a type."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.TimestampNTZType):
        return "localdatetime"
    if isinstance(t, T.VariantType):
        return "any"
    n = names(t)
    for name, own in (("localtime", LOCALTIME), ("time", TIME), ("datetime", DATETIME), ("duration", DURATION), ("point", POINT)):
        if n == names(own):
            return name
    if "_labels" in n:
        return "node"
    if "_src" in n:
        return "relationship"
    if n == ("nodes", "relationships"):
        return "path"
    return "map"


def numeric(t: T.DataType) -> bool:
    return kind(t) in ("integer", "float")


def unify(types: list[T.DataType]) -> T.DataType:
    """The type that holds values of all of them; mixed ones need a variant."""
    own: list[T.DataType] = []
    for t in types:
        if not isinstance(t, T.NullType) and t not in own:
            own.append(t)
    if not own:
        return NULL
    if len(own) == 1:
        return own[0]
    kinds = {kind(t) for t in own}
    if kinds <= {"integer"}:
        return LONG
    if kinds <= {"integer", "float"}:
        return DOUBLE
    if kinds == {"list"}:
        return T.ArrayType(unify([t.elementType for t in own]))  # type: ignore[attr-defined]
    if len(kinds) == 1 and kinds <= {"map", "node", "relationship"}:
        fields: dict[str, list[T.DataType]] = {}
        for t in own:
            for f in t.fields:  # type: ignore[attr-defined]
                fields.setdefault(f.name, []).append(f.dataType)
        return T.StructType([T.StructField(k, unify(v)) for k, v in fields.items()])
    return VARIANT


def cast(v: Val, t: T.DataType) -> Column:
    """The value as a wider type that unify() gave."""
    if v.type == t:
        return v.col
    if isinstance(v.type, T.NullType):
        return F.lit(None).cast(t)
    if isinstance(t, T.VariantType):
        return F.to_variant_object(v.col) if isinstance(v.type, (T.StructType, T.ArrayType)) else v.col.cast("variant")
    if isinstance(t, T.StructType) and isinstance(v.type, T.StructType):
        have = set(names(v.type))
        inner = F.struct(*[(cast(v.field(f.name), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.fields])
        return F.when(v.col.isNotNull(), inner)
    if isinstance(t, T.ArrayType) and isinstance(v.type, T.ArrayType):
        element = v.type.elementType
        return F.transform(v.col, lambda x: cast(Val(x, element), t.elementType))
    return v.col.cast(t)


def literal(value: Any) -> Val:
    """A planning-time constant."""
    if value is None:
        return Val(F.lit(None), NULL, None, True)
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, value, True)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise CypherError("IntegerOverflow", str(value))
        return Val(F.lit(value).cast("bigint"), LONG, value, True)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE, value, True)
    if isinstance(value, str):
        return Val(F.lit(value), STRING, value, True)
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), T.BinaryType(), bytes(value), True)
    if isinstance(value, datetime.datetime):
        return Val(F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz"), LOCALDATETIME, value, True)
    if isinstance(value, datetime.date):
        return Val(F.lit(value), DATE, value, True)
    if isinstance(value, (list, tuple)):
        out = array([literal(x) for x in value])
        return Val(out.col, out.type, list(value), True)
    if isinstance(value, dict):
        out = record({k: literal(v) for k, v in value.items()})
        return Val(out.col, out.type, value, True)
    raise CypherError("InvalidArgumentType", f"no such parameter type: {type(value).__name__}")


def array(items: list[Val]) -> Val:
    t = unify([x.type for x in items])
    if not items:
        return Val(F.array().cast("array<string>"), T.ArrayType(NULL), [], True)
    if isinstance(t, T.NullType):
        return Val(F.array(*[F.lit(None).cast("string") for _ in items]), T.ArrayType(NULL))
    return Val(F.array(*[cast(x, t) for x in items]), T.ArrayType(t), [x.const for x in items], all(x.known for x in items))


def record(items: dict[str, Val]) -> Val:
    if not items:
        return Val(F.struct(F.lit(None).cast("string").alias("")), T.StructType([T.StructField("", STRING)]), {}, True)
    filled = {k: (Val(F.lit(None).cast("string"), STRING, None, True) if isinstance(v.type, T.NullType) else v) for k, v in items.items()}
    t = T.StructType([T.StructField(k, v.type) for k, v in filled.items()])
    return Val(F.struct(*[v.col.alias(k) for k, v in filled.items()]), t, {k: v.const for k, v in items.items()}, all(v.known for v in items.values()))


def mixed(t: T.DataType) -> bool:
    """Whether the type has a variant somewhere, which can be neither grouped nor compared as it is."""
    if isinstance(t, T.ArrayType):
        return mixed(t.elementType)
    if isinstance(t, T.StructType):
        return any(mixed(f.dataType) for f in t.fields)
    return isinstance(t, T.VariantType)


def identity(v: Val) -> Column:
    """A column that is the same for values that are the same: for variants the kind and the text.  Whole numbers are the same as integers."""
    if not mixed(v.type):
        return v.col
    if not isinstance(v.type, T.VariantType):
        return F.to_json(F.to_variant_object(v.col))
    of = F.regexp_extract(F.schema_of_variant(v.col), r"^\w+", 0)
    whole, number = F.try_variant_get(v.col, "$", "bigint"), F.try_variant_get(v.col, "$", "double")
    digits = F.when(of.isin("DOUBLE", "FLOAT", "DECIMAL") & ((number != F.floor(number)) | (F.abs(number) >= 1 << 53)), number.cast("string")).otherwise(whole.cast("string"))
    counts = of.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")
    return F.when(v.col.isNull(), F.lit(None).cast("string")).when(counts, F.concat(F.lit("NUMBER:"), digits)).otherwise(F.concat(of, F.lit(":"), F.to_json(v.col)))


def null_of(t: T.DataType) -> Val:
    return Val(F.lit(None).cast("string" if isinstance(t, T.NullType) else t), t)


# -- equality and order, in three-valued logic


def _maybe_nan(v: Val) -> bool:
    return kind(v.type) == "float" and not (v.known and v.const == v.const)


def equal(a: Val, b: Val) -> Column:
    ka, kb = kind(a.type), kind(b.type)
    unknown = F.lit(None).cast("boolean")
    if "null" in (ka, kb):
        return unknown
    if ka == kb == "list":
        return _equal_lists(a, b)
    if ka == kb and ka in ("node", "relationship"):
        return a.field("_id").col == b.field("_id").col
    if ka == kb == "path":
        ids = [F.transform(x.col["relationships"], lambda r: r["_id"]) for x in (a, b)]
        ends = [F.transform(x.col["nodes"], lambda r: r["_id"]) for x in (a, b)]
        return (ids[0] == ids[1]) & (ends[0] == ends[1])
    if ka == kb == "map":
        if set(a.fields) != set(b.fields):
            return F.when(a.col.isNull() | b.col.isNull(), unknown).otherwise(False)
        out = F.lit(True)
        for f in a.fields:
            out = out & equal(a.field(f), b.field(f))
        return F.when(a.col.isNull() | b.col.isNull(), unknown).otherwise(out)
    if numeric(a.type) and numeric(b.type):
        out = a.col == b.col
        return out & ~F.isnan(a.col) if _maybe_nan(a) and _maybe_nan(b) else out
    if "any" in (ka, kb):
        return identity(Val(cast(a, VARIANT), VARIANT)) == identity(Val(cast(b, VARIANT), VARIANT))
    if ka == kb:
        return a.col == b.col
    return F.when(a.col.isNull() | b.col.isNull(), unknown).otherwise(False)


def _equal_lists(a: Val, b: Val) -> Column:
    ta, tb = a.type.elementType, b.type.elementType  # type: ignore[attr-defined]
    pairs = F.zip_with(a.col, b.col, lambda x, y: equal(Val(x, ta), Val(y, tb)).cast("boolean"))
    known = F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(F.forall(pairs, lambda x: x))
    return F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean")).otherwise(known)


def comparable(a: T.DataType, b: T.DataType) -> bool:
    ka, kb = kind(a), kind(b)
    return (numeric(a) and numeric(b)) or (ka == kb and ka not in ("map", "node", "relationship", "path", "point", "duration", "any"))


def order_key(v: Val) -> Column:
    """A column that sorts as the value does within its type."""
    k = kind(v.type)
    if k in ("node", "relationship"):
        return v.field("_id").col
    if k == "path":
        return F.transform(v.col["nodes"], lambda n: n["_id"])
    if k == "time":
        return v.col["day_nanos"] - v.col["offset_s"] * 1_000_000_000
    if k == "datetime":
        return v.col["utc"]
    if k == "duration":
        return v.col["months"] * 2_629_746 + v.col["days"] * 86_400 + v.col["seconds"] + v.col["nanos"] / 1e9
    if k == "any":
        text = v.col.cast("string")
        number = F.try_variant_get(v.col, "$", "double")
        of = F.regexp_extract(F.schema_of_variant(v.col), r"^\w+", 0)
        rank = F.when(of == "OBJECT", 0).when(of == "ARRAY", 3).when(of == "STRING", 5).when(of == "BOOLEAN", 6).otherwise(7)
        return F.when(v.col.isNotNull(), F.struct(rank.alias("rank"), F.when(rank == 7, number).alias("number"), text.alias("text")))
    return v.col


def compare(op: str, a: Val, b: Val) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "<>":
        return ~equal(a, b)
    if not comparable(a.type, b.type):
        return F.lit(None).cast("boolean")
    x, y = order_key(a), order_key(b)
    if kind(a.type) == "list":
        nulls = F.exists(a.col, lambda i: i.isNull()) | F.exists(b.col, lambda i: i.isNull())
        x, y = F.when(~nulls, a.col), F.when(~nulls, b.col)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    # Spark puts NaN above all numbers; here no comparison with it holds.
    high = a if op in (">", ">=") else b
    return out & ~F.isnan(high.col) if _maybe_nan(high) else out
