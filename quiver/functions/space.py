"""Points and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.registry import function, need, raise_if
from quiver.plans.ast import CypherError
from quiver.plans.values import BOOL, DOUBLE, LONG, POINT, Val, kind, null_of

EARTH_M = 6_371_009.0
#: Reference systems by (geographic, dimensions).
SRID = {(False, 2): 7203, (False, 3): 9157, (True, 2): 4326, (True, 3): 4979}
SRID_NAMES = {7203: "cartesian", 9157: "cartesian-3d", 4326: "wgs-84", 4979: "wgs-84-3d"}


@function("point", args=1)
def point(m: Val) -> Val:
    if kind(m.type) == "null":
        return null_of(POINT)
    need("point", m, "map")
    has = set(m.fields)
    const = m.const if isinstance(m.const, dict) else {}
    srid = const.get("srid") or {v: k for k, v in SRID_NAMES.items()}.get(str(const.get("crs", "")).lower().replace("wgs84", "wgs-84"))
    geographic = "longitude" in has or srid in (4326, 4979)
    first = lambda *ks: next((m.col[k].cast("double") for k in ks if k in has), None)
    x, y, z = first("x", "longitude"), first("y", "latitude"), first("z", "height")
    if x is None or y is None:
        raise CypherError("InvalidArgumentValue", "a point needs x and y, or longitude and latitude")
    if geographic:
        x = F.when((x > 180) | (x < -180), F.pmod(x + 180, F.lit(360.0)) - 180).otherwise(x)
        y = raise_if((y > 90) | (y < -90), "InvalidArgumentValue", "latitude beyond 90 degrees", y)
    srid = srid or SRID[geographic, 3 if z is not None else 2]
    out = F.struct(F.lit(srid).cast("bigint").alias("srid"), x.alias("x"), y.alias("y"), (z if z is not None else F.lit(None).cast("double")).alias("z"))
    return Val(F.when(x.isNotNull() & y.isNotNull(), out), POINT)


def point_part(v: Val, name: str) -> Val | None:
    at = {"x": "x", "longitude": "x", "y": "y", "latitude": "y", "z": "z", "height": "z", "srid": "srid"}.get(name)
    if at:
        return Val(v.col[at], LONG if at == "srid" else DOUBLE)
    if name == "crs":
        out = F.lit("cartesian")
        for k, n in SRID_NAMES.items():
            out = F.when(v.col["srid"] == k, F.lit(n)).otherwise(out)
        return Val(F.when(v.col.isNotNull(), out), T.StringType())
    return None


@function("distance", "point.distance", args=2)
def distance(a: Val, b: Val) -> Val:
    if kind(a.type) != "point" or kind(b.type) != "point":
        return null_of(DOUBLE)
    p, q = a.col, b.col
    dz = F.coalesce(p["z"] - q["z"], F.lit(0.0))
    flat = F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) + dz * dz)
    rad = math.pi / 180
    h = F.pow(F.sin((q["y"] - p["y"]) * rad / 2), 2) + F.cos(p["y"] * rad) * F.cos(q["y"] * rad) * F.pow(F.sin((q["x"] - p["x"]) * rad / 2), 2)
    arc = 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
    round_ = F.sqrt(arc * arc + dz * dz)
    return Val(F.when(p["srid"] != q["srid"], F.lit(None)).when(p["srid"].isin(4326, 4979), round_).otherwise(flat), DOUBLE)


@function("point.withinbbox", args=3)
def within_bbox(p: Val, low: Val, high: Val) -> Val:
    if "null" in (kind(p.type), kind(low.type), kind(high.type)):
        return null_of(BOOL)
    for v in (p, low, high):
        need("point.withinBBox", v, "point")
    a, b, c = p.col, low.col, high.col
    across = a["srid"].isin(4326, 4979) & (b["x"] > c["x"])
    x = F.when(across, (a["x"] >= b["x"]) | (a["x"] <= c["x"])).otherwise((a["x"] >= b["x"]) & (a["x"] <= c["x"]))
    inside = x & (a["y"] >= b["y"]) & (a["y"] <= c["y"]) & F.coalesce((a["z"] >= b["z"]) & (a["z"] <= c["z"]), F.lit(True))
    return Val(raise_if((a["srid"] != b["srid"]) | (a["srid"] != c["srid"]), "InvalidArgumentValue", "points of different reference systems", inside), BOOL)


# -- vectors


def floats(name: str, v: Val) -> Column:
    need(name, v, "list")
    return F.transform(v.col, lambda x: x.cast("double"))


def pair(name: str, a: Val, b: Val, value: Column) -> Column:
    return raise_if((F.size(a.col) != F.size(b.col)) | (F.size(a.col) == 0), "InvalidArgumentValue", f"{name}: vectors of different or no dimensions", value)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def zipped(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, f))


@function("vector", args=3)
def vector(v: Val, dimension: Val, coordinate: Val) -> Val:
    need("vector", v, "list")
    out = F.transform(v.col, lambda x: x.cast("float"))
    return Val(raise_if(F.size(v.col) != dimension.col, "InvalidArgumentValue", "vector: another number of coordinates", out), T.ArrayType(T.FloatType()))


@function("vector_dimension_count", args=1)
def dimension_count(v: Val) -> Val:
    return Val(F.when(v.col.isNotNull(), F.size(v.col)).cast("bigint"), LONG)


@function("vector_norm", args=2)
def norm(v: Val, metric: Val) -> Val:
    x = floats("vector_norm", v)
    if str(metric.const).upper() == "EUCLIDEAN":
        return Val(F.sqrt(total(F.transform(x, lambda e: e * e))), DOUBLE)
    if str(metric.const).upper() == "MANHATTAN":
        return Val(total(F.transform(x, F.abs)), DOUBLE)
    raise CypherError("InvalidArgumentValue", f"no norm {metric.const}")


def cosine(x: Column, y: Column) -> Column:
    xx, yy = zipped(x, x, lambda a, b: a * b), zipped(y, y, lambda a, b: a * b)
    return F.when((xx > 0) & (yy > 0), zipped(x, y, lambda a, b: a * b) / F.sqrt(xx * yy))


def squares(x: Column, y: Column) -> Column:
    return zipped(x, y, lambda a, b: (a - b) * (a - b))


@function("vector.similarity.cosine", args=2)
def similarity_cosine(a: Val, b: Val) -> Val:
    if "null" in (kind(a.type), kind(b.type)):
        return null_of(DOUBLE)
    x, y = floats("vector.similarity.cosine", a), floats("vector.similarity.cosine", b)
    return Val(pair("vector.similarity.cosine", a, b, (1 + cosine(x, y)) / 2), DOUBLE)


@function("vector.similarity.euclidean", args=2)
def similarity_euclidean(a: Val, b: Val) -> Val:
    if "null" in (kind(a.type), kind(b.type)):
        return null_of(DOUBLE)
    x, y = floats("vector.similarity.euclidean", a), floats("vector.similarity.euclidean", b)
    return Val(pair("vector.similarity.euclidean", a, b, 1 / (1 + squares(x, y))), DOUBLE)


@function("vector_distance", args=3)
def vector_distance(a: Val, b: Val, metric: Val) -> Val:
    if "null" in (kind(a.type), kind(b.type)):
        return null_of(DOUBLE)
    x, y = floats("vector_distance", a), floats("vector_distance", b)
    metrics = {
        "EUCLIDEAN": lambda: F.sqrt(squares(x, y)), "EUCLIDEAN_SQUARED": lambda: squares(x, y), "MANHATTAN": lambda: zipped(x, y, lambda p, q: F.abs(p - q)),
        "HAMMING": lambda: zipped(x, y, lambda p, q: F.when(p == q, 0.0).otherwise(1.0)), "DOT": lambda: -zipped(x, y, lambda p, q: p * q), "COSINE": lambda: 1 - cosine(x, y),
    }
    name = str(metric.const).upper()
    if name not in metrics:
        raise CypherError("InvalidArgumentValue", f"no metric {metric.const}")
    return Val(pair("vector_distance", a, b, metrics[name]()), DOUBLE)
