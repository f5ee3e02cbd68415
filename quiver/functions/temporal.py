"""Dates, times and durations.

Dates are DATE, local date-times TIMESTAMP_NTZ (microseconds); the other kinds are structs (see values).
A zone is an offset such as +01:00 or a region name.  Constant text is read when planning, so all its
ISO forms are known; text columns are read by Spark's parsers.
"""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.registry import ARITY, FUNCTIONS, function, need
from quiver.plans.ast import CypherError
from quiver.plans.values import DATE, DATETIME, DURATION, LOCALDATETIME, LOCALTIME, LONG, STRING, TIME, Val, kind, null_of

KINDS = ("date", "localtime", "time", "localdatetime", "datetime", "duration")
NANOS = 1_000_000_000
DAY = 86_400
#: Seconds of an average month, for fractions of months.
MONTH_S = 2_629_746
ZONED = {"date": False, "localtime": False, "time": True, "localdatetime": False, "datetime": True}


def big(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def pack(t, **fields: Column) -> Column:
    return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in t.fields])


# -- offsets


def offset_of(zone: str, at: dt.datetime | None = None) -> int:
    """Seconds of a zone: Z, +hh, +hhmm, +hh:mm(:ss), or a region at a local time."""
    if zone in ("Z", "z"):
        return 0
    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)?:?(\d\d)?", zone)
    if m:
        return (int(m[2]) * 3600 + int(m[3] or 0) * 60 + int(m[4] or 0)) * (-1 if m[1] == "-" else 1)
    try:
        return int(ZoneInfo(zone).utcoffset(at or dt.datetime(1970, 1, 1)).total_seconds())  # type: ignore[union-attr]
    except Exception as e:
        raise CypherError("InvalidArgumentValue", f"no time zone {zone}") from e


def offset_text(s: int) -> str:
    if s == 0:
        return "Z"
    sign, s = "-" if s < 0 else "+", abs(s)
    return f"{sign}{s // 3600:02d}:{s // 60 % 60:02d}" + (f":{s % 60:02d}" if s % 60 else "")


def offset_column(s: Column) -> Column:
    a = F.abs(s)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    out = F.concat(F.when(s < 0, "-").otherwise("+"), two(F.expr("0") + F.floor(a / 3600)), F.lit(":"), two(F.floor(a / 60) % 60))
    return F.when(s == 0, "Z").otherwise(out)


def local(v: Val) -> Column:
    """A zoned date-time's wall clock."""
    return v.col["utc"] + F.make_dt_interval(secs=zone_seconds(v).cast("decimal(18,6)"))


def zone_seconds(v: Val) -> Column:
    """The offset of a date-time in seconds: of its own zone at its instant."""
    if kind(v.type) == "time":
        return v.col["offset_s"]
    z = v.col["zone"]
    part = lambda i: F.coalesce(F.regexp_extract(z, r"^([+-])(\d\d):?(\d\d)?$", i).try_cast("bigint"), big(0))
    fixed = (part(2) * 3600 + part(3) * 60) * F.when(z.startswith("-"), -1).otherwise(1)
    # Regions: read the same wall clock in UTC and in the region.
    text = v.col["utc"].cast("string")
    region = F.when(z.contains("/"), F.unix_timestamp(F.from_utc_timestamp(F.to_utc_timestamp(text, F.current_timezone()), z)) - F.unix_timestamp(F.to_utc_timestamp(text, F.current_timezone())))
    return F.when(z == "Z", big(0)).when(z.contains("/"), region).otherwise(fixed)


def zoned(wall: Column, zone: str, at: dt.datetime | None = None) -> Column:
    s = offset_of(zone, at)
    name = zone if "/" in zone else offset_text(s)
    return pack(DATETIME, utc=wall - F.make_dt_interval(secs=F.lit(float(s)).cast("decimal(18,6)")), zone=F.lit(name))


# -- reading constants


def read_date(s: str) -> dt.date:
    """Calendar, ordinal and week dates, basic or extended; missing parts are 1."""
    for pattern, build in (
        (r"([+-]?\d{4,9})-(\d\d)-(\d\d)", lambda y, m, d: dt.date(y, m, d)),
        (r"(\d{4})(\d\d)(\d\d)", lambda y, m, d: dt.date(y, m, d)),
        (r"(\d{4})-?W(\d\d)-?(\d)", lambda y, w, d: dt.date.fromisocalendar(y, w, d)),
        (r"(\d{4})-?W(\d\d)", lambda y, w: dt.date.fromisocalendar(y, w, 1)),
        (r"(\d{4})-?Q(\d)-?(\d\d)", lambda y, q, d: dt.date(y, 3 * q - 2, 1) + dt.timedelta(d - 1)),
        (r"(\d{4})-?(\d{3})", lambda y, d: dt.date(y, 1, 1) + dt.timedelta(d - 1)),
        (r"(\d{4})-?(\d\d)", lambda y, m: dt.date(y, m, 1)),
        (r"(\d{4})", lambda y: dt.date(y, 1, 1)),
    ):
        m = re.fullmatch(pattern, s)
        if m:
            try:
                return build(*map(int, m.groups()))
            except ValueError as e:
                raise CypherError("InvalidArgumentValue", f"no such date: {s}") from e
    raise CypherError("InvalidArgumentValue", f"no date: {s}")


def read_clock(s: str) -> tuple[int, str | None]:
    """(nanoseconds of the day, zone) of a clock text."""
    m = re.fullmatch(r"(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d{1,9}))?)?)?\s*(Z|z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)?(?:\[([^\]]+)\])?", s)
    if not m:
        raise CypherError("InvalidArgumentValue", f"no time: {s}")
    h, mi, sec = int(m[1]), int(m[2] or 0), int(m[3] or 0)
    if h > 23 or mi > 59 or sec > 59:
        raise CypherError("InvalidArgumentValue", f"no such time: {s}")
    return (h * 3600 + mi * 60 + sec) * NANOS + int((m[4] or "").ljust(9, "0") or 0), m[6] or m[5]


def wall_column(d: dt.date, nanos: int) -> Column:
    clock = dt.timedelta(microseconds=nanos // 1000)
    return F.lit((dt.datetime(d.year, d.month, d.day) + clock).isoformat(sep=" ")).cast("timestamp_ntz")


def read_duration(s: str) -> tuple[int, int, int, int]:
    m = re.fullmatch(r"(-)?P(?:([-\d.,]+)Y)?(?:([-\d.,]+)M)?(?:([-\d.,]+)W)?(?:([-\d.,]+)D)?(?:T(?:([-\d.,]+)H)?(?:([-\d.,]+)M)?(?:([-\d.,]+)S)?)?", s)
    if not m or s.rstrip("T") in ("P", "-P"):
        m2 = re.fullmatch(r"P(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)", s)
        if not m2:
            raise CypherError("InvalidArgumentValue", f"no duration: {s}")
        y, mo, d, h, mi = (int(x) for x in m2.groups()[:5])
        return normal_duration({"years": y, "months": mo, "days": d, "hours": h, "minutes": mi, "seconds": float(m2[6])})
    sign = -1 if m[1] else 1
    keys = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")
    return normal_duration({k: sign * float(x.replace(",", ".")) for k, x in zip(keys, m.groups()[1:], strict=True) if x})


def normal_duration(parts: dict[str, float]) -> tuple[int, int, int, int]:
    """(months, days, seconds, nanos) of possibly fractional parts; a fraction flows into the smaller units."""
    from fractions import Fraction

    g = lambda k: Fraction(str(parts.get(k, 0)))
    months = g("years") * 12 + g("quarters") * 3 + g("months")
    whole = int(months)
    rest_s = (months - whole) * MONTH_S
    days = g("weeks") * 7 + g("days")
    more = int(rest_s / DAY)
    d = int(days) + more
    rest_s = rest_s - more * DAY + (days - int(days)) * DAY
    s = rest_s + g("hours") * 3600 + g("minutes") * 60 + g("seconds")
    n = s * NANOS + g("milliseconds") * 1_000_000 + g("microseconds") * 1000 + g("nanoseconds")
    n = int(n)
    seconds = int(n / NANOS) if abs(n) < 1 << 52 else (abs(n) // NANOS) * (1 if n >= 0 else -1)
    return whole, d, seconds, n - seconds * NANOS


def duration_literal(parts: tuple[int, int, int, int]) -> Val:
    return Val(pack(DURATION, months=F.lit(parts[0]), days=F.lit(parts[1]), seconds=F.lit(parts[2]), nanos=F.lit(parts[3])), DURATION)


# -- parts of values


def date_part(v: Val) -> Column:
    k = kind(v.type)
    return v.col if k == "date" else v.col.cast("date") if k == "localdatetime" else local(v).cast("date")


def clock_part(v: Val) -> Column:
    """Nanoseconds of the day."""
    k = kind(v.type)
    if k == "date":
        return big(0)
    if k in ("localtime", "time"):
        return v.col["day_nanos"]
    wall = v.col if k == "localdatetime" else local(v)
    return (F.hour(wall) * 3600 + F.minute(wall) * 60).cast("bigint") * NANOS + (F.expr("1000") * F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")


def wall_of(day: Column, nanos: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=(nanos / 1000).cast("bigint").cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)"))


#: The parts of maps that build temporal values.
DATE_KEYS = ("year", "month", "day", "week", "dayOfWeek", "quarter", "dayOfQuarter", "ordinalDay")
CLOCK_KEYS = ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond")


def date_from(m: Val) -> Column:
    """The date of a map: calendar, week, quarter or ordinal, on top of an embedded date."""
    has = set(m.fields)
    base = next((date_part(m.field(k)) for k in ("date", "datetime") if k in has), None)
    get = lambda k, d: m.col[k].cast("int") if k in has else d
    year = get("year", F.year(base) if base is not None else None)
    if year is None:
        raise CypherError("InvalidArgumentValue", "a date needs a year")
    if "week" in has or "dayOfWeek" in has and base is not None:
        if base is not None and "year" not in has:
            year = F.extract(F.lit("YEAROFWEEK"), base).cast("int")
        week = get("week", F.weekofyear(base) if base is not None else F.lit(1))
        day = get("dayOfWeek", (F.weekday(base) + 1) if base is not None else F.lit(1))
        fourth = F.make_date(year, F.lit(1), F.lit(4))
        return F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + day - 1)
    if "quarter" in has or "dayOfQuarter" in has:
        q = get("quarter", F.quarter(base) if base is not None else F.lit(1))
        first = F.make_date(year, q * 3 - 2, F.lit(1))
        if "dayOfQuarter" in has or base is None:
            return F.date_add(first, get("dayOfQuarter", F.lit(1)) - 1)
        return F.make_date(year, q * 3 - 2 + (F.month(base) - 1) % 3, F.dayofmonth(base))
    if "ordinalDay" in has:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), m.col["ordinalDay"].cast("int") - 1)
    return F.make_date(year, get("month", F.month(base) if base is not None else F.lit(1)), get("day", F.dayofmonth(base) if base is not None else F.lit(1)))


def clock_from(m: Val) -> Column:
    has = set(m.fields)
    base = next((clock_part(m.field(k)) for k in ("time", "datetime") if k in has), big(0))
    get = lambda k, d: big(m.col[k]) if k in has else d
    h = get("hour", F.floor(base / (3600 * NANOS)))
    mi = get("minute", F.floor(base / (60 * NANOS)) % 60)
    s = get("second", F.floor(base / NANOS) % 60)
    if has & {"millisecond", "microsecond", "nanosecond"}:
        sub = get("millisecond", big(0)) * 1_000_000 + get("microsecond", big(0)) * 1000 + get("nanosecond", big(0))
    else:
        sub = base % NANOS if not has & {"hour", "minute", "second"} or "second" not in has else big(0)
    return (big(h) * 3600 + big(mi) * 60 + big(s)) * NANOS + sub


def zone_from(m: Val) -> str | None:
    if "timezone" not in m.fields:
        return None
    zone = m.const.get("timezone") if isinstance(m.const, dict) else None
    if not isinstance(zone, str):
        raise CypherError("InvalidArgumentValue", "timezone must be a constant")
    return zone


def build(k: str, v: Val | None = None) -> Val:
    """A temporal value of kind k from now, text, a map or another temporal value."""
    if v is None:
        now = F.current_timestamp().cast("timestamp_ntz")
        return from_parts(k, F.current_date(), clock_part(Val(now, LOCALDATETIME)), "Z")
    own = kind(v.type)
    if own == "null":
        return null_of({"date": DATE, "localtime": LOCALTIME, "time": TIME, "localdatetime": LOCALDATETIME, "datetime": DATETIME}[k])
    if own == "string":
        return from_constant(k, v.const) if v.known and v.const is not None else from_text(k, v.col)
    if own == "map":
        embedded = next((v.field(n) for n in ("datetime", "time") if n in v.fields and kind(v.field(n).type) in ("datetime", "time")), None)
        day = date_from(v) if k in ("date", "localdatetime", "datetime") else F.lit(dt.date(1970, 1, 1))
        clock = clock_from(v) if k != "date" else big(0)
        if ZONED[k] and embedded is not None and zone_from(v) is None:
            return keep_zone(k, day, clock, embedded)
        return from_parts(k, day, clock, zone_from(v) or "Z")
    if own in KINDS and own != "duration":
        if k == own:
            return v
        if own == "date" and k in ("localtime", "time") or own in ("localtime", "time") and k not in ("localtime", "time"):
            raise CypherError("InvalidArgumentValue", f"no {k} from a {own}")
        day = date_part(v) if own not in ("localtime", "time") else F.lit(dt.date(1970, 1, 1))
        if ZONED[k] and ZONED[own]:
            return keep_zone(k, day, clock_part(v), v)
        return from_parts(k, day, clock_part(v), "Z")
    raise CypherError("InvalidArgumentValue", f"no {k} from a {own}")


def keep_zone(k: str, day: Column, clock: Column, of: Val) -> Val:
    s = zone_seconds(of)
    if k == "time":
        return Val(pack(TIME, day_nanos=clock, offset_s=s), TIME)
    zone = of.col["zone"] if kind(of.type) == "datetime" else offset_column(s)
    return Val(pack(DATETIME, utc=wall_of(day, clock - s * NANOS), zone=zone), DATETIME)


def from_parts(k: str, day: Column, clock: Column, zone: str) -> Val:
    if k == "date":
        return Val(day, DATE)
    if k == "localtime":
        return Val(pack(LOCALTIME, day_nanos=clock), LOCALTIME)
    if k == "time":
        return Val(pack(TIME, day_nanos=clock, offset_s=big(offset_of(zone))), TIME)
    wall = wall_of(day, clock)
    return Val(wall, LOCALDATETIME) if k == "localdatetime" else Val(zoned(wall, zone), DATETIME)


def from_constant(k: str, s: str) -> Val:
    day, clock, zone = dt.date(1970, 1, 1), 0, None
    if k in ("localtime", "time"):
        clock, zone = read_clock(s.removeprefix("T"))
    else:
        head, _, tail = s.partition("T")
        day = read_date(head)
        if tail:
            clock, zone = read_clock(tail)
    if k == "date":
        return Val(F.lit(day), DATE, day, True)
    if k == "localtime":
        return Val(pack(LOCALTIME, day_nanos=F.lit(clock)), LOCALTIME)
    at = dt.datetime(day.year, day.month, day.day) + dt.timedelta(microseconds=clock // 1000)
    if k == "time":
        return Val(pack(TIME, day_nanos=F.lit(clock), offset_s=F.lit(offset_of(zone or "Z", at))), TIME)
    wall = wall_column(day, clock)
    return Val(wall, LOCALDATETIME) if k == "localdatetime" else Val(zoned(wall, zone or "Z", at), DATETIME)


def from_text(k: str, s: Column) -> Val:
    if k == "date":
        return Val(s.try_cast("date"), DATE)
    if k in ("localtime", "time"):
        wall = F.concat(F.lit("1970-01-01 "), F.regexp_extract(s, r"^(\d\d:\d\d(?::\d\d(?:\.\d+)?)?)", 1)).try_cast("timestamp_ntz")
        clock = clock_part(Val(wall, LOCALDATETIME))
        return Val(pack(LOCALTIME, day_nanos=clock), LOCALTIME) if k == "localtime" else Val(pack(TIME, day_nanos=clock, offset_s=big(0)), TIME)
    if k == "localdatetime":
        return Val(s.try_cast("timestamp_ntz"), LOCALDATETIME)
    utc = F.to_utc_timestamp(s.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return Val(F.when(s.isNotNull(), pack(DATETIME, utc=utc, zone=F.lit("Z"))), DATETIME)


for _k, _names in {
    "date": ("date",), "localtime": ("localtime", "local_time"), "time": ("time", "zoned_time"),
    "localdatetime": ("localdatetime", "local_datetime"), "datetime": ("datetime", "zoned_datetime"),
}.items():
    for _n in _names:
        for _suffix, _most in (("", 1), (".realtime", 1), (".statement", 1), (".transaction", 1)):
            FUNCTIONS[_n + _suffix] = lambda v=None, k=_k, clock=bool(_suffix): build(k, None if clock else v)
            ARITY[_n + _suffix] = (0, _most)


@function("timestamp", args=0)
def timestamp() -> Val:
    return Val(F.unix_millis(F.current_timestamp()), LONG)


@function("datetime.fromepoch", args=(1, 2))
def from_epoch(s: Val, ns: Val | None = None) -> Val:
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=s.col.cast("decimal(18,0)"))
    if ns is not None:
        utc = utc + F.make_dt_interval(secs=(F.floor(ns.col / 1000).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)")))
    return Val(pack(DATETIME, utc=utc, zone=F.lit("Z")), DATETIME)


@function("datetime.fromepochmillis", args=1)
def from_epoch_millis(ms: Val) -> Val:
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=ms.col.cast("decimal(18,0)") / F.lit(1000).cast("decimal(18,0)"))
    return Val(pack(DATETIME, utc=utc, zone=F.lit("Z")), DATETIME)


# -- truncation


def truncated_date(unit: str, day: Column) -> Column:
    years = {"millennium": 1000, "century": 100, "decade": 10}
    if unit in years:
        n = years[unit]
        return F.make_date((F.floor(F.year(day) / n) * n).cast("int"), F.lit(1), F.lit(1))
    if unit == "weekYear":
        fourth = F.make_date(F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.lit(1), F.lit(4))
        return F.date_sub(fourth, F.weekday(fourth))
    if unit in ("year", "quarter", "month", "week"):
        return F.trunc(day, unit)
    return day


CLOCK_UNITS = {"day": DAY * NANOS, "hour": 3600 * NANOS, "minute": 60 * NANOS, "second": NANOS, "millisecond": 1_000_000, "microsecond": 1000}


def truncate(k: str, unit: Val, v: Val, overrides: Val | None = None) -> Val:
    name = unit.const
    units = ("millennium", "century", "decade", "year", "weekYear", "quarter", "month", "week")
    if name not in units and name not in CLOCK_UNITS:
        raise CypherError("InvalidArgumentValue", f"no unit {name}")
    if kind(v.type) == "null":
        return build(k, v)
    own = kind(v.type)
    day = date_part(v) if own not in ("localtime", "time") else F.lit(dt.date(1970, 1, 1))
    day = truncated_date(name, day)
    clock = big(0) if name in units or name == "day" else clock_part(v) - clock_part(v) % CLOCK_UNITS[name]
    zone = zone_from(overrides) if overrides is not None else None
    if overrides is not None:
        day = overridden_date(day, overrides)
        has = set(overrides.fields) & set(CLOCK_KEYS)
        if has:
            base = {key: F.floor(clock / n) % m for key, n, m in (("hour", 3600 * NANOS, 24), ("minute", 60 * NANOS, 60), ("second", NANOS, 60))}
            get = lambda key: big(overrides.col[key]) if key in has else big(base[key])
            sub = clock % NANOS
            for key, n in (("millisecond", 1_000_000), ("microsecond", 1000), ("nanosecond", 1)):
                if key in has:
                    sub = sub + big(overrides.col[key]) * n
            clock = (get("hour") * 3600 + get("minute") * 60 + get("second")) * NANOS + sub
    if ZONED[k] and zone is None and ZONED.get(own, False):
        return keep_zone(k, day, clock, v)
    return from_parts(k, day, clock, zone or "Z")


def overridden_date(day: Column, m: Val) -> Column:
    has = set(m.fields)
    if "dayOfWeek" in has:
        return F.date_add(F.date_sub(day, F.weekday(day)), m.col["dayOfWeek"].cast("int") - 1)
    if "ordinalDay" in has:
        return F.date_add(F.trunc(day, "year"), m.col["ordinalDay"].cast("int") - 1)
    if "dayOfQuarter" in has:
        return F.date_add(F.trunc(day, "quarter"), m.col["dayOfQuarter"].cast("int") - 1)
    if has & {"year", "month", "day"}:
        get = lambda k, d: m.col[k].cast("int") if k in has else d
        return F.make_date(get("year", F.year(day)), get("month", F.month(day)), get("day", F.dayofmonth(day)))
    return day


for _k in ("date", "localtime", "time", "localdatetime", "datetime"):
    FUNCTIONS[f"{_k}.truncate"] = lambda unit, v=None, o=None, k=_k: truncate(k, unit, v if v is not None else build(k), o)
    ARITY[f"{_k}.truncate"] = (1, 3)


# -- durations


@function("duration", args=1)
def duration(v: Val) -> Val:
    k = kind(v.type)
    if k == "null":
        return null_of(DURATION)
    if k == "duration":
        return v
    if v.known:
        return duration_literal(read_duration(v.const) if k == "string" else normal_duration(v.const))
    need("duration", v, "map")
    has = set(v.fields)
    g = lambda n: v.col[n].cast("double") if n in has else F.lit(0.0)
    months = g("years") * 12 + g("quarters") * 3 + g("months")
    whole = big(months)
    days = g("weeks") * 7 + g("days")
    spill = (months - whole) * MONTH_S
    more = big(spill / DAY)
    rest = spill - more * DAY + (days - big(days)) * DAY
    nanos = big(rest * NANOS) + big((g("hours") * 3600 + g("minutes") * 60) * NANOS) + big(g("seconds") * NANOS) + big(g("milliseconds") * 1_000_000 + g("microseconds") * 1000 + g("nanoseconds"))
    return Val(duration_of(whole, big(days) + more, nanos), DURATION)


def duration_of(months: Column, days: Column, nanos: Column) -> Column:
    seconds = (nanos / NANOS).cast("bigint")
    return pack(DURATION, months=months, days=days, seconds=seconds, nanos=nanos - seconds * NANOS)


def span(a: Val, b: Val) -> tuple[Column, Column, Column, Column]:
    """(first day, its clock, second day, its clock); a missing date is the other's, a missing clock midnight; zones are levelled."""
    ka, kb = kind(a.type), kind(b.type)
    timed = ("localtime", "time")
    if ka in timed or kb in timed:
        da = db = F.lit(dt.date(1970, 1, 1)) if ka in timed and kb in timed else date_part(b if ka in timed else a)
    else:
        da, db = date_part(a), date_part(b)
    ca, cb = clock_part(a), clock_part(b)
    if ZONED.get(ka) and ZONED.get(kb):
        cb = cb + (zone_seconds(a) - zone_seconds(b)) * NANOS
    return da, ca, db, cb


def between(part: str, a: Val, b: Val) -> Val:
    if "null" in (kind(a.type), kind(b.type)):
        return null_of(DURATION)
    da, ca, db, cb = span(a, b)
    total = F.datediff(db, da).cast("bigint") * (DAY * NANOS) + cb - ca
    zero = big(0)
    if part == "seconds":
        return Val(duration_of(zero, zero, total), DURATION)
    if part == "days":
        return Val(duration_of(zero, (total / (DAY * NANOS)).cast("bigint"), zero), DURATION)
    raw = ((F.year(db) - F.year(da)) * 12 + F.month(db) - F.month(da)).cast("bigint")
    # Months that fit, towards zero.
    late = F.datediff(db, F.add_months(da, raw.cast("int"))).cast("bigint") * (DAY * NANOS) + cb - ca
    months = raw - F.when((total >= 0) & (late < 0), 1).when((total < 0) & (late > 0), -1).otherwise(0)
    if part == "months":
        return Val(duration_of(months, zero, zero), DURATION)
    rest = F.datediff(db, F.add_months(da, months.cast("int"))).cast("bigint") * (DAY * NANOS) + cb - ca
    days = (rest / (DAY * NANOS)).cast("bigint")
    return Val(duration_of(months, days, rest - days * (DAY * NANOS)), DURATION)


for _n, _p in (("between", "all"), ("inmonths", "months"), ("indays", "days"), ("inseconds", "seconds")):
    FUNCTIONS[f"duration.{_n}"] = lambda a, b, p=_p: between(p, a, b)
    ARITY[f"duration.{_n}"] = (2, 2)
FUNCTIONS["duration_between"], ARITY["duration_between"] = FUNCTIONS["duration.between"], (2, 2)


def shift(v: Val, d: Val, sign: int) -> Val:
    """A temporal value moved by a duration."""
    k = kind(v.type)
    months, days = d.col["months"] * sign, d.col["days"] * sign
    nanos = (d.col["seconds"] * NANOS + d.col["nanos"]) * sign
    if k in ("localtime", "time"):
        clock = F.pmod(v.col["day_nanos"] + nanos, F.lit(DAY * NANOS))
        return Val(pack(LOCALTIME, day_nanos=clock), LOCALTIME) if k == "localtime" else Val(pack(TIME, day_nanos=clock, offset_s=v.col["offset_s"]), TIME)
    whole = (nanos / (DAY * NANOS)).cast("bigint")
    day = F.date_add(F.add_months(date_part(v), months.cast("int")), (days + (whole if k == "date" else 0)).cast("int"))
    if k == "date":
        return Val(day, DATE)
    wall = wall_of(day, clock_part(v) + nanos)
    if k == "localdatetime":
        return Val(wall, LOCALDATETIME)
    return Val(pack(DATETIME, utc=wall - F.make_dt_interval(secs=zone_seconds(v).cast("decimal(18,6)")), zone=v.col["zone"]), DATETIME)


def add_durations(a: Val, b: Val, sign: int) -> Val:
    nanos = (a.col["seconds"] + b.col["seconds"] * sign) * NANOS + a.col["nanos"] + b.col["nanos"] * sign
    return Val(duration_of(a.col["months"] + b.col["months"] * sign, a.col["days"] + b.col["days"] * sign, nanos), DURATION)


def scale(d: Val, by: Column) -> Val:
    months = d.col["months"] * by
    whole = big(months)
    spill = (months - whole) * MONTH_S
    days = d.col["days"] * by + big(spill / DAY)
    rest = spill - big(spill / DAY) * DAY + (days - big(days)) * DAY
    nanos = big((d.col["seconds"] * by + rest) * NANOS) + big(d.col["nanos"] * by)
    return Val(duration_of(whole, big(days), nanos), DURATION)


# -- accessors


def accessor(v: Val, name: str) -> Val | None:
    """A part of a temporal value, or None if the kind has no such part."""
    k = kind(v.type)
    if k == "duration":
        return duration_part(v, name)
    out: Column | None = None
    if k in ("date", "localdatetime", "datetime"):
        d = date_part(v)
        out = {
            "year": lambda: F.year(d), "quarter": lambda: F.quarter(d), "month": lambda: F.month(d), "week": lambda: F.weekofyear(d),
            "weekYear": lambda: F.extract(F.lit("YEAROFWEEK"), d), "day": lambda: F.dayofmonth(d), "ordinalDay": lambda: F.dayofyear(d),
            "weekDay": lambda: F.weekday(d) + 1, "dayOfWeek": lambda: F.weekday(d) + 1, "dayOfQuarter": lambda: F.datediff(d, F.trunc(d, "quarter")) + 1,
        }.get(name, lambda: None)()
    if out is None and k != "date":
        c = clock_part(v)
        n = {"hour": (3600 * NANOS, 24), "minute": (60 * NANOS, 60), "second": (NANOS, 60), "millisecond": (1_000_000, 1000), "microsecond": (1000, 1_000_000), "nanosecond": (1, NANOS)}.get(name)
        if n:
            out = F.floor(c / n[0]) % n[1] if n[0] > 1 else c % NANOS
        elif ZONED[k] and name in ("timezone", "offset"):
            s = offset_column(zone_seconds(v))
            return Val(v.col["zone"] if name == "timezone" and k == "datetime" else s, STRING)
        elif ZONED[k] and name in ("offsetMinutes", "offsetSeconds"):
            out = zone_seconds(v) / (60 if name == "offsetMinutes" else 1)
        elif k == "datetime" and name in ("epochSeconds", "epochMillis"):
            text = v.col["utc"]
            micros = F.datediff(text.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("bigint") * (DAY * 1_000_000) + clock_part(Val(text, LOCALDATETIME)) / 1000
            out = F.floor(micros / (1_000_000 if name == "epochSeconds" else 1000))
    return None if out is None else Val(out.cast("bigint"), LONG)


def duration_part(v: Val, name: str) -> Val | None:
    mo, d, s, n = (v.col[f] for f in ("months", "days", "seconds", "nanos"))
    whole = lambda x, by: (x / by).cast("bigint")
    table = {
        "years": lambda: whole(mo, 12), "quarters": lambda: whole(mo, 3), "months": lambda: mo, "weeks": lambda: whole(d, 7), "days": lambda: d,
        "hours": lambda: whole(s, 3600), "minutes": lambda: whole(s, 60), "seconds": lambda: s, "milliseconds": lambda: s * 1000 + whole(n, 1_000_000),
        "microseconds": lambda: s * 1_000_000 + whole(n, 1000), "nanoseconds": lambda: s * NANOS + n, "quartersOfYear": lambda: whole(mo % 12, 3),
        "monthsOfQuarter": lambda: mo % 3, "monthsOfYear": lambda: mo % 12, "daysOfWeek": lambda: d % 7, "minutesOfHour": lambda: whole(s, 60) % 60,
        "secondsOfMinute": lambda: s % 60, "millisecondsOfSecond": lambda: whole(n, 1_000_000), "microsecondsOfSecond": lambda: whole(n, 1000), "nanosecondsOfSecond": lambda: n,
    }
    return Val(table[name]().cast("bigint"), LONG) if name in table else None


# -- text


def clock_text(nanos: Column) -> Column:
    two = lambda x: F.lpad(big(x).cast("string"), 2, "0")
    h, m, s, n = F.floor(nanos / (3600 * NANOS)), F.floor(nanos / (60 * NANOS)) % 60, F.floor(nanos / NANOS) % 60, nanos % NANOS
    tail = F.regexp_replace(F.lpad(n.cast("string"), 9, "0"), "0+$", "")
    return F.concat(two(h), F.lit(":"), two(m), F.when((s > 0) | (n > 0), F.concat(F.lit(":"), two(s))).otherwise(""), F.when(n > 0, F.concat(F.lit("."), tail)).otherwise(""))


def text(v: Val) -> Column:
    """ISO text."""
    k = kind(v.type)
    if k == "duration":
        return duration_text(v)
    day = date_part(v).cast("string") if k in ("date", "localdatetime", "datetime") else None
    if k == "date":
        return day  # type: ignore[return-value]
    out = clock_text(clock_part(v))
    if day is not None:
        out = F.concat(day, F.lit("T"), out)
    if ZONED[k]:
        out = F.concat(out, offset_column(zone_seconds(v)))
        if k == "datetime":
            out = F.concat(out, F.when(v.col["zone"].contains("/"), F.concat(F.lit("["), v.col["zone"], F.lit("]"))).otherwise(""))
    return out


def duration_text(v: Val) -> Column:
    mo, d, s, n = (v.col[f] for f in ("months", "days", "seconds", "nanos"))
    put = lambda x, unit: F.when(x != 0, F.concat(x.cast("string"), F.lit(unit))).otherwise("")
    whole = lambda x, by: (x / by).cast("bigint")
    rest = s % 60
    sign = F.when((rest < 0) | (n < 0), "-").otherwise("")
    fraction = F.regexp_replace(F.lpad(F.abs(n).cast("string"), 9, "0"), "0+$", "")
    sec = F.when((rest != 0) | (n != 0), F.concat(sign, F.abs(rest).cast("string"), F.when(n != 0, F.concat(F.lit("."), fraction)).otherwise(""), F.lit("S"))).otherwise("")
    clock = F.concat(put(whole(s, 3600), "H"), put(whole(s, 60) % 60, "M"), sec)
    days = F.concat(put(whole(mo, 12), "Y"), put(mo % 12, "M"), put(d, "D"))
    out = F.concat(F.lit("P"), days, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.when(v.col.isNull(), F.lit(None)).when(out == "P", "PT0S").otherwise(out)

