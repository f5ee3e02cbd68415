"""URL filters by temporal list join, with DataFrame functions only.

Lists are logs of dated entries (pattern, day, action), each list under its category.  Per pattern and
list the last entry of a day counts: the one of greatest seq where entries have that column, and of
equal ones an "add".  An "add" opens a validity interval that the list's next entry for the pattern
ends; any other action only ends one.  A capture is matched against its host and every parent domain of
it (of addresses only the whole).  The as-of join works on (pattern, level, period): a closed interval
is laid into at most 66 periods of the level that fits its length, an open one is a row of its own, and a
capture looks into the period of its fetch day on each level.  The exact days are compared in the join,
so a pattern with a long history isn't compared as a whole, and no day is too late or too early.

Null or hostless URLs match nothing and are allowed.  Null days match nothing.  Repeated captures are
kept; repeated entries count once.  Very long URLs cost what their host's labels cost: one probe for
each parent domain.  An empty list blocks nothing.  Only the named columns of captures and entries are
read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import hot_keys, salted_join

#: Bits of a day within a period: on level k a period has 2^(6 (k + 1)) days.
LEVEL_BITS, LEVELS = 6, 6
#: An open interval's end.
FOREVER = (1 << 31) - 1


def host_of(url: str = "url") -> Column:
    """Lower-case host without user, port and closing dot; empty if there is none."""
    host = F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    return F.lower(F.regexp_replace(F.coalesce(host, F.lit("")), r"\.+$", ""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of at least two labels; of an address only itself."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    return F.when(host.rlike(r"^(\[.*|[0-9]+(\.[0-9]+){3})$"), F.array(host)).otherwise(domains)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: (pattern, day int, action, category[, seq]).  Returns (pattern, category, first_day, end_day), end exclusive."""
    seq = F.col("seq").cast("bigint") if "seq" in entries.columns else F.lit(None).cast("bigint")
    rows = entries.select("pattern", F.coalesce("category", F.lit("")).alias("category"), F.col("day").cast("int").alias("day"), F.struct(seq.alias("seq"), (F.col("action").eqNullSafe("add")).alias("add")).alias("e"))
    last = rows.where("pattern is not null and day is not null").groupBy("pattern", "category", "day").agg(F.max("e").alias("e"))
    following = F.lead("day").over(Window.partitionBy("pattern", "category").orderBy("day"))
    spans = last.withColumn("end_day", F.coalesce(following, F.lit(FOREVER))).where("e.add")
    return spans.select("pattern", "category", F.col("day").alias("first_day"), "end_day")


def laid(spans: DataFrame) -> DataFrame:
    """(pattern, level, period, category, first_day, end_day): a row for each period that an interval meets on its level; level -1: open."""
    days = F.col("end_day").cast("bigint") - F.col("first_day")
    level = F.when(F.col("end_day") == FOREVER, F.lit(-1))
    for k in range(LEVELS - 1):
        level = level.when(days <= 1 << LEVEL_BITS * (k + 2), F.lit(k))
    leveled = spans.withColumn("level", level.otherwise(F.lit(LEVELS - 1)))
    at = lambda day: F.expr(f"shiftright(cast({day} as bigint), {LEVEL_BITS} * (level + 1))")
    periods = F.when(F.col("level") < 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(at("first_day"), at("end_day - 1")))
    return leveled.withColumn("period", F.explode(periods))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day", id_col: str = "page_id") -> DataFrame:
    """(id, host, fetch_day, n_matches, pattern, category, blocked) per capture.

    n_matches counts the active (pattern, list) pairs; pattern and category are those of the longest
    pattern, and of its lists the greatest by name.
    """
    base = captures.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), F.col(day).cast("int").alias("fetch_day"))
    # Captures of one host on one day have one answer; a host may hold a third of all captures.
    asked = base.where("host <> '' and fetch_day is not null").groupBy("host", "fetch_day").agg(F.count(F.lit(1)).alias("n"))
    probes = asked.select("host", "fetch_day", F.explode(suffixes(F.col("host"))).alias("pattern"))
    # A domain may have very many hosts below it.
    wide = hot_keys(probes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), ["pattern"])
    spans = intervals(entries)
    listed = probes.join(spans.select("pattern").distinct(), "pattern", "left_semi")
    places = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("period")), *[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("fetch_day").cast("bigint"), LEVEL_BITS * (k + 1)).alias("period")) for k in range(LEVELS)])
    placed = listed.select("host", "fetch_day", "pattern", F.explode(places).alias("p")).select("host", "fetch_day", "pattern", "p.level", "p.period")
    hit = salted_join(placed, laid(spans), ["pattern", "level", "period"], wide).where("first_day <= fetch_day and fetch_day < end_day")
    best = hit.groupBy("host", "fetch_day").agg(F.count(F.lit(1)).alias("n_matches"), F.max(F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("pattern"), F.col("category").alias("category"))).alias("m"))
    out = salted_join(base, best, ["host", "fetch_day"], hot_keys(asked, ["host", "fetch_day"]), "left")
    return out.select("page_id", "host", "fetch_day", F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"), F.col("m.pattern").alias("pattern"), F.col("m.category").alias("category"), F.col("n_matches").isNotNull().alias("blocked"))
