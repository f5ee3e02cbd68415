"""Line dedup within an edit distance of one, by a deletion-neighbourhood join of DataFrame functions.

Lines are first reduced to distinct ones.  Two lines within one edit share the first or the last half
(rounded down to a length class), so only lines that share such a half with another go on.  Of those,
windows of WINDOW characters go on whose surroundings another line has too.  They emit their variants as
hashed keys: the parts left and right of the window and the window with each character left out.  Two lines of equal length with the same variant at the
same place differ in one character; a line equal to a variant of one that is longer by one lacks one
character.  Windows keep the cost linear in the line's length.  Each line is compared with the earliest
line of its keys, verified by edit distance.  No key's members are gathered or paired with each other.

A line occurrence goes if the same line occurs earlier, or if an earlier line is within one edit.
Earlier: by (id, line number).  Empty lines always stay: they part paragraphs.  Lines shorter than
near_least characters go as repeats only, since one edit can make another word of them.  Ids are whole
numbers (others are an error of the cast).  A null id is before all others; rows with the same id count
as one document, so their equal lines at equal places are the same occurrence.  Null texts stay null and
have no lines; an empty text is one empty line.  Very long lines and texts are read whole; a line's cost is
linear in its length.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import checkpoint, hot_keys, salted_join

WINDOW = 48
#: Ratio of the length classes.
RATIO = 1.25


def half(length: Column) -> Column:
    """A length of at most half of the given one, equal within a length class."""
    exponent = F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.log(F.lit(RATIO)) + 1e-9)
    return F.greatest(F.least(F.floor(F.pow(F.lit(RATIO), exponent) / 2), F.expr("1000000000")), F.lit(1)).cast("int")


def half_keys(line: Column, length: Column) -> Column:
    def pair(m: Column) -> list[Column]:
        t = half(m)
        return [F.xxhash64(F.lit("a"), t, F.left(line, t)), F.xxhash64(F.lit("b"), t, F.right(line, t))]

    return F.array_distinct(F.array(*pair(length), *pair(length - 1)))


def lines(docs: DataFrame, near_least: int, id_col: str, text_col: str) -> DataFrame:
    """(id, no, n, h, g, keys) for lines that aren't empty; h and g identify a line.  keys are there from near_least characters on."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    rows = rows.withColumn("n", F.char_length("line")).where("n > 0")
    g = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseXOR(F.crc32("line"))
    return rows.select("id", "no", "n", F.xxhash64("line").alias("h"), g.alias("g"), F.when(F.col("n") >= near_least, half_keys(F.col("line"), F.col("n"))).alias("keys"))


def windows(candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """candidates: (id, no, h, g, n, line).  Returns (id, no, h, g, role, w, around) for windows whose surroundings another line has too.

    role 0: the line as the shorter or equal one, of m = n characters; 1: as the longer one, m = n - 1, with one character more in the window.
    """
    line = F.col("line")

    def cut(role: int) -> DataFrame:
        m = F.col("n") - role
        places = F.sequence(F.lit(0), F.greatest(F.ceil(m / window).cast("int") - 1, F.lit(0)))
        w = candidates.select("id", "no", "h", "g", "n", "line", m.alias("m"), F.explode(places).alias("j"))
        at = F.col("j") * window
        return w.select(
            "id", "no", "h", "g", F.lit(role).alias("role"), F.substring(line, at + 1, F.lit(window + role)).alias("w"),
            F.xxhash64("m", "j", F.left(line, at), F.substring(line, at + window + 1 + role, F.col("n"))).alias("around"),
        )

    every = checkpoint(cut(0).union(cut(1)))
    shared = checkpoint(every.groupBy("around").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("around", "n"))
    # Lines of one form, as of a counter, share their surroundings in great numbers.
    return salted_join(every, shared.select("around"), ["around"], hot_keys(shared, ["around"]), "left_semi")


def variants(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut: what windows() gives.  Returns (key, kind, id, no, h, g); kind 0: same length, 1: the shorter line, 2: a longer one."""

    def without(i: Column) -> Column:
        return F.concat(F.left(F.col("w"), i - 1), F.substring(F.col("w"), i + 1, F.lit(window + 1)))

    every = F.sequence(F.lit(1), F.char_length("w"))
    short, long_ = cut.where("role = 0"), cut.where("role = 1 and w <> ''")
    same = short.where("w <> ''").select("id", "no", "h", "g", F.lit(0).alias("kind"), F.explode(F.transform(every, lambda i: F.xxhash64(F.lit("s"), F.col("around"), i, without(i)))).alias("key"))
    own = short.select("id", "no", "h", "g", F.lit(1).alias("kind"), F.xxhash64(F.lit("i"), F.col("around"), F.col("w")).alias("key"))
    less = long_.select("id", "no", "h", "g", F.lit(2).alias("kind"), F.explode(F.array_distinct(F.transform(every, lambda i: F.xxhash64(F.lit("i"), F.col("around"), without(i))))).alias("key"))
    return same.union(own).union(less)


def near_lines(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """distinct: (h, g, n, id, no, keys), a row per line with its first place.  Returns (h, g) of lines with an earlier line within one edit."""
    keyed = distinct.select("h", "g", F.explode("keys").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    picked = keyed.join(shared, "k", "left_semi").select("h", "g").distinct()
    first = checkpoint(distinct.select("h", "g", "n", "id", "no").join(picked, ["h", "g"], "left_semi"))
    # Their texts: a document gives only the lines asked of it.
    asked = first.groupBy("id").agg(F.collect_list(F.struct("no", "h", "g", "n")).alias("asked"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"))
    # Both sides grow with the corpus, so this join, and the last one, are dealt by id at every size.
    found = texts.join(asked.hint("merge"), "id").select("id", F.split("text", "\n").alias("all"), F.explode("asked").alias("x"))
    found = found.select("id", "x.no", "x.h", "x.g", "x.n", F.get("all", F.col("x.no")).alias("line")).where(F.xxhash64("line") == F.col("h"))
    found = checkpoint(found.dropDuplicates(["h", "g"]))

    place = F.struct("id", "no", "h", "g")
    v = variants(checkpoint(windows(found)))
    heads = v.groupBy("key", F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, 2).otherwise(1).alias("for")).agg(F.min(place).alias("head"))
    pair = v.join(heads, (v["key"] == heads["key"]) & (v["kind"] == heads["for"])).where((F.col("head.id") < F.col("id")) | ((F.col("head.id") == F.col("id")) & (F.col("head.no") < F.col("no"))))
    pair = pair.select("h", "g", F.col("head.h").alias("h0"), F.col("head.g").alias("g0")).distinct()
    one = found.select("h", "g", "line")
    other = found.select(F.col("h").alias("h0"), F.col("g").alias("g0"), F.col("line").alias("line0"))
    checked = pair.join(one, ["h", "g"]).join(other, ["h0", "g0"]).where(F.levenshtein("line", "line0", 1) >= 0)
    return checked.select("h", "g").distinct()


def dedup_lines(docs: DataFrame, near_least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_near, text) for every row; text is what is left, its lines joined again."""
    every = lines(docs, near_least, id_col, text_col)
    distinct = every.groupBy("h", "g").agg(F.min(F.struct("id", "no")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    distinct = checkpoint(distinct.select("h", "g", "n", "copies", "first.id", "first.no", "keys"))
    near = near_lines(distinct, docs, id_col, text_col).withColumn("near", F.lit(True))
    first = distinct.select("h", "g", "copies", F.col("id").alias("id0"), F.col("no").alias("no0")).join(near, ["h", "g"], "left").where("copies > 1 or near")
    place = (F.col("id") == F.col("id0")) & (F.col("no") == F.col("no0"))
    hot = hot_keys(distinct.select("h", "g", F.col("copies").alias("n")), ["h", "g"])
    gone = salted_join(every.select("id", "no", "h", "g"), first, ["h", "g"], hot).withColumn("near", F.coalesce("near", F.lit(False))).where(~place | F.col("near"))
    gone = gone.groupBy("id").agg(F.collect_set(F.struct("no", place.alias("near"))).alias("gone"))
    gone = checkpoint(gone)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("id")).join(gone.hint("merge"), "id", "left")
    all_ = F.split("text", "\n")
    numbers = F.coalesce(F.transform("gone", lambda x: x["no"]), F.array().cast("array<int>"))
    kept = F.filter(all_, lambda x, i: ~F.array_contains(numbers, i))
    return out.select(
        "doc_id",
        F.coalesce(F.size(all_), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(F.filter("gone", lambda x: ~x["near"])), F.lit(0)).cast("bigint").alias("n_repeated"),
        F.coalesce(F.size(F.filter("gone", lambda x: x["near"])), F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
