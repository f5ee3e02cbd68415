"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words into lower
case.  There are two readings of a text: one in which words with a capital inside a sentence are names, and
one without names, which capitals don't bear on; so copies in other case are found too.  The hashes of
the windows of template words of both readings are a table, and Spark joins it with that of the benchmark.
An item is a candidate for a text if it may have enough of its windows there.  The two texts of a candidate
pair are then aligned: an item counts by the share of its windows that one neighbourhood of alignments
covers, or by a long run of them, and only if the slots agree: within that match, one value of the
benchmark's slots must stand for one value of the document's.  So a question with other numbers or names
is caught, while the same template around unrelated values isn't.

Windows that very many items have are left out of the join and counted as found, so that they can cost no
candidate; items that consist of little else keep theirs.  Items shorter than a window match as a whole.
Null and empty texts match nothing.  Very long texts are read whole.  Repeated rows share one result, repeated
items are rows of their own.  An empty benchmark flags nothing.  Other columns are kept where the caller keeps them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import BROADCAST_BYTES, checkpoint, small_batches, small_join

WINDOW = 8
#: Share of an item's windows that a document must hold.
COVER = 0.5
#: Windows in one neighbourhood that are enough whatever the share.
RUN = 24
#: Items that may have a window before it counts as common.
COMMON = 100
#: Parts that the documents' windows of a hash are dealt into where the benchmark's windows are no broadcast.
PARTS = 16

#: Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs pound pounds oz ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent pct "
    "dollar dollars cent cents euro euros usd eur gbp degree degrees c f k w kw j kj hz khz mhz v a kb mb gb".split()
)

NUMBER, NAME, UNIT = 1, 2, 3
WORD = r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]"


class Templates:
    """Turns texts into arrays of template codes; remembers words up to a bound."""

    def __init__(self, memory: int = 300_000) -> None:
        import re

        import xxhash

        self.find = re.compile(WORD).findall
        self.hash = xxhash.xxh3_64_intdigest
        self.memory = memory
        self.codes: dict[str, int] = {}

    def code(self, word: str) -> int:
        # 0: sentence end, 1: number; else a hash whose bit 0 says capitalised and whose bit 4 says no unit.
        if word in ".!?\n":
            return 0
        if word[0].isdigit():
            return NUMBER
        low = word.lower()
        return (self.hash(low) | 31) ^ (30 if low in UNITS else 14) ^ (0 if word[0] != low[0] else 1)

    def words(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The text's words and sentence ends, the places of the words among them, and the words' codes with and without names."""
        found = self.find(text)
        codes = self.codes
        if new := {w for w in set(found) if w not in codes}:
            if len(codes) + len(new) > self.memory:
                codes.clear()
                new = set(found)
            for w in new:
                codes[w] = self.code(w)
        all_ = np.array([codes[w] for w in found], np.uint64)
        if not len(all_):
            return [], np.zeros(0, np.int64), all_, all_
        before = np.concatenate([np.zeros(1, np.uint64), all_[:-1]])
        kind = all_ & np.uint64(31)
        # Capital inside a sentence: a name.  At its start: the plain word.
        name = (all_ > 31) & (kind & np.uint64(1) == 1) & (before != 0)
        unit = (all_ > 31) & (kind & np.uint64(16) == 0) & (before == NUMBER)
        plain = np.where(unit, np.uint64(UNIT), np.where(all_ > 31, all_ | np.uint64(31), all_))
        keep = np.flatnonzero(all_)
        return found, keep, np.where(name, np.uint64(NAME), plain)[keep], plain[keep]


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of size codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def consistent(pairs: list[tuple[str, str, int]]) -> bool:
    """Whether each benchmark value of a kind stands for one document value, and the other way round for names."""
    to: dict[tuple[str, int], str] = {}
    back: dict[tuple[str, int], str] = {}
    for a, b, kind in pairs:
        if to.setdefault((a, kind), b) != b or (kind == NAME and back.setdefault((b, kind), a) != a):
            return False
    return True


def alignments(places: dict[int, list[int]], texts: list, size: int, cover: float) -> Iterator[dict[int, int]]:
    """The ways to give each place of the item one of its places in the document.

    Windows of a row of placeholders hash alike, so a place can have many.  Each offset is tried, with
    the nearest place for windows that don't have it; then the places with the most equal values, and
    the windows whose values are all equal, if they are enough.
    """
    if all(len(ds) == 1 for ds in places.values()):
        yield {p: ds[0] for p, ds in places.items()}
        return
    offsets = Counter(d - p for p, ds in places.items() for d in ds)
    order = sorted(offsets, key=lambda o: (-offsets[o], o))
    for o in order:
        yield {p: min(ds, key=lambda d: (abs(d - p - o), d)) for p, ds in places.items()}
    own, words, keep, kinds = texts

    def differ(p: int, d: int) -> int:
        return sum(own[p + i].lower() != words[keep[d + i]].lower() for i in range(size) if kinds[p + i] <= UNIT)

    nearest = {p: min((differ(p, d), abs(d - p - order[0]), d) for d in ds) for p, ds in places.items()}
    yield {p: d for p, (_, _, d) in nearest.items()}
    equal = {p: d for p, (n, _, d) in nearest.items() if not n}
    if len(equal) >= cover * max(1, len(kinds) - size + 1):
        yield equal


def matched(doc: tuple, item: tuple, size: int, cover: float, run: int) -> tuple[int, float, bool]:
    """(windows hit, share of the item's windows, whether the slots agree) of the best reading; no window if none is enough.

    doc, item: what Templates.words() gives for them.
    """
    words, keep = doc[:2]
    own = [item[0][i] for i in item[1]]
    best = (0, 0.0, False)
    for reading in (2, 3):
        kinds, n = item[reading], min(size, len(own))
        wanted, have = windows(kinds, n), windows(doc[reading], n)
        order = np.argsort(have, kind="stable")
        low, high = (np.searchsorted(have[order], wanted, side) for side in ("left", "right"))
        # Words put in or left out move the alignment; a quarter of the item is a neighbourhood.
        span = max(4, len(own) // 4)
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for place in np.flatnonzero(high > low).tolist():
            for d in order[low[place] : high[place]].tolist():
                for near in {(d - place) // span, (d - place + span // 2) // span + (1 << 40)}:
                    found[near][place].append(d)
        least = min(cover * max(1, len(wanted)), run)
        for places in found.values():
            if len(places) < least:
                continue
            for chosen in alignments(places, [own, words, keep, kinds], n, least / max(1, len(wanted))):
                slots = {(p + i, d + i) for p, d in chosen.items() for i in range(n) if kinds[p + i] <= UNIT}
                ok = consistent([(own[p].lower(), words[keep[d]].lower(), int(kinds[p])) for p, d in sorted(slots)])
                best = max(best, (len(chosen), len(chosen) / max(1, len(wanted)), ok), key=lambda m: (m[2], m[1]))
                if ok:
                    break
        if best[0]:  # what the reading with names finds stands, other names for one name too
            break
    return best


def window_table(texts: DataFrame, key: str, sizes: list[int], short: bool) -> DataFrame:
    """texts: (key bigint, text).  Returns (key, n, w, at): the number of windows of a reading, the hashes of both readings' windows of each size and their places.

    short: there is one size, and texts under it are one window.  Windows without a name are in the table once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            counts, hashes, places = [], [], []
            for text in b.column(1).to_pylist():
                _, _, codes, plain = t.words(text or "")
                own, at = [], []
                named = (codes == NAME).any()
                for size in sizes if not short else [min(sizes[0], len(codes))] * (len(codes) > 0):
                    own.append(windows(codes, size))
                    at.append(np.arange(len(own[-1])))
                    if named:
                        second = windows(plain, size)
                        at.append(np.flatnonzero(own[-1] != second))
                        own.append(second[at[-1]])
                counts.append(len(own[0]) if own else 0)
                hashes.append(np.concatenate(own) if own else np.zeros(0, np.uint64))
                places.append(np.concatenate(at) if at else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32))
            flat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat(hashes, np.uint64).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(flat(places, np.int32)))],
                [key, "n", "w", "at"],
            )

    return texts.select(key, "text").mapInArrow(run, f"{key} bigint, n int, w array<bigint>, at array<int>")


def candidates(docs: DataFrame, items: DataFrame, size: int, cover: float, run: int) -> DataFrame:
    """docs: (th, text), items: (ik, text).  Returns (th, ik) of pairs whose windows may be enough."""
    table = checkpoint(window_table(items, "ik", [size], True).select("ik", "n", F.explode(F.arrays_zip("w", "at")).alias("x")).select("ik", "n", F.col("x.w").alias("w"), F.col("x.at").alias("at")).distinct())
    # Of each item's windows those that are common, and what the others must give.
    common = table.groupBy("w").agg(F.count_distinct("ik").alias("k")).where(F.col("k") > COMMON).select("w", F.lit(True).alias("common"))
    flagged = table.join(common, "w", "left")
    wide = flagged.groupBy("ik").agg(F.count_distinct(F.when(F.col("common"), F.col("at"))).alias("loose"))
    flagged = flagged.join(wide, "ik").withColumn("need", F.least(F.ceil(F.lit(cover) * F.col("n")), F.lit(run)))
    flagged = flagged.withColumn("need", F.when(F.col("loose") < F.col("need"), F.col("need") - F.col("loose")).otherwise(F.col("need"))).withColumn("all", F.least(F.ceil(F.lit(cover) * F.col("n")), F.lit(run)) == F.col("need"))
    wanted = checkpoint(flagged.where(F.col("common").isNull() | F.col("all")).select("w", "ik", "at", "need"))
    # Items under a window's length have hashes of their own length; there are size - 1 of these at most.
    found = window_table(docs, "th", [size, *short_sizes(items, size)], False).select("th", F.explode("w").alias("w"))
    bytes_ = 32 * wanted.count()
    if bytes_ <= BROADCAST_BYTES:
        hits = found.join(F.broadcast(wanted), "w")
    else:
        dealt = found.withColumn("part", F.pmod("th", F.lit(PARTS)))
        hits = dealt.join(wanted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")))), ["w", "part"])
    hits = hits.select("th", "ik", "at", "need").distinct()
    return hits.groupBy("th", "ik").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need")).where("k >= need").select("th", "ik")


def short_sizes(items: DataFrame, size: int) -> list[int]:
    """Lengths below size that items have: fewer than size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(size, len(t.words(x or "")[2])) for x in b.column(0).to_pylist()], pa.int32())], ["k"])

    rows = items.select("text").mapInArrow(run, "k int").distinct().collect()
    return sorted(r["k"] for r in rows if 0 < r["k"] < size)


def verified(pairs: DataFrame, size: int, cover: float, run: int) -> DataFrame:
    """pairs: (th, item, text, item_text).  Returns (th, item, cover, agree) of those with enough windows aligned."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, doc = Templates(), None, None
        for b in batches:
            out = []
            for th, item, text, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if th != last:
                    last, doc = th, t.words(text)
                n, share, agree = matched(doc, t.words(own), size, cover, run)
                if n:
                    out.append((th, item, share, agree))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["th", "item", "cover", "agree"])

    return pairs.select("th", "item", "text", "item_text").mapInArrow(go, "th bigint, item bigint, cover double, agree boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Every row of docs with its matches: (doc_id, n_items, items, best_cover, leaked), where items are the ids of the
    items that it holds with agreeing slots and n_templates counts items whose template alone it holds.

    keep_columns: all columns of docs come first and the results are named leak_*.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = (docs.drop("leak_items", "leak_templates", "leak_cover", "leaked", "th_") if keep_columns else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))).withColumn("th_", F.xxhash64(text))
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    items = checkpoint(benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).withColumn("ik", F.xxhash64("item", "text")).dropDuplicates(["ik"]))
    pairs = checkpoint(candidates(texts, items.select("ik", "text"), size, cover, run))
    # Texts of candidates, one of each, beside the items' texts.
    asked = pairs.select("th").distinct()
    one = checkpoint(small_join(texts, asked, ["th"], "left_semi", width=F.lit(16)).dropDuplicates(["th"]))
    both = pairs.join(one, "th").join(items.select("ik", "item", F.col("text").alias("item_text")), "ik")
    found = verified(both, size, cover, run).groupBy("th").agg(
        F.array_sort(F.collect_set(F.when(F.col("agree"), F.col("item")))).alias("leak_items"),
        F.count(F.when(~F.col("agree"), F.lit(1))).alias("leak_templates"),
        F.max(F.when(F.col("agree"), F.col("cover"))).alias("leak_cover"),
        F.count(F.when(F.col("agree"), F.lit(1))).alias("n"),
    )
    found = checkpoint(found.withColumnRenamed("th", "th_"))
    out = small_join(base, found, ["th_"], "left", width=F.lit(48) + 8 * F.size("leak_items"))
    out = out.withColumns({
        "leak_items": F.coalesce("leak_items", F.array().cast("array<bigint>")), "leak_templates": F.coalesce("leak_templates", F.lit(0)).cast("bigint"),
        "leak_cover": F.coalesce("leak_cover", F.lit(0.0)), "leaked": F.coalesce(F.col("n") > 0, F.lit(False)),
    }).drop("th_", "n")
    if keep_columns:
        return out
    return out.select("doc_id", F.size("leak_items").cast("bigint").alias("n_items"), F.col("leak_items").alias("items"), F.col("leak_templates").alias("n_templates"), F.col("leak_cover").alias("best_cover"), "leaked")
