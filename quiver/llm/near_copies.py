"""Near copies by the Jaccard similarity of word shingles: SimHash with an exact check, and prefix filtering for the pairs beyond its bits.

A text is the set of its shingles; a text of fewer words is one shingle.  First the sets' SimHash
fingerprints over the same shingles are linked by op10's segment bit counts and grid range-join, and each
link is held to the similarity itself.  At similarity 0.8 fingerprints differ in more bits than a grid can
follow, so the pairs that they leave apart are found another way, which is exact alone: under one order of all
shingles, two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each,
so only sets that share such a key are compared.  The order puts shingles that a sample finds often
last; it bears on the cost alone.  Keys of the same sets are one key.  At the first key that two sets share, what
follows it in each bounds what they have in common, so far places are not compared, and of a pair's keys those are left out
that an earlier one of both sets shortly precedes.  Before two sets are compared, their sizes and the parities of
their shingles in 512 cells, which the rows of keys carry, bound the similarity from above.
In 512 cells the parities of a long set say next to nothing, so sets of more shingles also have them in as many cells as
shingles or more, and a pair of such sets is held to these before its texts are read.

Of each key's sets, first all may be compared with one of them, twice, each set with the two most similar such partners at most.  Then every pair of a key that
links have not yet brought into one component is compared.  No pair is left out: a component holds
what links over pairs of similarity 0.8 reach.

Null and empty texts have the empty set and are copies of each other.  Very long texts are whole sets like
any other.  Repeated rows have one set.  A null id never becomes a component's id unless all ids of the
component are null.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm import simhash
from quiver.llm.common import checkpoint, hot_keys, release, salted_join, small_batches, small_join, stored
from quiver.llm.components import components_by_size
from quiver.llm.decontamination import windows

WORDS = 5
#: Least similarity, as a fraction of whole numbers.
PART, OF = 4, 5
#: Texts of the sample that ranks shingles, and the most shingles that it ranks.
SAMPLE, RANKED = 4_000, 100_000
#: Comparisons of each key's sets with one of them, before the pairs.
ROUNDS = 2
#: Words of 64 cells.
CELLS = 8
#: Keys before a key, in the order of its set, that go with it.
BEFORE = 4
#: Bits that fingerprints may differ in to be linked by the grid.
BITS = 2
MEMORY = 300_000


class Shingles:
    """The sorted distinct shingle hashes of a text; remembers words up to a bound."""

    def __init__(self, words: int) -> None:
        import xxhash

        self.words, self.hash = words, xxhash.xxh3_64_intdigest
        self.codes: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        codes = self.codes
        if len(codes) > MEMORY:
            codes.clear()
        for w in set(found):
            if w not in codes:
                codes[w] = self.hash(w)
        return np.unique(windows(np.array([codes[w] for w in found], np.uint64), min(self.words, len(found))))


def name_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else 0


def prefix(shingles: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The keys of a set: its first shingles in the order (rank, hash)."""
    n = len(shingles)
    if not n:
        return shingles
    place = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        place = np.where(often[at] == shingles, rank[at], 0)
    return shingles[np.lexsort((shingles, place))[: n + PART * n // -OF + 1]]


def parities(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(55)).astype(np.int64), minlength=64 * CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fine_parities(shingles: np.ndarray) -> bytes | None:
    """Parities by the lowest bits in a power of two of cells, at least one for a shingle; None where parities() do."""
    if len(shingles) <= 64 * CELLS:
        return None
    cells = 1 << (len(shingles) - 1).bit_length()
    odd = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many shingles only one of two sets has; the finer parities are folded to the coarser."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def often_seen(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts holds more than once, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(words), set()
        for b in batches:
            for t in b.column("text").to_pylist():
                s = shingles.of(t)
                if (name := name_of(s)) not in seen:
                    seen.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    every = max(1, -(-texts.count() // SAMPLE))
    counts = texts.where(F.pmod("h", F.lit(every)) == 0).select("text").mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where("n > 1").orderBy(F.desc("n"), "s").limit(RANKED).collect()
    found = sorted((r["s"] % (1 << 64), r["n"]) for r in rows)
    return np.array([s for s, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def sets(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, fp, n, print, cells, fine, keys) for every row; print (SimHash), cells, fine and keys only where the task has not met the set before."""
    often = texts.sparkSession.sparkContext.broadcast(often_seen(texts, words))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(words), set()
        for b in batches:
            whole = b.column("text").to_pylist()
            found = [shingles.of(t) for t in whole]
            names = [name_of(s) for s in found]
            first, cells, fine, keys = [], [], [], []
            for i, (name, s) in enumerate(zip(names, found, strict=True)):
                new = name not in seen
                seen.add(name)
                if new:
                    first.append(i)
                cells.append(parities(s) if new else np.zeros(0, np.int64))
                fine.append(fine_parities(s) if new else None)
                keys.append(prefix(s, *often.value) if new else np.zeros(0, np.uint64))
            prints = dict(zip(first, simhash.fingerprints_of([whole[i] for i in first], words).view(np.int64).tolist(), strict=True))
            prints = pa.array([prints.get(i) for i in range(len(whole))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(names, pa.int64()), pa.array(list(map(len, found)), pa.int64()), prints, lists(cells), pa.array(fine, pa.binary()), lists(keys)], ["doc_id", "h", "fp", "n", "print", "cells", "fine", "keys"])

    return texts.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint, n bigint, print bigint, cells array<bigint>, fine binary, keys array<bigint>")


def differ(a: str, b: str) -> Column:
    """Cells whose parities differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.c{i}").bitwiseXOR(F.col(f"{b}.c{i}"))) for i in range(CELLS)]).cast("bigint")


def may_link(a: str, b: str) -> Column:
    """Whether sizes and parities leave room for the similarity: at most (OF - PART) / (OF + PART) of both sizes differ."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (F.least(f"{a}.n", f"{b}.n") * OF >= F.greatest(f"{a}.n", f"{b}.n") * PART) & (differ(a, b) * (OF + PART) <= n * (OF - PART))


def may_start(a: str, b: str) -> Column:
    """Whether a pair that is similar enough could have its first shared key here: all that it shares follows at.  Keys that are one have the least at of theirs."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return left * (OF + PART) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * PART


def by_prints(cells: DataFrame) -> DataFrame:
    """Pairs (u, v, d) of sets that SimHash links and sizes and parities leave: each set with one of its fingerprint, and those of fingerprints at most BITS apart."""
    heads = checkpoint(cells.groupBy("print").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")))
    # Many sets may have one fingerprint.
    same = salted_join(cells.select("print", "fp"), heads.select("print", "head"), ["print"], hot_keys(heads, ["print"]))
    near = simhash.links(heads.select(F.col("print").alias("fp")), heads.count(), BITS)
    ends = [heads.select(F.col("print").alias(x), F.col("head").alias(f"head_{x}")) for x in "uv"]
    near = near.join(ends[0], "u").join(ends[1], "v").select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))
    pairs = checkpoint(same.where("fp <> head").select(F.col("head").alias("u"), F.col("fp").alias("v")).union(near))
    a, b = cells.alias("a"), cells.alias("b")
    both = pairs.join(a, F.col("u") == F.col("a.fp")).join(b, F.col("v") == F.col("b.fp"))
    return both.where(may_link("a", "b")).select("u", "v", differ("a", "b").alias("d"))


def near_enough(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs (u, v, d) without those whose fine parities differ too much; d is how much they do at least.  fine: (fp, n, fine) for the sets that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, keep = [], []
            for d, nu, nv, fu, fv in zip(*(b.column(c).to_pylist() for c in ("d", "nu", "nv", "fu", "fv")), strict=True):
                known = fu is not None and fv is not None
                least.append(least_difference(fu, fv) if known else d)
                keep.append(not known or least[-1] * (OF + PART) <= (nu + nv) * (OF - PART))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(least, pa.int64())], ["u", "v", "d"]).filter(pa.array(keep, pa.bool_()))

    one = fine.select(F.col("fp").alias("u"), F.col("n").alias("nu"), F.col("fine").alias("fu"))
    other = fine.select(F.col("fp").alias("v"), F.col("n").alias("nv"), F.col("fine").alias("fv"))
    both = pairs.join(one, "u", "left").join(other, "v", "left")
    return both.select("u", "v", "d", "nu", "nv", "fu", "fv").mapInArrow(run, "u bigint, v bigint, d bigint")


def verified(pairs: DataFrame, names: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar enough.  names: (fp, h).

    Only texts of the pairs' sets are read again, and texts travel, as they are smaller than their shingles.
    """
    ends = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()
    needed = checkpoint(names.join(ends, "fp", "left_semi"))
    picked, drop = stored(small_join(texts.select("h", "text"), needed, ["h"]).select("fp", "text").dropDuplicates(["fp"]))
    release(pairs.sparkSession)
    one = picked.select(F.col("fp").alias("u"), F.col("text").alias("tu"))
    other = picked.select(F.col("fp").alias("v"), F.col("text").alias("tv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            keep = []
            for tu, tv in zip(b.column("tu"), b.column("tv"), strict=True):
                su, sv = shingles.of(tu.as_py()), shingles.of(tv.as_py())
                both = len(np.intersect1d(su, sv, assume_unique=True))
                keep.append(both * (OF + PART) >= (len(su) + len(sv)) * PART)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = checkpoint(pairs.join(one, "u").join(other, "v").select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint"))
    drop()
    return found


def links(own: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """own: what sets() gives.  Returns (v, root) for the sets of every component of more than one."""
    cells = own.where("size(cells) > 0").select("fp", "n", "print", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(CELLS)]).dropDuplicates(["fp"])
    cells = checkpoint(cells)
    fine = checkpoint(own.where("fine is not null").select("fp", "n", "fine").dropDuplicates(["fp"]))
    names = checkpoint(own.groupBy("fp").agg(F.min("h").alias("h")))
    found = verified(checkpoint(near_enough(by_prints(cells), fine).select("u", "v")), names, texts, words)
    roots = checkpoint(components_by_size(found))
    release(own.sparkSession)
    # Keys that one set alone has are most of them and go first, with nothing else in their rows.  A key's name is
    # then a hash of its sets, so that keys of the same sets are one; keys whose hashes agree by chance only get more sets.
    key = Window.partitionBy("key")
    keyed = own.where("size(keys) > 0").select("fp", F.posexplode("keys").alias("at", "key"))
    keyed = keyed.withColumns({"a": F.min("fp").over(key), "b": F.max("fp").over(key)}).where("a <> b").select("key", "fp", "at").distinct()
    keyed = keyed.withColumn("name", F.bit_xor(F.xxhash64("fp")).over(key)).groupBy(F.col("name").alias("key"), "fp").agg(F.min("at").alias("at"))
    shared, drop_shared = stored(keyed)
    before = F.collect_list("key").over(Window.partitionBy("fp").orderBy("at", "key").rowsBetween(-BEFORE, -1))
    keyed, drop_keyed = stored(shared.withColumn("before", before).join(cells.drop("print"), "fp"))
    drop_shared()
    release(keyed.sparkSession)
    for k in range(ROUNDS + 1):
        placed = keyed.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        placed, drop_placed = stored(placed.join(mixed, "key", "left_semi"))
        a, b = placed.alias("a"), placed.alias("b")
        apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & may_start("a", "b") & may_link("a", "b")
        if k < ROUNDS:
            row = [c for c in placed.columns if c != "key"]
            heads = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", "key", F.lit(k)).alias("order"), *row)).alias("x"))
            a = heads.select("key", *[F.col(f"x.{c}").alias(c) for c in row]).alias("a")
        else:
            # A key before this one in both sets brings the pair too, and starts no later in either.
            apart &= (F.col("a.fp") < F.col("b.fp")) & ~F.arrays_overlap("a.before", "b.before")
        pairs, drop_pairs = stored(a.join(b, apart).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), differ("a", "b").alias("d")).distinct())
        drop_placed()
        near = near_enough(pairs, fine)
        if k < ROUNDS:
            # Two partners of each set are enough here; the last round compares all that these leave apart.
            near = near.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where("at <= 2")
        found = checkpoint(found.union(verified(checkpoint(near.select("u", "v")), names, texts, words)))
        roots = checkpoint(components_by_size(found))
        drop_pairs()
        release(roots.sparkSession)
    drop_keyed()
    return roots


def near_classes(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, root, component_id) for every row: h names the text, root the component, and component_id is the least id that links reach."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = checkpoint(sets(texts, words))
    roots = links(own, texts, words).withColumnRenamed("v", "fp")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = checkpoint(classes)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = classes.join(least, "root").select("fp", "root", "component_id")
    # Many rows may have one set.
    return salted_join(own.select("doc_id", "h", "fp"), of, ["fp"], hot_keys(classes, ["fp"])).select("doc_id", "h", "root", "component_id")


def near_copies(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row; component_id is the least id that links reach."""
    return near_classes(docs, words, id_col, text_col).select("doc_id", "component_id")
