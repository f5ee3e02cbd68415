"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into segments and mapped to the vector of their bit counts.  One flipped
bit moves one count by one, so the Manhattan distance of two vectors is at most the Hamming distance
of the fingerprints.  The vectors are cells of a grid; every distinct fingerprint looks into the
cells within the bound on one side (the other side is found from there) and the exact distance is
verified inside the join.  No link is lost whatever the number of segments; that number follows the
number of distinct fingerprints so that cells stay thin.

Null and empty texts have no words and fingerprint 0, which links like any other.  Very long texts are
hashed whole.  Equal texts and repeated rows share a fingerprint and so a component.  An empty table gives
no rows.  Other columns are ignored.  A null id never becomes a component's id
unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import checkpoint, hot_keys, salted_join, small_batches
from quiver.llm.components import components

SEED = 42
#: Candidates that a fingerprint may meet in its cells on average, for uniform fingerprints.
CANDIDATES = 24


def fingerprints_of(texts: list[str | None], words: int = 3) -> np.ndarray:
    """64-bit fingerprints: bit i is set if it is set in over half of the shingles' hashes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    ends: list[tuple[int, int]] = []

    def flush() -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.array([0] + [e for _, e in ends[:-1]])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        n = np.diff(np.array([0] + [e for _, e in ends]))
        set_ = (2 * sums > n[:, None]).astype(np.uint8)
        out[[i for i, _ in ends]] = np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1)
        hashes.clear()
        ends.clear()

    for i, text in enumerate(texts):
        w = (text or "").encode().lower().split()
        if not w:
            continue
        if len(w) <= words:
            hashes.append(digest(b" ".join(w), SEED))
        else:
            hashes.extend([digest(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(words)), strict=False)])
        ends.append((i, len(hashes)))
        if len(hashes) > 100_000:
            flush()
    if ends:
        flush()
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) for every row."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {kind}, fp bigint")


def cuts(segments: int) -> list[int]:
    """Bits of each segment."""
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def segments_for(n: int, distance: int) -> int:
    """The fewest segments, from 8 to 16, that keep the expected candidates of a fingerprint low."""
    for s in range(8, 16):
        if n * len(offsets(s, distance)) * prod(comb(2 * b, b) / 4**b for b in cuts(s)) <= CANDIDATES:
            return s
    return 16


def offsets(segments: int, distance: int) -> list[int]:
    """Cell moves within the Manhattan bound whose first step is up, and 0; a count takes 4 bits of a cell."""
    found = {(0,) * segments}
    edge = set(found)
    for _ in range(distance):
        edge = {v[:i] + (v[i] + d,) + v[i + 1 :] for v in edge for i in range(segments) for d in (1, -1)}
        found |= edge
    up = [v for v in found if next((x for x in v if x), 0) >= 0]
    return sorted(sum(x << (4 * i) for i, x in enumerate(v)) for v in up)


def cell(fp: Column, segments: int) -> Column:
    """The bit counts of the segments, 4 bits each.  A move below 0 gives 15 or 14, which no count is."""
    out, at = F.lit(0).cast("bigint"), 0
    for i, b in enumerate(cuts(segments)):
        count = F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << b) - 1).cast("bigint"))).cast("bigint")
        out = out.bitwiseXOR(F.shiftleft(count, 4 * i))
        at += b
    return out


def links(distinct: DataFrame, n: int, distance: int = 2, segments: int | None = None) -> DataFrame:
    """distinct: (fp), no repeats, n rows.  Returns (u, v): pairs of fingerprints that differ in 1 to distance bits."""
    s = segments or segments_for(n, distance)
    moves = [m - (1 << 64) if m >= 1 << 63 else m for m in offsets(s, distance)]
    home = distinct.select(F.col("fp").alias("v"), cell(F.col("fp"), s).alias("cell"))
    # try_add leaves out moves beyond 64 bits, which reach no cell.
    probe = distinct.select(F.col("fp").alias("u"), cell(F.col("fp"), s).alias("at"), F.explode(F.array(*[F.lit(m).cast("bigint") for m in moves])).alias("move"))
    probe = probe.select("u", F.expr("try_add(at, move)").alias("cell"), (F.col("move") == 0).alias("home"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return probe.join(home, (probe["cell"] == home["cell"]) & near & (~probe["home"] | (F.col("u") < F.col("v")))).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for every row; component_id is the least id that links reach.

    n_links counts the other fingerprints within the distance.
    """
    own = checkpoint(fingerprints(docs, words, id_col, text_col))
    classes = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = checkpoint(links(classes.select("fp"), classes.count(), distance))
    roots = components(found)
    ends = found.select(F.col("u").alias("fp")).union(found.select(F.col("v").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = classes.join(roots.withColumnRenamed("v", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("fp", "root").join(least, "root").join(ends, "fp").select("fp", "component_id", "n_links")
    of = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    # A third of all rows may have one fingerprint.
    return salted_join(own, of, ["fp"], hot_keys(classes, ["fp"])).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
