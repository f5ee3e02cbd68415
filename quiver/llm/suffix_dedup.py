"""Suffix-array dedup: removal of every byte in a T-byte string that also starts earlier in the corpus.

Earlier: smaller (id, start).  The T-byte strings are first dealt out by content: each has one anchor,
the k-mer of least hash in it (the first of equals), and neighbouring starts with the same anchor form
a unit.  Equal strings have the same anchor, so only units whose anchor occurs again can hold a repeat;
units that are equal as a whole are settled by their first occurrence.  What is left, different units
around one anchor, goes in buckets of bounded size to the suffix structure: a suffix array ordered by
T bytes, its Burrows-Wheeler transform, and a breadth-first backward extension of intervals, which
finds the common prefix lengths in increasing order and stops below T.  Suffixes that no boundary
separates share T bytes; all but the earliest are repeats.  Anchors with very many different units
are settled by hashes of their strings instead, which spreads them over all tasks.

Null and empty texts and texts shorter than T have nothing to remove.  Rows that share an id are judged
as one document, by their starts.  A null id is before all others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import checkpoint, release, small_batches

#: Bytes of a string that counts as repeated, and of an anchor's k-mer.
LENGTH, KMER = 100, 36
#: Starts that are cut into units at once, in very long texts.
PIECE = 1 << 22
#: Bytes of units in a bucket, about; units of an anchor that go into buckets, at most.
BUCKET_BYTES, MOST_UNITS = 1 << 21, 5_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]))
    return have[:n]


def units(text: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of each unit of the text."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(text) - length + 1), PIECE):
        x = np.frombuffer(text, np.uint8, min(len(text) - at, PIECE + length - 1), at).astype(np.uint64)
        n = len(x)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        h = (sums[kmer:] - sums[:-kmer]) * powers(_INVERSE, n - kmer + 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, span = length - kmer + 1, 1
        while span * 2 <= width:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < width:
            v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
        place = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([np.zeros(1, np.int64), cut])
        last = np.concatenate([cut, np.array([len(place)])]) - 1
        out.append((h[place[first]].view(np.int64), first + at, last + at))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def unit_hashes(text: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(text[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64).view(np.int64)


def first_of(a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Whether each (a, u) is the first of its kind."""
    order = np.lexsort((np.arange(len(a)), u, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (u[order][1:] != u[order][:-1])
    out = np.empty(len(a), bool)
    out[order] = new
    return out


def suffix_order(codes: np.ndarray, length: int) -> np.ndarray:
    """Suffix array by the first length symbols; codes are uint8, beyond the end counts as 0."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    done = min(8, length)
    if done < 8:
        key >>= np.uint64(8 * (8 - done))
    small = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(key).astype(small)
    rank = np.empty(n + 1, small)
    rank[n] = -1
    tied = np.arange(n, dtype=small)  # places of order whose suffixes are not yet told apart
    ranked = key[order]
    while True:
        # Equal keys of neighbours in order have the rank of the first of them.
        new = np.ones(len(tied), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, small(0)))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if done == length or not len(tied):
            return order
        step = min(done, length - done)
        at = order[tied]
        key = rank[at] * np.int64(n + 2) + rank[np.minimum(at + small(step), small(n))]
        # A group's places stay its own, as its rank comes first in the key.
        by = np.argsort(key)
        order[tied], ranked = at[by], key[by]
        done += step


def boundaries(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array, whether its common prefix with the place before is below length.

    Intervals of the Burrows-Wheeler transform are extended to the left by every symbol, breadth first.
    An extension of an interval of depth d whose end is not yet marked has common prefix d there.
    Intervals of depth length - 1 are the last; what is unmarked then shares length symbols or more.
    Symbol 0 separates texts; strings with one inside are not asked for, so it is put in front only once.
    """
    n = len(codes)
    small = order.dtype.type
    bwt = codes[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, small)
    lf[by_symbol] = np.arange(n, dtype=small)
    mark = np.zeros(n + 1, bool)
    mark[0] = mark[n] = True
    lo, hi = np.zeros(1, small), np.full(1, n, small)
    for depth in range(length):
        if not len(lo):
            break
        size = hi - lo
        owner = np.repeat(np.arange(len(lo), dtype=small), size)
        place = np.arange(len(owner), dtype=small) + np.repeat((lo - (np.cumsum(size) - size)).astype(small), size)
        symbol, to = bwt[place], lf[place]
        if depth:
            inside = symbol > 0
            owner, symbol, to = owner[inside], symbol[inside], to[inside]
        if not len(to):
            break
        rank = np.argsort(symbol, kind="stable")  # the order of to: places ascend, and lf does so within a symbol
        owner, symbol, to = owner[rank], symbol[rank], to[rank]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        start = np.flatnonzero(new)
        end = to[np.append(start[1:], len(to)) - 1] + 1
        start = to[start]
        fresh = ~mark[end]
        mark[end[fresh]] = True
        lo, hi = start[fresh], end[fresh]
    return mark[:n]


def repeated_starts(texts: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text number, offset) of strings of length bytes that occur in the texts at a smaller (id, start + offset)."""
    sizes = np.array([len(t) for t in texts])
    codes = np.zeros(int(sizes.sum()) + len(texts), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    for t, b in zip(texts, begin.tolist(), strict=True):
        codes[b : b + len(t)] = np.frombuffer(t, np.uint8) + 1  # no byte of UTF-8 is 255
    order = suffix_order(codes, length)
    group = np.cumsum(boundaries(codes, order, length))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(codes)) - begin[owner]
    valid = (offset + length <= sizes[owner])[order]
    group, at = group[valid], order[valid]
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    several = same[1:] | same[:-1]
    group, at = group[several], at[several]
    own, off = owner[at], offset[at]
    rank = np.lexsort((starts[own] + off, ids[own], group))
    group, own, off = group[rank], own[rank], off[rank]
    again = np.zeros(len(group), bool)
    again[1:] = group[1:] == group[:-1]
    return own[again], off[again]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Ascending places as (first, last) of runs without a gap."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(places, cut)]


LOWEST = -(1 << 63)


def removed(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gone: array of (first, last start)) of texts with strings that start earlier in other places of the corpus.

    Repeats of a unit within its own text are not listed; cut() finds them.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)

    wide = 1 << (length - kmer + 1).bit_length()  # a unit's place: first start times wide, plus its further starts

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [units(t.encode(), length, kmer)[0] for t in b.column("text").to_pylist()]
            a, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n.astype(np.int32))], ["a", "n"])

    def all_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
                for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    raw = t.encode()
                    a, first, last = units(raw, length, kmer)
                    u = unit_hashes(raw, first, last, length)
                    new = first_of(a, u)
                    for column, x in zip(out, (a, u, np.full(len(a), i), first * wide + last - first), strict=True):
                        column.append(x[new])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "u", "id", "at"])

    again = slim.select("text").mapInArrow(anchors, "a bigint, n int").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    again = checkpoint(again)
    release(again.sparkSession)
    found = slim.mapInArrow(all_units, "a bigint, u bigint, id bigint, at bigint").join(again, "a")
    found = checkpoint(found)
    del again
    release(found.sparkSession)
    heads = found.groupBy("a", "u").agg(F.min(F.struct("id", "at")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = checkpoint(heads.select("a", "u", "n", "head.id", "head.at"))
    # Whole units that occur earlier.
    head = heads.where("n > 1").select("a", "u", F.col("id").alias("id0"), F.col("at").alias("at0"))
    place = [F.expr(f"at div {wide}").alias("first"), F.expr(f"at div {wide} + at % {wide}").alias("last")]
    equal = checkpoint(found.join(head, ["a", "u"]).where("id > id0 or id = id0 and at > at0").select("id", "at"))
    # Different units around one anchor.
    sizes = heads.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = checkpoint(heads.join(sizes, "a").select("a", "u", "id", *place, "k"))
    del found, heads, head, sizes
    release(mixed.sparkSession)
    total = mixed.where(F.col("k") <= MOST_UNITS).agg(F.sum(F.expr(f"last - first + {length}"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    asked = mixed.groupBy("id").agg(F.collect_list(F.struct("a", "u", "first", "last", "k")).alias("asked"))
    raw = F.encode("text", "UTF-8")
    fetched = slim.join(asked, "id").select("id", raw.alias("raw"), F.explode("asked").alias("x"))
    fetched = fetched.select("id", "x.*", F.expr(f"substring(raw, cast(x.first as int) + 1, cast(x.last - x.first as int) + {length})").alias("bytes"))
    fetched = checkpoint(fetched.drop("raw").withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets))))
    del mixed, asked
    release(fetched.sparkSession)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        right = [xxhash.xxh3_64_intdigest(b) == u & 0xFFFFFFFFFFFFFFFF for b, u in zip(pdf["bytes"], pdf["u"].tolist(), strict=True)]
        pdf = pdf[right].reset_index(drop=True)
        if pdf.empty:
            return pd.DataFrame({"id": [], "first": [], "last": []}, dtype="int64")
        own, off = repeated_starts([bytes(b) for b in pdf["bytes"]], pdf["id"].to_numpy(), pdf["first"].to_numpy(), length)
        rank = np.lexsort((off, own))
        own, off = own[rank], off[rank]
        rows = []
        cut = np.flatnonzero(np.diff(own)) + 1
        for part in np.split(np.arange(len(own)), cut):
            if len(part):
                k = int(own[part[0]])
                i, base = int(pdf["id"].iat[k]), int(pdf["first"].iat[k])
                rows += [(i, base + a, base + b) for a, b in runs(off[part])]
        return pd.DataFrame(rows, columns=["id", "first", "last"]).astype("int64")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, first, data in zip(b.column("id").to_pylist(), b.column("first").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                rows += [(hashlib.blake2b(data[o : o + length], digest_size=16).digest(), i, first + o) for o in range(len(data) - length + 1)]
            h, ids, at = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(ids, pa.int64()), pa.array(at, pa.int64())], ["h", "id", "at"])

    dealt = fetched.where(F.col("k") <= MOST_UNITS).groupBy("bucket").applyInPandas(settle, "id bigint, first bigint, last bigint")
    many = fetched.where(F.col("k") > MOST_UNITS).select("id", "first", "bytes").mapInArrow(strings, "h binary, id bigint, at bigint")
    least = many.groupBy("h").agg(F.min(F.struct("id", "at")).alias("least"))
    spread = many.join(least, "h").where("id > least.id or id = least.id and at > least.at").select("id", F.col("at").alias("first"), F.col("at").alias("last"))
    return equal.select("id", *place).union(dealt).union(spread).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("gone"))


def cut(text: bytes, gone: list[tuple[int, int]], length: int = LENGTH, kmer: int = KMER) -> tuple[list[tuple[int, int]], bytes]:
    """(removed spans as [start, end), kept bytes), from the starts found elsewhere and the text's own repeated units."""
    if len(text) < length:
        return [], text
    a, first, last = units(text, length, kmer)
    ranked = np.sort(a)
    if (ranked[1:] == ranked[:-1]).any():
        again = ~first_of(a, unit_hashes(text, first, last, length))
    else:  # no anchor twice, so no unit
        again = np.zeros(len(a), bool)
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, first[again], 1)
    np.add.at(step, last[again] + length, -1)
    if gone:
        g = np.array(gone, np.int64)
        g = g[g[:, 1] + length <= len(text)]
        np.add.at(step, g[:, 0], 1)
        np.add.at(step, g[:, 1] + length, -1)
    covered = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)), kept


def dedup_strings(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with_bytes adds spans and kept (binary)."""
    gone = removed(docs, length, kmer, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("id"))
    kind = base.schema["doc_id"].dataType.simpleString()
    joined = base.join(gone, "id", "left").select("doc_id", "text", F.col("gone.first").alias("first"), F.col("gone.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, first, last in zip(b.column("text").to_pylist(), b.column("first").to_pylist(), b.column("last").to_pylist(), strict=True):
                raw = (t or "").encode()
                spans, kept = cut(raw, list(zip(first or [], last or [], strict=True)), length, kmer)
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in spans], kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            n = 6 if with_bytes else 4
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][:n]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)]], ["doc_id", *names])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start:bigint,end:bigint>>, kept binary" * with_bytes)
