"""Sharding by Karmarkar-Karp differencing, for groups of equal texts that stay together.

Differencing runs in two levels so that no task sees all groups: groups are dealt by hash into
chunks, each chunk differences its groups into one tuple of shard sums, and the tuples of the
chunks (their number is bounded) are differenced again.  Slots within a shard come from counts
of (shard, hash bucket) and a row number inside the bucket, so a large shard is no single task.

Null texts count as empty, so they form one group with empty texts.  Very long texts are units like any
other, and a text that is larger than a shard's share makes its shard larger.  Repeated rows get a slot
each.  Empty input gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import checkpoint, hot_keys, salted_join, ship, text_or_empty, utf8_bytes

#: Groups in a chunk, until there are MOST_CHUNKS chunks.
CHUNK_GROUPS = 2000
MOST_CHUNKS = 65_536
#: Rows in a (shard, bucket) that get their slots in one task.
BUCKET_ROWS = 2000


def difference(leaves: Sequence[int] | np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: for each leaf, the final place of each of its parts.

    A leaf is a size (its whole size in part 0) or a row of k part sums.  The two tuples of
    largest spread are added, one in descending and one in ascending order, until one is left.
    Returns an array (leaves, k) for rows, (leaves,) for sizes.
    """
    leaves = np.asarray(leaves, dtype=np.int64)
    n, whole = len(leaves), leaves.ndim == 1
    if n == 0:
        return np.zeros((0,) if whole else (0, k), dtype=np.int32)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def vector(i: int) -> np.ndarray:
        if i >= n:
            return sums.pop(i)
        if not whole:
            return leaves[i]
        v = np.zeros(k, dtype=np.int64)
        v[0] = leaves[i]
        return v

    spread = leaves if whole and k > 1 else (np.zeros(n, np.int64) if whole else leaves.max(axis=1) - leaves.min(axis=1))
    heap = [(-int(s), i) for i, s in enumerate(spread)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        va, vb = vector(a), vector(b)
        down, up = np.argsort(-va, kind="stable"), np.argsort(vb, kind="stable")
        v = va[down] + vb[up]
        v -= v.min()
        node = n + len(made)
        sums[node] = v
        made.append((a, b, down.astype(np.int16), up.astype(np.int16)))
        heapq.heappush(heap, (-int(v.max()), node))
    out = np.zeros(n if whole else (n, k), dtype=np.int32)
    place = {heap[0][1]: np.arange(k, dtype=np.int32)}
    if n == 1:
        out[0] = 0 if whole else place[0]
        return out
    for node in range(len(made) - 1, -1, -1):
        at = place.pop(n + node)
        a, b, down, up = made[node]
        for child, order in ((a, down), (b, up)):
            own = np.empty(k, dtype=np.int32)
            own[order] = at
            if child >= n:
                place[child] = own
            elif whole:
                out[child] = own[0]
            else:
                out[child] = own
    return out


def shard_groups(groups: DataFrame, shards: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """groups: (g, bytes), one row a group.  Returns (g, chunk, part) and the table (chunk, part, shard)."""
    spark = groups.sparkSession
    ship(spark)
    chunks = max(1, min(MOST_CHUNKS, -(-rows // CHUNK_GROUPS)))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"g": pdf["g"], "bytes": pdf["bytes"], "chunk": pdf["chunk"], "part": difference(pdf["bytes"].to_numpy(), shards)})

    chunked = groups.withColumn("chunk", F.pmod(F.xxhash64("g"), F.lit(chunks)).cast("int"))
    dealt = checkpoint(chunked.groupBy("chunk").applyInPandas(deal, "g binary, bytes bigint, chunk int, part int"))
    # At most MOST_CHUNKS x shards sums, whatever the input.
    sums = dealt.groupBy("chunk", "part").agg(F.sum("bytes").alias("bytes")).toPandas()
    ids = np.sort(sums["chunk"].unique())
    tuples = np.zeros((len(ids), shards), dtype=np.int64)
    tuples[np.searchsorted(ids, sums["chunk"]), sums["part"]] = sums["bytes"]
    place = difference(tuples, shards)
    table = pd.DataFrame({"chunk": np.repeat(ids, shards).astype("int32"), "part": np.tile(np.arange(shards, dtype="int32"), len(ids)), "shard": place.reshape(-1).astype("int32")})
    return dealt.select("g", "chunk", "part"), spark.createDataFrame(table, "chunk int, part int, shard int")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Shards of near equal bytes: (id, size, text_crc32, law, shard, slot, grown_shard) and the columns in keep.

    size is the text's UTF-8 bytes plus 16.  Rows with equal texts get the same shard.  slot counts
    the rows of a shard from 0 without gaps, by bucket of the row's hash, then id.
    """
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (utf8_bytes(text_col) + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("g"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)],
    )
    base = checkpoint(base)
    rows = base.count()
    groups = checkpoint(base.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    dealt, table = shard_groups(groups.select("g", "bytes"), shards, rows)
    buckets = max(1, min(65_536, -(-rows // (shards * BUCKET_ROWS))))
    # A group of equal texts may hold a third of all rows.
    placed = salted_join(base, dealt, ["g"], hot_keys(groups, ["g"])).join(F.broadcast(table), ["chunk", "part"])
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(7)), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most shards x 65,536 rows.
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("own", own).join(before, ["shard", "bucket"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
    )
