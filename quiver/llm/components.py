"""Connected components by alternating large-star and small-star steps over edge tables.

Each step sends a vertex's neighbours to its least one; no neighbour list is gathered, and the work
of a vertex with many neighbours is a minimum (combined before the shuffle) and a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import BROADCAST_BYTES, checkpoint


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges: (u, v) bigint, undirected.  Returns (v, root): each vertex of an edge, and the least vertex of its component."""
    stars = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(stars)
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpoint(small.union(root.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("v"), F.col("v").alias("root")).union(stars.select(F.col("v"), F.col("v").alias("root")).distinct())


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges, sorted, and the least vertex of the component of each."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return names, names[[find(i) for i in range(len(names))]]


def components_by_size(edges: DataFrame) -> DataFrame:
    """components() of edges that are stored: up to BROADCAST_BYTES of them are settled in the driver.

    A step there is a dozen shuffles, each of as many tasks as there are partitions, however few the edges.
    """
    if 16 * edges.count() > BROADCAST_BYTES:
        return components(edges)
    found = edges.where("u <> v").select("u", "v").toArrow()
    v, root = least_reached(*(found.column(c).to_numpy().astype(np.int64) for c in "uv"))
    rows = pa.table({"v": pa.array(v, pa.int64()), "root": pa.array(root, pa.int64())})
    return edges.sparkSession.createDataFrame(rows, "v bigint, root bigint")
