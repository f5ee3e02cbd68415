"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many bytes, as their rows count, are broadcast; above it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than this.
HOT = 1000
#: Parts that a hot key's rows are dealt into.
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only in local mode, where it may be unset (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows written as a table in the shared folder, and what deletes it once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return spark.read.schema(df.schema).parquet(path), drop


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", size: int | None = None, width: Column | None = None) -> DataFrame:
    """Join with a side that is usually small: broadcast if its bytes allow, else shuffled.

    size: the bytes, if known; else the sum of width over its rows (32 bytes a row unless given).
    """
    if size is None:
        size = right.agg(F.sum(F.lit(32) if width is None else width).alias("n")).first()["n"] or 0
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right.hint("merge"), on, how)


def hot_keys(counted: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """counted: a row per key with its number of rows.  The keys of over 1 in HOT of all rows: fewer than HOT, whatever the input."""
    total = counted.agg(F.sum(n).alias("n")).first()["n"] or 0
    return counted.where(F.col(n) > max(total // HOT, 1)).select(*on)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join in which the left rows of hot keys are dealt by hash over SALTS parts, and the right rows of those keys repeated in each.

    hot: keys, or some columns of them, fewer than HOT rows; right has few rows for a key.
    """
    by = hot.columns
    flagged = F.broadcast(hot.distinct().withColumn("is_hot_", F.lit(True)))
    salt = F.when(F.col("is_hot_"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    one = left.join(flagged, by, "left").withColumn("salt_", salt).drop("is_hot_")
    parts = F.when(F.col("is_hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other = right.join(flagged, by, "left").withColumn("salt_", F.explode(parts)).drop("is_hot_")
    return one.join(other, [*on, "salt_"], how).drop("salt_")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_bytes(name: str = "text") -> Column:
    return F.octet_length(text_or_empty(name)).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: fewer rows in each, as a text can be long; a lower setting of the session stays.  Also ships the package."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    ship(spark)


def ship(spark: SparkSession) -> None:
    """See that workers find this package."""
    root = str(Path(__file__).resolve().parents[2])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and os.getcwd() != root and not _shipped(spark):
        data = Path(tempfile.mkdtemp()) / "quiver_package.zip"
        with zipfile.ZipFile(data, "w") as z:
            for f in Path(root, "quiver").rglob("*.py"):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(data))  # the driver serves it to the executors


def _shipped(spark: SparkSession) -> bool:
    return any("quiver_package" in f for f in spark.sparkContext.listFiles)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that nothing refers to any more.

    Its scheduler holds on to the last job, and its cleaner works behind the garbage collector.
    """
    for _ in range(2):
        gc.collect()
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
