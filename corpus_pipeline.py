"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows that it
keeps with the columns of documents; the last returns the shards.  Each result is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import decontamination, mixing, near_copies, sharding, toxicity
from quiver.llm.common import checkpoint, release, shared_folder, small_join, table
from quiver.llm.queries import EPOCHS, SEED, WEIGHTS, tokens, tree

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels of these documents, doesn't reject.

    Null and empty texts score the base rate; repeated rows are rejected or kept together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxic_predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts of similarity 0.8 and more (5-word shingles): the one whose id names it.

    SimHash links, held to the similarity, come first; prefix filtering finds the pairs beyond the fingerprints' bits.

    Rows that share an id but not a text are documents of their own; of repeated rows one stays.  Null and
    empty texts are copies of each other.  Rows without an id can't be named and all stay.
    """
    found = near_copies.near_classes(docs).where("doc_id is not null").select("doc_id", "h", "root")
    rows = found.groupBy("doc_id", "h", "root").agg(F.count(F.lit(1)).alias("rows"))
    # Most components are one row; the others' rows but for the least go, and what is left of repeated rows is one.
    several = rows.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.sum("rows").alias("n")).where("n > 1")
    gone = checkpoint(small_join(rows, several, ["root"], width=F.lit(40)).select("doc_id", "h", "rows", (F.struct("doc_id", "h") == F.col("first")).alias("stays")).where("not stays or rows > 1"))
    size = 32 * gone.count()
    named = docs.select(*COLUMNS).withColumn("text_hash_", F.xxhash64(F.coalesce("text", F.lit(""))))
    key = [F.col("doc_id"), F.col("h").alias("text_hash_")]
    single = small_join(named, gone.select(*key), ["doc_id", "text_hash_"], "left_anti", size=size)
    again = small_join(named, gone.where("stays").select(*key), ["doc_id", "text_hash_"], "left_semi", size=size)
    return single.unionByName(again.dropDuplicates(["doc_id", "text_hash_"])).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item with agreeing slots.  Null and empty texts hold none; repeated rows go or stay together."""
    found = decontamination.leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep_columns=True)
    return found.where("not leaked").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: as many tokens as there are, spread by the target weights; a copy is a row of its own.

    Null sources and languages are leaves of their own; rows without an id are ordered by their other columns.
    """
    return mixing.mix(docs, tree(), WEIGHTS, tokens(), share=1.0, max_epochs=EPOCHS, seed=SEED).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; equal texts, and so copies, share a shard.  Null texts count as empty."""
    return sharding.shard_documents(docs, shards=40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Python models and iterative stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what a stage wrote, once the next one has written; the last one's input stays for the lazy result."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
