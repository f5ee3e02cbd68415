"""Ingest of event logs with Structured Streaming: JSON lines become event vertices and edges.

The reference data model has no streams; this is the incremental way into the batch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiver.sources.tables import EVENTS, key_of


def read_events(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """The folder's events as they come, repeats within the watermark dropped."""
    raw = spark.readStream.schema(EVENTS).json(folder)
    return raw.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tenant", "ts", "subject", "action", "object"])


def edges_of(events: DataFrame) -> DataFrame:
    """(subject)-[action]->(object) edges with the event's time and attributes."""
    return events.select(
        key_of("tenant", "ts", "subject", "action", "object").alias("_id"), F.upper("action").alias("_type"),
        key_of("tenant", "subject").alias("_src"), key_of("tenant", "object").alias("_dst"), "tenant", "ts", "attributes",
    )


def write_edges(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the edges to a Parquet table partitioned by tenant and type; ends when the folder is read."""
    out = edges_of(events).withColumn("edge_type", F.col("_type"))
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("tenant", "edge_type").trigger(availableNow=True).start()
