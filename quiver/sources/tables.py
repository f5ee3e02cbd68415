"""Graphs over ordinary tables, and the file contracts of graph datasets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.graph import EdgeTable, NodeTable, PropertyGraph, widen
from quiver.operators.procedures import Procedure

#: Turns that a conversation can have at most: the bits of a turn in its key.
TURN_BITS = 16


def turn_key(conv: str, turn: str) -> Column:
    """The key of a turn, from its conversation's number and its own; conversations below 2^32."""
    fits = F.col(turn).between(0, (1 << TURN_BITS) - 1)
    return F.when(fits, F.shiftleft(F.col(conv).cast("bigint"), TURN_BITS) + F.col(turn)).when(F.col(turn).isNotNull(), F.raise_error(F.lit("a turn number beyond the key")).cast("bigint"))


def commerce(spark: SparkSession, folder: str) -> PropertyGraph:
    """The driver's tables as a graph."""
    t = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    events, lines = t("events"), t("lineitem")
    g = PropertyGraph(spark)
    g = g.with_nodes("Customer", t("customer"), "c_custkey").with_nodes("Supplier", t("supplier"), "s_suppkey").with_nodes("Part", t("part"), "p_partkey")
    g = g.with_nodes("Order", t("orders"), "o_orderkey").with_nodes("Nation", t("nation"), "n_nationkey").with_nodes("Region", t("region"), "r_regionkey")
    g = g.with_nodes("User", events.select("user_id").where("user_id is not null").distinct(), "user_id").with_nodes("Event", events, "event_id")
    g = g.with_nodes("Vec", t("embeddings"), "vec_id").with_nodes("Doc", t("documents"), "doc_id").with_nodes("Page", t("pages"), "page_id")
    turns = t("conversations")
    g = g.with_nodes("Turn", turns, turn_key("conv_id", "turn"))
    g = g.with_edges("PLACED", t("orders").select("o_custkey", "o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey")
    # Line numbers repeat within an order here, so a line is known by more of its columns.
    line = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").bitwiseAND(F.lit((1 << 56) - 1))
    g = g.with_edges("CONTAINS", lines, ("Order", "l_orderkey"), ("Part", "l_partkey"), line)
    g = g.with_edges("SHIPS", lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), ("Supplier", "l_suppkey"), ("Order", "l_orderkey"), line)
    g = g.with_edges("LOCATED_IN", t("customer").select("c_custkey", "c_nationkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey")
    g = g.with_edges("LOCATED_IN", t("supplier").select("s_suppkey", "s_nationkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey")
    g = g.with_edges("PART_OF", t("nation").select("n_nationkey", "n_regionkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey")
    g = g.with_edges("DID", events.select("user_id", "event_id").where("user_id is not null"), ("User", "user_id"), ("Event", "event_id"), "event_id")
    following = t("part").select(F.col("p_partkey").alias("next_key"))
    chain = t("part").select("p_partkey").join(following, F.expr("p_partkey + 1 = next_key"))
    g = g.with_edges("NEXT", chain, ("Part", "p_partkey"), ("Part", "next_key"), "p_partkey")
    replies = turns.alias("a").join(turns.alias("b"), F.expr("a.conv_id = b.conv_id and a.turn + 1 = b.turn")).select(turn_key("a.conv_id", "a.turn").alias("from_key"), turn_key("b.conv_id", "b.turn").alias("to_key"))
    nations = Procedure((("region", "INTEGER?"),), (("name", "STRING"), ("key", "INTEGER")), widen(t("nation").selectExpr("n_regionkey as region", "n_name as name", "n_nationkey as key")))
    g = replace(g, procedures={"tables.nationsOf": nations})
    return g.with_edges("REPLIED", replies, ("Turn", "from_key"), ("Turn", "to_key"), "from_key")


VERTICES = "tenant string, id string, labels_json string, properties_json string"
EDGES = "tenant string, id string, type string, src_id string, dst_id string, properties_json string"
EVENTS = "tenant string, ts timestamp, subject string, action string, object string, attributes string"


def properties(df: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON property maps as typed columns; without a schema it is found over all rows."""
    if schema is None:
        found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]  # type: ignore[index]
        schema = T.StructType.fromDDL(found.replace("OBJECT<", "STRUCT<")[7:-1]) if found and found.startswith("OBJECT<") and len(found) > 8 else T.StructType([])
    parsed = df.withColumn("_p", F.from_json(column, schema))
    return widen(parsed.select(*[c for c in df.columns if c != column], *[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields if f.name not in df.columns]))


def key_of(*columns: str) -> Column:
    """Text ids as BIGINT keys."""
    return F.xxhash64(*columns)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def dataset(spark: SparkSession, vertices: str, edges: str, vertex_schema: T.StructType | None = None, edge_schema: T.StructType | None = None) -> PropertyGraph:
    """A graph from vertices.csv (tenant, id, labels_json, properties_json) and edges.csv (tenant, id, type, src_id, dst_id, properties_json)."""
    v = properties(read_csv(spark, vertices, VERTICES), "properties_json", vertex_schema)
    labels = F.from_json("labels_json", "array<string>")
    v = v.select(key_of("tenant", "id").alias("_id"), F.coalesce(labels, F.array().cast("array<string>")).alias("_labels"), *[c for c in v.columns if c != "labels_json"])
    names = frozenset(r[0] for r in v.select(F.explode("_labels")).distinct().collect())
    e = properties(read_csv(spark, edges, EDGES), "properties_json", edge_schema)
    e = e.select(key_of("tenant", "id").alias("_id"), F.col("type").alias("_type"), key_of("tenant", "src_id").alias("_src"), key_of("tenant", "dst_id").alias("_dst"), *[c for c in e.columns if c not in ("type", "src_id", "dst_id")])
    types = sorted(r[0] for r in e.select("_type").distinct().collect())
    return PropertyGraph(spark, (NodeTable(v, frozenset(), names),), tuple(EdgeTable(e.where(F.col("_type") == t), t) for t in types))


def access_dataset(spark: SparkSession, principals: str, resources: str, relationships: str) -> PropertyGraph:
    """An access-control graph from principals.csv, resources.csv and relationships.csv."""
    p = properties(read_csv(spark, principals, "tenant string, id string, properties_json string"), "properties_json")
    r = properties(read_csv(spark, resources, "tenant string, id string, type string, properties_json string"), "properties_json")
    entity = lambda df, label: df.select(key_of("tenant", "id").alias("_id"), F.array(F.lit(label)).alias("_labels"), *df.columns)
    e = properties(read_csv(spark, relationships, EDGES), "properties_json")
    e = e.select(key_of("tenant", "id").alias("_id"), F.col("type").alias("_type"), key_of("tenant", "src_id").alias("_src"), key_of("tenant", "dst_id").alias("_dst"), *[c for c in e.columns if c not in ("type", "src_id", "dst_id")])
    types = sorted(x[0] for x in e.select("_type").distinct().collect())
    nodes = (NodeTable(entity(p, "Principal"), frozenset(["Principal"])), NodeTable(entity(r, "Resource"), frozenset(["Resource"])))
    return PropertyGraph(spark, nodes, tuple(EdgeTable(e.where(F.col("_type") == t), t) for t in types))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """events.jsonl: tenant, ts, subject, action, object and the attributes as JSON text."""
    return widen(spark.read.schema(EVENTS).json(path))
