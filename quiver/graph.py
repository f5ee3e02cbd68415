"""Property graphs: node and edge tables that stay ordinary DataFrames.

Every node table has _id (BIGINT, unique in the graph) and _labels; every edge table has _id, _type,
_src and _dst.  Other columns are properties.  A graph is a value: changes give a new graph.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce as fold
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.plans.ast import Labels
from quiver.plans.values import LONG, STRING, Val, cast, unify

NODE_FIELDS, EDGE_FIELDS = ("_id", "_labels"), ("_id", "_type", "_src", "_dst")
LABELS = T.ArrayType(STRING)
#: A pattern's labels of a node, and labels that it is known to have.
End = tuple[Labels | None, frozenset[str] | None]
_ROWS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class NodeTable:
    df: DataFrame
    labels: frozenset[str]  # of every row
    more: frozenset[str] = frozenset()  # of some rows
    numbered: bool = False  # ids are keys below the table's number
    made: int = 0  # by how many CREATE and MERGE statements


@dataclass(frozen=True)
class EdgeTable:
    df: DataFrame
    type: str
    src: frozenset[str] | None = None  # labels that every source has; None: not known
    dst: frozenset[str] | None = None
    made: int = 0


def widen(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, the types that queries know."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            out.append(col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.to_utc_timestamp(col(f.name), F.current_timezone()).cast("timestamp_ntz").alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def numbered(key: Column, base: int) -> Column:
    """An id: the key below the table's number; validate() finds keys that would run into the next table's ids."""
    return key.cast("bigint") + F.lit(base)


def row_count(df: DataFrame) -> int | None:
    """Rows of a table that is one scan, counted once (Parquet tells them without reading); None for others."""
    if df not in _ROWS:
        if df._jdf.queryExecution().analyzed().collectLeaves().size() != 1:
            return None
        _ROWS[df] = df.count()
    return _ROWS[df]


def union(frames: list[DataFrame], spark: SparkSession, fixed: tuple[str, ...]) -> DataFrame:
    """All rows; a column of several types gets the type that holds them, a missing one is null."""
    if not frames:
        kinds = {"_labels": LABELS, "_type": STRING}
        return spark.createDataFrame([], T.StructType([T.StructField(f, kinds.get(f, LONG)) for f in fixed]))
    if len(frames) == 1:
        return frames[0]
    types: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            types.setdefault(f.name, []).append(f.dataType)
    whole = {k: unify(v) for k, v in types.items()}
    fitted = []
    for df in frames:
        have = {f.name: f.dataType for f in df.schema.fields}
        fitted.append(df.select(*[(cast(Val(col(k), have[k]), t) if k in have else F.lit(None).cast(t)).alias(k) for k, t in whole.items()]))
    return fold(DataFrame.union, fitted)


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    serial: int = 0  # statements that made entities
    indexes: tuple[tuple[str, str, str], ...] = ()  # (class, label or type, property), for the record only
    tenant: str | None = None
    procedures: dict = field(default_factory=dict)

    # -- building

    def with_nodes(self, label: str | tuple[str, ...], df: DataFrame, key: str | Column) -> "PropertyGraph":
        """Add a node table whose integer key, from 0 below 2^48, becomes _id: the table's number in the upper bits."""
        labels = (label,) if isinstance(label, str) else label
        base = len(self.nodes) + 1 << 48
        key = col(key) if isinstance(key, str) else key
        own = widen(df)
        rows = own.select(numbered(key, base).alias("_id"), F.array(*map(F.lit, labels)).alias("_labels"), *[col(c) for c in own.columns])
        return replace(self, nodes=(*self.nodes, NodeTable(rows, frozenset(labels), numbered=True)))

    def offset(self, label: str) -> int:
        return next(i for i, t in enumerate(self.nodes) if label in t.labels) + 1 << 48

    def with_edges(self, kind: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], key: str | Column | None = None) -> "PropertyGraph":
        """Add an edge table: src and dst are (label, key column); key is an integer that is unique in the table."""
        base = len(self.edges) + 1 << 56
        if base >> 63:
            raise ValueError("at most 126 edge tables with keys of their own")
        own = widen(df)
        key = F.xxhash64(*[col(c) for c in own.columns]).bitwiseAND(F.lit((1 << 56) - 1)) if key is None else (col(key) if isinstance(key, str) else key)
        rows = own.select(
            numbered(key, base).alias("_id"), F.lit(kind).alias("_type"),
            numbered(col(src[1]), self.offset(src[0])).alias("_src"), numbered(col(dst[1]), self.offset(dst[0])).alias("_dst"),
            *[col(c) for c in own.columns],
        )
        return replace(self, edges=(*self.edges, EdgeTable(rows, kind, frozenset([src[0]]), frozenset([dst[0]]))))

    def for_tenant(self, tenant: str) -> "PropertyGraph":
        """Only rows of the tenant, where tables have such a column."""
        cut = lambda df: df.where(col("tenant") == tenant) if "tenant" in df.columns else df
        return replace(self, nodes=tuple(replace(t, df=cut(t.df)) for t in self.nodes), edges=tuple(replace(t, df=cut(t.df)) for t in self.edges), tenant=tenant)

    # -- scans

    def node_tables(self, labels: Labels | None, among: frozenset[str] | None = None) -> list[tuple[NodeTable, bool]]:
        """(table, whether its rows must be tested) for tables that may have rows with the labels.

        among: labels that the rows are known to have.
        """
        out = []
        for t in self.nodes:
            if among is not None and not among <= (t.labels | t.more):
                continue
            verdict = label_verdict(labels, t.labels, t.more)
            if verdict is not False:
                out.append((t, verdict is None))
        return out

    def known_labels(self, labels: Labels | None, among: frozenset[str] | None = None) -> frozenset[str] | None:
        """Labels that every row of such a scan has; None if there are none."""
        tables = [t.labels for t, _ in self.node_tables(labels, among)]
        return (frozenset.intersection(*tables) or None) if tables else among

    def scan_nodes(self, labels: Labels | None = None, among: frozenset[str] | None = None) -> DataFrame:
        frames = [t.df.where(label_test(labels, col("_labels"))) if test else t.df for t, test in self.node_tables(labels, among)]
        return union(frames, self.spark, NODE_FIELDS)

    def edge_tables(self, types: tuple[str, ...]) -> list[EdgeTable]:
        wanted = {t.upper() for t in types}
        return [t for t in self.edges if not wanted or t.type.upper() in wanted]

    def joins(self, t: EdgeTable, src: End, dst: End) -> bool:
        """Whether edges of the table may lead from such a node to such a node."""
        return all(self.node_tables(labels, (ends or frozenset()) | (known or frozenset())) for ends, (labels, known) in ((t.src, src), (t.dst, dst)))

    def scan_edges(self, types: tuple[str, ...] = (), without: tuple[EdgeTable, ...] = ()) -> DataFrame:
        """Edges of the types; of tables to leave out only the columns."""
        return union([t.df.where(F.lit(False)) if any(t is x for x in without) else t.df for t in self.edge_tables(types)], self.spark, EDGE_FIELDS)

    def ends(self, types: tuple[str, ...], outgoing: bool, without: tuple[EdgeTable, ...] = ()) -> frozenset[str] | None:
        """Labels that every source (or target) of these types has, if there is one table's worth of them."""
        found = {t.src if outgoing else t.dst for t in self.edge_tables(types) if not any(t is x for x in without)}
        return found.pop() if len(found) == 1 else None

    # -- statistics

    def validate(self) -> None:
        """Raise an error if an id is null, met twice or outside its table's numbers, or if an edge ends nowhere."""
        ids = self.scan_nodes().select("_id")
        edges = self.scan_edges().select("_id", "_src", "_dst")
        for what, df in (("node", ids), ("edge", edges)):
            bad = df.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("_id is null or n > 1")
            if not bad.isEmpty():
                raise ValueError(f"{what} ids that are null or not unique, like {bad.first()['_id']}")
        for i, t in enumerate(self.nodes):
            if t.numbered and not t.df.where((col("_id") < (i + 1 << 48)) | (col("_id") >= (i + 2 << 48))).isEmpty():
                raise ValueError(f"keys of {sorted(t.labels)} beyond the ids of their table")
        for end in ("_src", "_dst"):
            if not edges.join(ids.withColumnRenamed("_id", end), end, "left_anti").isEmpty():
                raise ValueError(f"edges whose {end} is no node")

    def stats(self) -> dict[str, DataFrame]:
        """Counts by label and type, and distinct sources and average out-degree by type."""
        labels = self.scan_nodes().select(F.explode("_labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("vertices"))
        types = self.scan_edges().groupBy("_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("_src").alias("sources"))
        return {"labels": labels, "types": types.withColumn("avg_out_degree", F.col("edges") / F.col("sources")), "properties": self.property_stats()}

    def property_stats(self) -> DataFrame:
        """(class, name, property, present, distinct_values, least, greatest) of each label's and type's properties, as text; distinct values are estimated."""
        parts = [("vertex", "|".join(sorted(t.labels)), t.df, NODE_FIELDS) for t in self.nodes] + [("edge", t.type, t.df, EDGE_FIELDS) for t in self.edges]
        found = None
        for cls, name, df, fixed in parts:
            own = [f for f in df.schema.fields if f.name not in fixed]
            if not own:
                continue
            aggregates = []
            for f in own:
                plain = isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType))
                c = col(f.name)
                nothing = F.max(F.lit(None).cast("string"))
                aggregates.append(F.struct(
                    F.lit(f.name).alias("property"), F.count(c).alias("present"), (F.approx_count_distinct(c) if plain else F.max(F.lit(None).cast("bigint"))).alias("distinct_values"),
                    (F.min(c).cast("string") if plain else nothing).alias("least"), (F.max(c).cast("string") if plain else nothing).alias("greatest"),
                ))
            rows = df.agg(F.array(*aggregates).alias("all")).select(F.lit(cls).alias("class"), F.lit(name).alias("name"), F.explode("all").alias("p")).select("class", "name", "p.*")
            found = rows if found is None else found.union(rows)
        return found if found is not None else self.spark.createDataFrame([], "class string, name string, property string, present bigint, distinct_values bigint, least string, greatest string")

    # -- on disk

    def save(self, path: str) -> None:
        """Write the graph below path: Parquet for each table, and what isn't in the tables as JSON lines."""
        rows = []
        for kind, tables in (("nodes", self.nodes), ("edges", self.edges)):
            for i, t in enumerate(tables):
                t.df.write.parquet(f"{path}/{kind}-{i}")
                own = {"labels": sorted(t.labels), "more": sorted(t.more), "numbered": t.numbered} if isinstance(t, NodeTable) else {"type": t.type, "src": t.src and sorted(t.src), "dst": t.dst and sorted(t.dst)}
                rows.append((len(rows), json.dumps({"table": f"{kind}-{i}", **own})))
        rows.append((len(rows), json.dumps({"serial": self.serial, "indexes": self.indexes, "tenant": self.tenant})))
        self.spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(f"{path}/graph")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PropertyGraph":
        """The graph that save() wrote; procedures aren't kept."""
        nodes, edges, rest = [], [], {}
        for entry in (json.loads(r["value"]) for r in spark.read.text(f"{path}/graph").collect()):
            if "table" not in entry:
                rest = entry
                continue
            df = spark.read.parquet(f"{path}/{entry['table']}")
            if "labels" in entry:
                nodes.append(NodeTable(df, frozenset(entry["labels"]), frozenset(entry["more"]), entry["numbered"]))
            else:
                edges.append(EdgeTable(df, entry["type"], *[None if entry[k] is None else frozenset(entry[k]) for k in ("src", "dst")]))
        return PropertyGraph(spark, tuple(nodes), tuple(edges), rest["serial"], tuple(map(tuple, rest["indexes"])), rest["tenant"])


def label_verdict(labels: Labels | None, sure: frozenset[str], maybe: frozenset[str]) -> bool | None:
    """Whether rows with these labels fulfil the expression; None if it depends on the row."""
    if labels is None:
        return True
    sure_low, maybe_low = {x.lower() for x in sure}, {x.lower() for x in maybe}
    best: bool | None = False
    for group in labels.any_of:
        verdict: bool | None = True
        for negated, label in group:
            has = True if label.lower() in sure_low else None if label.lower() in maybe_low else False
            has = has if has is None or not negated else not has
            verdict = False if has is False or verdict is False else None if has is None or verdict is None else True
        if verdict is True:
            return True
        best = None if verdict is None else best
    return best


def label_test(labels: Labels | None, column: Column, exact: bool = False) -> Column:
    if labels is None:
        return F.lit(True)
    own = column if exact else F.transform(column, F.lower)
    out = None
    for group in labels.any_of:
        both = None
        for negated, label in group:
            has = F.array_contains(own, label if exact else label.lower())
            has = ~has if negated else has
            both = has if both is None else both & has
        out = both if out is None else out | both
    return out  # type: ignore[return-value]
