"""Binding tables: a DataFrame whose columns are the fields of query variables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.graph import EDGE_FIELDS, NODE_FIELDS, col
from quiver.plans.values import Val, kind

_serial = count()


def fresh(stem: str) -> str:
    return f"{stem}#{next(_serial)}"


@dataclass(frozen=True)
class Binding:
    """kind value: one column under the field ''.  node and relationship: a column per field, so that unused ones are pruned."""

    kind: str
    fields: dict[str, tuple[str, T.DataType]]
    labels: frozenset[str] | None = None  # known labels of a node

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.fields.values()]

    @property
    def key(self) -> str:
        """The column that tells values apart."""
        return self.fields["_id" if self.kind != "value" else ""][0]

    def val(self) -> Val:
        if self.kind == "value":
            c, t = self.fields[""]
            return Val(col(c), t)
        t = T.StructType([T.StructField(f, t) for f, (_, t) in self.fields.items()])
        return Val(F.when(col(self.key).isNotNull(), F.struct(*[col(c).alias(f) for f, (c, _) in self.fields.items()])), t)

    def get(self, name: str) -> Val | None:
        found = self.fields.get(name)
        return Val(col(found[0]), found[1]) if found else None


@dataclass(frozen=True)
class Scope:
    df: DataFrame
    vars: dict[str, Binding] = field(default_factory=dict)
    unit: bool = False  # one row without variables
    order: tuple[tuple[str, bool], ...] = ()  # columns that the rows are ordered by, and whether descending
    sorted: bool = False  # by an ORDER BY, not only by the place in a list

    def with_(self, df: DataFrame, **new: Binding) -> "Scope":
        return Scope(df, {**self.vars, **new})

    def only(self, names: set[str]) -> "Scope":
        kept = {k: b for k, b in self.vars.items() if k in names}
        return Scope(self.df.select(*[col(c) for b in kept.values() for c in b.columns]), kept)

    def sort_columns(self) -> list[Column]:
        return [col(c).desc_nulls_first() if down else col(c).asc_nulls_last() for c, down in self.order]

    def ordered_as(self, old: "Scope") -> "Scope":
        """With the order of the scope that it came from, where its columns are still there."""
        if not old.order or self.order or not {c for c, _ in old.order} <= set(self.df.columns):
            return self
        return replace(self, order=old.order, sorted=old.sorted)

    def where(self, test: Column) -> "Scope":
        return replace(self, df=self.df.where(test), unit=False)


def bind_frame(df: DataFrame, var: str, what: str, labels: frozenset[str] | None = None) -> tuple[DataFrame, Binding]:
    """The frame with its columns renamed to fresh fields of var."""
    fields = {f.name: (fresh(f"{var}.{f.name}".replace(".", "@")), f.dataType) for f in df.schema.fields}
    return df.select(*[col(k).alias(c) for k, (c, _) in fields.items()]), Binding(what, fields, labels)


def as_entity(scope: Scope, var: str) -> Scope:
    """A variable that holds a node or relationship struct, spread over columns."""
    b = scope.vars[var]
    if b.kind != "value":
        return scope
    v = b.val()
    if kind(v.type) not in ("node", "relationship"):
        return scope
    fields = {f.name: (fresh(f"{var}@{f.name}"), f.dataType) for f in v.type.fields}  # type: ignore[attr-defined]
    df = scope.df.withColumns({c: v.col.getField(f) for f, (c, _) in fields.items()})
    return Scope(df, {**scope.vars, var: Binding(kind(v.type), fields)})


__all__ = ["EDGE_FIELDS", "NODE_FIELDS", "Binding", "Scope", "as_entity", "bind_frame", "fresh"]
