"""Around the engine: index configuration, a session with variables and commands, and counters of what ran."""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from quiver.engine import Engine, Result
from quiver.graph import PropertyGraph
from quiver.plans.ast import CypherError, Lit, MapLit, Match, NodePattern, walk
from quiver.plans.parser import parse, split_statements

#: The keys of an index configuration and of its entries.
CONFIG = {"property_indexes": ("vertex", ("tenant", "schema", "property")), "edge_property_indexes": ("edge", ("tenant", "edge_type", "property"))}

#: What this engine can do, for clients that ask first.
CAPABILITIES = {"language": "openCypher", "versions": [1], "explain": "v2-pipeline", "prepared": True, "transactions": "statement"}


def with_indexes(graph: PropertyGraph, config: str) -> PropertyGraph:
    """The graph with the indexes of a JSON text on record; entries of other tenants are left out."""
    try:
        found = json.loads(config)
    except ValueError as e:
        raise CypherError("InvalidConfiguration", str(e)) from e
    if not isinstance(found, dict) or set(found) - set(CONFIG):
        raise CypherError("InvalidConfiguration", f"keys are {', '.join(CONFIG)}")
    out = list(graph.indexes)
    for key, (cls, names) in CONFIG.items():
        for entry in found.get(key) or []:
            if not isinstance(entry, dict) or set(entry) != set(names) or not all(isinstance(v, str) and v.strip() for v in entry.values()):
                raise CypherError("InvalidConfiguration", f"an entry of {key} has {', '.join(names)}")
            own = (cls, entry[names[1]], entry[names[2]])
            if own not in out and graph.tenant in (None, entry["tenant"]):
                out.append(own)
    return replace(graph, indexes=tuple(out))


@dataclass
class Metrics:
    """Counts of statements by kind and outcome, their seconds, and properties that queries looked up."""

    statements: Counter = field(default_factory=Counter)
    seconds: Counter = field(default_factory=Counter)
    changes: Counter = field(default_factory=Counter)
    lookups: Counter = field(default_factory=Counter)

    def note(self, text: str, graph: PropertyGraph, seconds: float, result: Result | None) -> None:
        kind = (text.split(None, 1) or [""])[0].upper()
        self.statements[kind, "ok" if result else "failed"] += 1
        self.seconds[kind] += seconds
        if result is None:
            return
        self.changes.update(result.stats)
        for part in parse(text).parts:
            for n in (n for c in part if isinstance(c, Match) for n in walk(c)):
                if isinstance(n, NodePattern) and n.labels and isinstance(n.props, MapLit):
                    for label in {x for g in n.labels.any_of for _, x in g}:
                        self.lookups.update((label, k, ("vertex", label, k) in graph.indexes) for k, _ in n.props.items)

    def unindexed(self, limit: int) -> list[tuple[str, str, int]]:
        """(label, property, lookups) of the most wanted properties without an index on record."""
        found = [(label, prop, n) for (label, prop, indexed), n in self.lookups.items() if not indexed]
        return sorted(found, key=lambda x: (-x[2], x[0], x[1]))[:limit]


NAME = re.compile(r"[A-Za-z_]\w*")


@dataclass
class Session:
    """Lines of text for an engine: statements apart by semicolons, and commands on variables.

    SET name=value, UNSET name, and SET, LIST or VARS to see them.  A variable is the parameter of its name.
    """

    engine: Engine
    variables: dict[str, Any] = field(default_factory=dict)
    metrics: Metrics = field(default_factory=Metrics)
    prepared: dict[str, str] = field(default_factory=dict)

    def feed(self, line: str) -> list[Result | dict[str, Any]]:
        text = line.strip()
        verb, _, rest = text.partition(" ")
        if verb.upper() in ("SET", "LIST", "VARS") and not rest:
            return [dict(sorted(self.variables.items()))]
        if verb.upper() == "UNSET":
            self.variables.pop(self.named(rest), None)
            return []
        if verb.upper() == "SET" and re.fullmatch(r"\s*[^.\s=]+\s*=.*", rest, re.S):
            name, _, value = rest.partition("=")
            self.variables[self.named(name)] = scalar(value)
            return []
        return [self.run(s) for s in split_statements(text)]

    def run(self, text: str, **params: Any) -> Result:
        start = time.time()
        result = None
        try:
            result = self.engine.run(text, {**self.variables, **params})
            return result
        finally:
            self.metrics.note(text, self.engine.graph, time.time() - start, result)

    def prepare(self, name: str, text: str) -> None:
        parse(text)
        self.prepared[name] = text

    def execute(self, name: str, **params: Any) -> Result:
        if name not in self.prepared:
            raise CypherError("UndefinedVariable", f"no prepared query {name}")
        return self.run(self.prepared[name], **params)

    @staticmethod
    def named(name: str) -> str:
        if not NAME.fullmatch(name.strip()):
            raise CypherError("UnexpectedSyntax", f"{name!r} is no variable name")
        return name.strip()


def scalar(text: str) -> Any:
    """A constant: null, a boolean, a number, or text with or without quotes."""
    own = text.strip()
    if not own:
        raise CypherError("UnexpectedSyntax", "a variable needs a value")
    try:
        item = parse(f"RETURN {own} AS x").parts[0][0].items[0].expr
        if isinstance(item, Lit):
            return item.value
    except CypherError:
        pass
    try:
        return int(own)
    except ValueError:
        pass
    try:
        return float(own)
    except ValueError:
        return own


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """A result as files: json lines, csv or parquet.  Values that CSV has no form for become JSON text."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError(f"no such form: {form}")
    if form == "csv":
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        flat = lambda f: F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.VariantType)) else F.col(f"`{f.name}`")
        df.select(*[flat(f) for f in df.schema.fields]).write.option("header", True).csv(path)
    else:
        getattr(df.write, form)(path)
