"""Entry points: run query text over a property graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from quiver.graph import PropertyGraph
from quiver.plans import explain
from quiver.plans.ast import Create, Delete, Merge, Query, Remove, Set, walk
from quiver.plans.parser import parse, split_statements
from quiver.plans.planner import WALK_CAP, Planner


@dataclass
class Result:
    """A query's lazy rows, its columns in order, the graph after it, and counts of what writes did."""

    df: DataFrame
    columns: list[str]
    graph: PropertyGraph
    stats: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Engine:
    """Runs queries one after another; a statement's writes are seen by the next, and only if it succeeded."""

    graph: PropertyGraph
    walk_cap: int = WALK_CAP

    def run(self, text: str, params: dict[str, Any] | None = None) -> Result:
        q = parse(text)
        if q.mode != "run":
            return self.explained(q, params or {})
        planner = Planner(self.graph, params or {}, self.walk_cap)
        df, columns = planner.query(q)
        self.graph = planner.graph
        return Result(df, columns, planner.graph, planner.stats, explain.warnings(q, planner.graph) + planner.warnings)

    def batch(self, text: str, params: dict[str, Any] | None = None) -> list[Result]:
        """Statements separated by semicolons."""
        return [self.run(s, params) for s in split_statements(text)]

    def sql(self, text: str, **params: Any) -> DataFrame:
        """The rows of one query."""
        return self.run(text, params).df

    def explained(self, q: Query, params: dict[str, Any]) -> Result:
        writes = any(isinstance(n, (Create, Merge, Set, Remove, Delete)) for n in walk(q))
        df, seconds, rows = None, None, None
        if q.mode == "profile" or not writes:
            planner = Planner(self.graph, params, self.walk_cap)
            df, _ = planner.query(q)
            if q.mode == "profile":
                seconds, rows = explain.timed(df) if df.columns else (0.0, 0)
                self.graph = planner.graph
        text = explain.payload(q, self.graph, df, seconds, rows)
        out = self.graph.spark.createDataFrame([(text,)], "plan string")
        return Result(out, ["plan"], self.graph, {}, explain.warnings(q, self.graph))
