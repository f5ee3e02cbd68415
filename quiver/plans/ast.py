"""Syntax tree of graph queries.  Nodes are frozen, so equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class CypherError(ValueError):
    """A query that can't be run: code names the rule that it breaks."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Lit) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Prop(Node):
    base: Node
    key: str


@dataclass(frozen=True)
class Index(Node):
    base: Node
    at: Node


@dataclass(frozen=True)
class Slice(Node):
    base: Node
    low: Node | None
    high: Node | None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Chain(Node):
    """Comparisons a < b <= c: operands and the operators between them."""

    operands: tuple[Node, ...]
    ops: tuple[str, ...]


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListLit(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MapLit(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Comprehension(Node):
    var: str
    source: Node
    where: Node | None
    body: Node | None


@dataclass(frozen=True)
class Quantifier(Node):
    kind: str
    var: str
    source: Node
    where: Node | None


@dataclass(frozen=True)
class Reduce(Node):
    acc: str
    start: Node
    var: str
    source: Node
    body: Node


@dataclass(frozen=True)
class LabelTest(Node):
    base: Node
    labels: "Labels"


@dataclass(frozen=True)
class Labels(Node):
    """Label expression: alternatives of conjunctions of (negated, label)."""

    any_of: tuple[tuple[tuple[bool, str], ...], ...]


@dataclass(frozen=True)
class NodePattern(Node):
    var: str | None
    labels: Labels | None
    props: Node | None


@dataclass(frozen=True)
class RelPattern(Node):
    var: str | None
    types: tuple[str, ...]
    direction: int  # 1 out, -1 in, 0 both
    props: Node | None
    low: int | None = None  # bounds of a variable length; None: a single hop
    high: int | None = None

    @property
    def varlen(self) -> bool:
        return self.low is not None


@dataclass(frozen=True)
class Path(Node):
    var: str | None
    parts: tuple[Node, ...]  # NodePattern, RelPattern, NodePattern, ...

    @property
    def nodes(self) -> tuple[NodePattern, ...]:
        return self.parts[0::2]  # type: ignore[return-value]

    @property
    def rels(self) -> tuple[RelPattern, ...]:
        return self.parts[1::2]  # type: ignore[return-value]


@dataclass(frozen=True)
class PatternTest(Node):
    path: Path


@dataclass(frozen=True)
class PatternList(Node):
    """Pattern comprehension."""

    path: Path
    where: Node | None
    body: Node


@dataclass(frozen=True)
class Exists(Node):
    query: "Query"


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    name: str
    aliased: bool


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    descending: bool


@dataclass(frozen=True)
class Clause(Node):
    pass


@dataclass(frozen=True)
class Match(Clause):
    optional: bool
    paths: tuple[Path, ...]
    where: Node | None


@dataclass(frozen=True)
class Unwind(Clause):
    expr: Node
    var: str


@dataclass(frozen=True)
class Projection(Clause):
    """WITH, or RETURN (final)."""

    final: bool
    distinct: bool
    star: bool
    items: tuple[Item, ...]
    order: tuple[Order, ...] = ()
    skip: Node | None = None
    limit: Node | None = None
    where: Node | None = None


@dataclass(frozen=True)
class Create(Clause):
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetItem(Node):
    kind: str  # prop, replace, merge, labels
    target: Node
    value: Any


@dataclass(frozen=True)
class Merge(Clause):
    path: Path
    on_create: tuple[SetItem, ...] = ()
    on_match: tuple[SetItem, ...] = ()


@dataclass(frozen=True)
class Set(Clause):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove(Clause):
    items: tuple[SetItem, ...]  # prop or labels


@dataclass(frozen=True)
class Delete(Clause):
    detach: bool
    exprs: tuple[Node, ...]


@dataclass(frozen=True)
class CallProc(Clause):
    name: str
    args: tuple[Node, ...] | None
    yields: tuple[tuple[str, str], ...] | None
    star: bool = False
    where: Node | None = None


@dataclass(frozen=True)
class Query(Node):
    parts: tuple[tuple[Clause, ...], ...]
    all: tuple[bool, ...] = ()  # between the parts: UNION ALL or UNION
    mode: str = "run"  # run, explain, profile
    text: str = field(default="", compare=False)


def children(node: Any):
    """The direct parts of a node that are nodes."""
    if isinstance(node, Node):
        for value in vars(node).values():
            yield from _nodes(value)


def _nodes(value: Any):
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _nodes(v)


def walk(node: Any):
    """The node and all below it."""
    if isinstance(node, Node):
        yield node
        for c in children(node):
            yield from walk(c)


def rewrite(node: Any, f):
    """A copy in which f has replaced nodes, from the top; f returns None to go on below."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, f) for x in node)
    if not isinstance(node, Node):
        return node
    new = f(node)
    if new is not None:
        return new
    changed = {k: rewrite(v, f) for k, v in vars(node).items()}
    return type(node)(**changed)
