"""Names of functions and how their calls become columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.plans.ast import CypherError
from quiver.plans.values import NULL, Val, kind, null_of

Handler = Callable[..., Val]
FUNCTIONS: dict[str, Handler] = {}
ARITY: dict[str, tuple[int, int]] = {}


def function(*names: str, args: int | tuple[int, int]):
    """Register a handler f(*values) -> Val under names, with its number of arguments."""

    def put(f: Handler) -> Handler:
        for n in names:
            FUNCTIONS[n] = f
            ARITY[n] = (args, args) if isinstance(args, int) else args
        return f

    return put


def call(name: str, values: list[Val]) -> Val:
    if name not in FUNCTIONS:
        raise CypherError("UnknownFunction", f'unknown function "{name}"')
    low, high = ARITY[name]
    if not low <= len(values) <= high:
        raise CypherError("InvalidNumberOfArguments", f"{name} takes {low} to {high} arguments, not {len(values)}")
    return FUNCTIONS[name](*values)


def of_kind(v: Val, *kinds: str) -> bool:
    return kind(v.type) in kinds


def need(name: str, v: Val, *kinds: str) -> None:
    """Refuse a value whose type can't be one of these; nulls pass."""
    if kind(v.type) not in (*kinds, "null", "any"):
        raise CypherError("InvalidArgumentValue", f"{name} takes {' or '.join(kinds)}, not {kind(v.type)}")


def simple(name: str, f: Callable[..., Column], out: T.DataType, *kinds: tuple[str, ...], strict: bool = False) -> None:
    """A function of values of fixed kinds: another kind gives null, or an error if strict."""

    def run(*values: Val) -> Val:
        for v, k in zip(values, kinds, strict=False):
            if kind(v.type) not in k:
                if strict:
                    need(name, v, *k)
                return null_of(out)
        return Val(f(*[v.col for v in values]), out)

    FUNCTIONS[name] = run
    ARITY[name] = (len(kinds), len(kinds))


def raise_if(bad: Column, code: str, message: str, value: Column) -> Column:
    """value, but an error for rows where bad holds."""
    return F.when(bad, F.raise_error(F.lit(f"{code}: {message}"))).otherwise(value)


def unknown(t: T.DataType = NULL) -> Val:
    return null_of(t)
