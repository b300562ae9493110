"""Tables: a Spark DataFrame with its groups and the order of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.expr import Context, Expr


@dataclass(frozen=True)
class Table:
    """``order``: the sort keys that give the rows their places, for verbs that depend on them. ``weight``: a column with the number of copies
    that a row stands for, which summaries mind; other verbs keep it with the rows."""

    df: DataFrame
    groups: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    meta: dict[str, Any] = field(default_factory=dict)
    weight: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def to(self, df: DataFrame, **changes: Any) -> Table:
        """The same groups, order and notes with other rows or columns."""
        return replace(self, df=df, **changes)

    def context(self, summary: bool = False) -> Context:
        return Context(self.df, list(self.groups), list(self.order), summary, None if self.weight is None else F.col(self.weight))

    @property
    def rows(self) -> list[Column]:
        return list(self.order) or [F.monotonically_increasing_id()]

    def collect(self) -> list:
        return (self.df.orderBy(*self.order) if self.order else self.df).collect()

    def toPandas(self):
        return (self.df.orderBy(*self.order) if self.order else self.df).toPandas()


def as_table(x: Table | DataFrame, order: Iterable[str | Column] = (), nan_to_null: bool = False) -> Table:
    """A table of a DataFrame. ``order``: columns that state the order of rows. ``nan_to_null``: NaN, the one missing
    value of float columns elsewhere, becomes NULL (it keeps filters on those columns from being pushed down)."""
    table = x if isinstance(x, Table) else Table(x)
    if nan_to_null:
        floats = [f.name for f in table.df.schema.fields if f.dataType.simpleString() in ("float", "double")]
        table = table.to(table.df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}))
    keys = tuple(F.col(f"`{c}`").asc_nulls_last() if isinstance(c, str) else c for c in order)
    return replace(table, order=keys) if keys else table


class pipe:
    """``table >> verb(arguments)``; verbs alone chain too: ``verb(...) >> verb(...)``."""

    def __init__(self, function: Callable[..., Any]) -> None:
        self.function = function
        self.__doc__ = function.__doc__

    def __rrshift__(self, other: Any) -> Any:
        return self.function(other)

    def __rshift__(self, other: pipe) -> pipe:
        return pipe(lambda x: other.function(self.function(x)))

    def __call__(self, *args: Any, **kw: Any) -> pipe:
        return pipe(lambda x: self.function(x, *args, **kw))


def add_pipe(fun: Callable[..., Any]) -> pipe:
    """The twin of a verb for use after ``>>``."""
    twin = pipe(fun)
    twin.__name__ = fun.__name__
    return twin


def verb(fun: Callable[..., Any]) -> Callable[..., Any]:
    """A verb that takes a table or a DataFrame as its first argument."""

    @wraps(fun)
    def call(df: Table | DataFrame, *args: Any, **kw: Any) -> Any:
        if not isinstance(df, (Table, DataFrame)):
            raise TypeError(f"{fun.__name__}: a table or a DataFrame, not {type(df).__name__}")
        return fun(as_table(df), *args, **kw)

    return call


def named(x: Any) -> str:
    """The name of a column given by its name or as an expression of the table."""
    if isinstance(x, str):
        return x
    if isinstance(x, Expr) and x._name:
        return x._name
    raise TypeError(f"a column of the table, not {x!r}")


def flatten(x: Iterable[Any]) -> list[Any]:
    out: list[Any] = []
    for y in x:
        out.extend(flatten(y)) if isinstance(y, (list, tuple)) else out.append(y)
    return out
