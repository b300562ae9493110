"""Deferred expressions over a piped table, and how they become Spark columns.

An expression is a tree of three kinds of nodes: row-wise ones, aggregates and window functions. Row-wise nodes
become Catalyst expressions as they are. An aggregate inside a row-wise verb is taken once per group by a hash
aggregate and joined back (one row is broadcast when there are no groups), so no group has to meet in one task.
A window function is computed over the groups in the table's row order. What an aggregate or a window needs of
other aggregates or windows is put into columns of an earlier step, as Spark can't nest them.
"""

from __future__ import annotations

import itertools
import operator
from contextvars import ContextVar
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW, AGGREGATE, WINDOW = 0, 1, 2
_ids = itertools.count()
#: The row weight that the aggregates being built have to carry, if any.
WEIGHT: ContextVar[Column | None] = ContextVar("weight", default=None)


def temporary() -> str:
    return f"__t{next(_ids)}"


class Expr:
    """A deferred expression: ``build(context)`` gives its column."""

    def __init__(self, build: Callable[[Context], Column], depth: int = ROW, name: str | None = None) -> None:
        self._build, self._depth, self._name = build, depth, name

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_"):
            raise AttributeError(name)
        return scalar(lambda c: c[name])(self)

    def __getitem__(self, key: Any) -> Expr:
        return scalar(lambda c: c[key])(self)

    def __hash__(self) -> int:
        return id(self)

    def __bool__(self) -> bool:
        raise TypeError("a deferred expression has no truth value; use & | ~")

    def __iter__(self):
        raise TypeError("a deferred expression can't be looped over")

    def __invert__(self) -> Expr:
        return scalar(operator.invert)(self)

    def __neg__(self) -> Expr:
        return scalar(operator.neg)(self)

    def __pos__(self) -> Expr:
        return self

    def __abs__(self) -> Expr:
        return scalar(F.abs)(self)

    def __round__(self, n: int = 0) -> Expr:
        return scalar(lambda c: F.bround(c, n))(self)

    def cast(self, kind: str) -> Expr:
        return scalar(lambda c: c.cast(kind))(self)

    def alias(self, name: str) -> Expr:
        return Expr(self._build, self._depth, name)


def _floordiv(a: Any, b: Any) -> Column:
    return F.floor(as_column(a) / as_column(b))


def _mod(a: Any, b: Any) -> Column:
    """The sign of the divisor, as in Python."""
    return F.pmod(as_column(a), as_column(b)) if not isinstance(b, Column) and isinstance(b, (int, float)) and b > 0 else ((as_column(a) % as_column(b)) + as_column(b)) % as_column(b)


def _truediv(a: Any, b: Any) -> Column:
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def _pow(a: Any, b: Any) -> Column:
    return F.pow(as_column(a), as_column(b))


def _and(a: Any, b: Any) -> Column:
    return as_column(a) & as_column(b)


def _or(a: Any, b: Any) -> Column:
    return as_column(a) | as_column(b)


def _xor(a: Any, b: Any) -> Column:
    return as_column(a) != as_column(b)


_OPERATORS = {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": _truediv, "floordiv": _floordiv, "mod": _mod, "pow": _pow,
    "and": _and, "or": _or, "xor": _xor, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne,
}


def as_column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def depth(x: Any) -> int:
    if isinstance(x, Expr):
        return x._depth
    if isinstance(x, (list, tuple)):
        return max(map(depth, x), default=ROW)
    return ROW


#: What some row-wise functions do on plain numbers and arrays, so that models run on the driver too.
_NUMERIC = {name: getattr(np, name) for name in ("abs", "sin", "cos", "tan", "log", "exp", "sqrt", "floor", "ceil", "round")} | {"pow": np.power}


def scalar(fun: Callable[..., Column]) -> Callable[..., Any]:
    """A function of columns and plain values as one of expressions too; without any expression it runs at once."""

    def call(*args: Any, **kw: Any) -> Any:
        every = [*args, *kw.values()]
        if args and all(isinstance(x, (int, float, np.ndarray, np.generic)) for x in args) and fun.__name__ in _NUMERIC:
            return _NUMERIC[fun.__name__](*args, **kw)
        if not any(deferred(x) for x in every):
            return fun(*args, **kw)
        return Expr(lambda ctx: fun(*(ctx.column(x) for x in args), **{k: ctx.column(x) for k, x in kw.items()}), max(map(depth, every)))

    call.__doc__, call.__name__ = fun.__doc__, getattr(fun, "__name__", "call")
    return call


def deferred(x: Any) -> bool:
    return isinstance(x, Expr) or isinstance(x, (list, tuple)) and any(map(deferred, x))


for _name, _fun in _OPERATORS.items():

    def _forward(self: Expr, other: Any, fun: Callable = _fun) -> Expr:
        return scalar(lambda a, b: fun(as_column(a), b))(self, other)

    def _backward(self: Expr, other: Any, fun: Callable = _fun) -> Expr:
        return scalar(lambda a, b: fun(as_column(b), a))(self, other)

    setattr(Expr, f"__{_name}__", _forward)
    if _name not in ("lt", "le", "gt", "ge", "eq", "ne"):
        setattr(Expr, f"__r{_name}__", _backward)


class Root:
    """The table that is piped: ``X.name`` and ``X["name"]`` are its columns."""

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Expr:
        return Expr(lambda ctx: ctx.of(name), ROW, name)


X = DF = Root()


def aggregate(fun: Callable[..., Column], weighted: bool = False) -> Callable[..., Expr]:
    """An aggregate function of columns as one of expressions. ``weighted``: it minds WEIGHT; others can't be taken of rows with weights."""

    def call(*args: Any, **kw: Any) -> Expr:
        return Expr(lambda ctx: ctx.aggregated(lambda inner: fun(*(inner(x) for x in args), **{k: inner(x) for k, x in kw.items()}), weighted), AGGREGATE)

    call.__doc__, call.__name__ = fun.__doc__, fun.__name__
    return call


def window(fun: Callable[..., Column]) -> Callable[..., Expr]:
    """``fun(frame, ...)``: a window function of columns as one of expressions; ``frame`` makes window specifications."""

    def call(*args: Any, **kw: Any) -> Expr:
        return Expr(lambda ctx: ctx.windowed(lambda frame, inner: fun(frame, *(inner(x) for x in args), **{k: inner(x) for k, x in kw.items()})), WINDOW)

    call.__doc__, call.__name__ = fun.__doc__, fun.__name__
    return call


class Frame:
    """Window specifications over the table's groups."""

    def __init__(self, groups: list[str], order: list[Column]) -> None:
        self.groups, self._order = groups, order

    @property
    def rows(self) -> list[Column]:
        """The table's row order; the order in which rows were read, where none was stated."""
        return self._order or [F.monotonically_increasing_id()]

    def by(self, *order: Column, partition: tuple[Column, ...] = ()):
        spec = Window.partitionBy(*(F.col(f"`{g}`") for g in self.groups), *partition)
        return spec.orderBy(*order) if order else spec

    def running(self):
        return self.by(*self.rows).rowsBetween(Window.unboundedPreceding, Window.currentRow)


class Unweighted(ValueError):
    """A function that has no form for rows with weights."""


#: An order statistic: its place from 0, as a share of the known values less one or as a function of their number.
Place = float | Callable[[Column], Column]


class Context:
    """Turns expressions into columns of ``df``, which it widens by temporary columns as they are needed.

    In a summary, aggregates and order statistics are put aside under names of their own; ``summarized`` takes the
    aggregates in one pass, joins what the order statistics gave and lays the expressions over both.
    """

    def __init__(self, df: DataFrame, groups: list[str], order: list[Column], summary: bool = False, weight: Column | None = None) -> None:
        self.df, self.groups, self.order, self.summary, self.weight = df, groups, order, summary, weight
        self.names = df.columns
        self.pending: list[tuple[str, Column]] = []
        self.statistics: list[tuple[str, Column, Place]] = []

    def of(self, name: str) -> Column:
        if name not in self.df.columns:
            raise ValueError(f"no column {name!r}; there are {self.names}")
        return F.col(f"`{name}`")

    def column(self, x: Any) -> Any:
        """The column of an expression; plain values as they are."""
        if isinstance(x, Expr):
            return x._build(self)
        if isinstance(x, (list, tuple)) and deferred(x):
            return [self.column(y) for y in x]
        return x

    def hoisted(self, x: Any) -> Any:
        """As column, with aggregates and windows put into a column of an earlier step."""
        if not isinstance(x, Expr) or x._depth == ROW:
            return [self.hoisted(y) for y in x] if isinstance(x, (list, tuple)) and deferred(x) else self.row().column(x)
        row = self.row()
        column = row.column(x)
        row.flush()
        name = temporary()
        self.df = row.df.withColumn(name, column)
        return F.col(name)

    def row(self) -> Context:
        if not self.summary:
            return self
        other = Context(self.df, self.groups, self.order, weight=self.weight)
        parent = self

        class Shared(Context):
            @property
            def df(self) -> DataFrame:
                return parent.df

            @df.setter
            def df(self, value: DataFrame) -> None:
                parent.df = value

        other.__class__ = Shared
        other.__dict__.pop("df", None)
        return other

    def aggregated(self, make: Callable[[Callable], Column], weighted: bool = False) -> Column:
        if self.weight is not None and not weighted:
            raise Unweighted("this aggregate can't be taken of rows with weights")
        before = WEIGHT.set(self.weight)
        try:
            made = make(self.hoisted)
        finally:
            WEIGHT.reset(before)
        name = temporary()
        self.pending.append((name, made))
        return F.col(name)

    def statistic(self, x: Any, place: Place) -> Column:
        """An order statistic of the group's known values."""
        name = temporary()
        self.statistics.append((name, self.hoisted(x), place))
        return F.col(name)

    def _statistics(self) -> tuple[DataFrame, list[str], list[Column]]:
        """(a row for each group, its keys, the statistics under their names); equal values are asked once."""
        from tidymesh.plans.quantiles import exact_quantiles

        asks: dict[str, tuple[Column, list[Place]]] = {}
        at = []
        for name, value, place in self.statistics:
            places = asks.setdefault(str(value), (value, []))[1]
            places.append(place)
            at.append((name, list(asks).index(str(value)), len(places) - 1))
        found = exact_quantiles(self.df, self.groups, list(asks.values()), self.weight)
        keys = [temporary() for _ in self.groups]
        self.statistics = []
        return found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"q{i}_{j}").alias(name) for name, i, j in at)), keys, [F.col(n) for n, _, _ in at]

    def flush(self) -> DataFrame:
        """The table with the aggregates and order statistics asked for so far, the aggregates taken in one pass."""
        joins = []
        if self.pending:
            made = [c.alias(name) for name, c in self.pending]
            keys = [temporary() for _ in self.groups]
            if self.groups:
                joins.append((self.df.groupBy(*(F.col(f"`{g}`").alias(k) for g, k in zip(self.groups, keys))).agg(*made), keys))
            else:
                joins.append((self.df.agg(*made), keys))
            self.pending = []
        if self.statistics:
            found, keys, _ = self._statistics()
            joins.append((found, keys))
        for found, keys in joins:
            if keys:
                self.df = self.df.join(found, [F.col(f"`{g}`") == F.col(k) for g, k in zip(self.groups, keys)], "left").drop(*keys)
            else:
                self.df = self.df.crossJoin(F.broadcast(found))  # one row
        return self.df

    def summarized(self, columns: dict[str, Column]) -> DataFrame:
        """A row for each group whose keys are known (one row without groups): keys and ``columns``."""
        base = self.df
        for g in self.groups:
            base = base.where(F.col(f"`{g}`").isNotNull())
        made = [c.alias(name) for name, c in self.pending] or [F.count(F.lit(1)).alias(temporary())]
        keys = [F.col(f"`{g}`") for g in self.groups]
        out = base.groupBy(*keys).agg(*made) if keys else base.agg(*made)
        if self.statistics:
            found, names, _ = self._statistics()
            out = out.join(found, [k == F.col(n) for k, n in zip(keys, names)], "left") if keys else out.crossJoin(F.broadcast(found))  # one row
        self.pending = []
        return out.select(*keys, *(c.alias(name) for name, c in columns.items()))

    def windowed(self, make: Callable[[Frame, Callable], Column]) -> Column:
        if self.weight is not None:
            raise Unweighted("windows can't be taken of rows with weights")
        if self.summary:
            row = self.row()
            name = temporary()
            made = row.windowed(make)
            self.df = row.flush().withColumn(name, made)
            return F.col(name)
        made = make(Frame(self.groups, self.order), self.hoisted)
        self.flush()
        name = temporary()
        self.df = self.df.withColumn(name, made)
        return F.col(name)
