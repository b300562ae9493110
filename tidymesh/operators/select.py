"""Projection: selectors over column names, and the verbs that use them. All names are resolved on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.expr import Expr, Root
from tidymesh.table import Table, add_pipe, flatten, named, verb


class Selector:
    """Names of a table's columns, found when the table is known; ``~`` leaves them out."""

    def __init__(self, find: Callable[[list[str]], Iterable[str]], out: bool = False) -> None:
        self.find, self.out = find, out

    def __invert__(self) -> Selector:
        return Selector(self.find, not self.out)

    def names(self, columns: list[str]) -> list[str]:
        return list(self.find(columns))


def _selector(rule: Callable[..., Callable[[str], bool]]) -> Callable[..., Selector]:
    def make(*args: Any) -> Selector:
        keep = rule(*args)
        return Selector(lambda columns: [c for c in columns if keep(c)])

    make.__name__ = rule.__name__
    return make


@_selector
def starts_with(prefix: str):
    return lambda c: c.startswith(prefix)


@_selector
def ends_with(suffix: str):
    return lambda c: c.endswith(suffix)


@_selector
def contains(part: str):
    return lambda c: part in c


@_selector
def matches(pattern: str):
    return lambda c: re.search(pattern, c) is not None


@_selector
def everything():
    return lambda c: True


@_selector
def num_range(prefix: str, numbers: Iterable[int]):
    wanted = {f"{prefix}{i}" for i in numbers}
    return lambda c: c in wanted


@_selector
def one_of(names: Iterable[str]):
    wanted = set(names)
    return lambda c: c in wanted


def columns_between(start: Any, end: Any, inclusive: bool = True) -> Selector:
    return Selector(lambda columns: columns[columns.index(named(start)) : columns.index(named(end)) + inclusive])


def columns_from(start: Any) -> Selector:
    return Selector(lambda columns: columns[columns.index(named(start)) :])


def columns_to(end: Any, inclusive: bool = False) -> Selector:
    return Selector(lambda columns: columns[: columns.index(named(end)) + inclusive])


def resolve_selection(columns: list[str], *args: Any) -> list[str]:
    """Names for a mix of names, places, columns of the table, selectors and lists of these, in the order given;
    what is left out goes last, and leaving out alone starts from all columns."""
    chosen: dict[str, bool] = {}
    out: set[str] = set()
    only_out = True
    for a in flatten(args):
        if isinstance(a, Selector):
            found, leave = a.names(columns), a.out
        elif isinstance(a, bool):
            raise TypeError("a column, not True or False")
        elif isinstance(a, int):
            found, leave = [columns[a]], False
        elif isinstance(a, Root):
            found, leave = list(columns), False
        else:
            name = named(a)
            if name not in columns:
                raise ValueError(f"no column {name!r}; there are {columns}")
            found, leave = [name], False
        only_out &= leave
        for c in found:
            chosen.pop(c, None) if leave else chosen.setdefault(c, True)
        out = (out | set(found)) if leave else (out - set(found))
    names = [c for c in columns if c not in out] if only_out and args else [c for c in chosen if c not in out]
    return names


def quoted(names: Iterable[str]) -> list:
    return [F.col(f"`{c}`") for c in names]


@verb
def tran_select(df: Table, *args: Any) -> Table:
    """Columns by name, place, expression or selector."""
    return df.to(df.df.select(*quoted(resolve_selection(df.columns, *args))))


@verb
def tran_drop(df: Table, *args: Any) -> Table:
    """All columns but the chosen ones; ``~`` keeps only them. Without a match the table stays as it is."""
    gone = set(resolve_selection(df.columns, *args)) if args else set()
    return df.to(df.df.select(*quoted(c for c in df.columns if c not in gone)))


def is_numeric(field: T.StructField) -> bool:
    """Numbers, truth values included."""
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def passing(df: DataFrame, fun: Callable[..., Any]) -> list[str]:
    """Columns for which the predicate holds: of the field, if it takes one, or else an aggregate of the column. All
    aggregates are taken in one pass. A predicate that fails does not hold."""
    out, asked = [], {}
    for f in df.schema.fields:
        try:
            answer = fun(f)
        except Exception:  # noqa: BLE001  a predicate that fails does not hold
            answer = None
        if isinstance(answer, (bool, int)):
            if answer:
                out.append(f.name)
            continue
        try:
            asked[f.name] = fun(F.col(f"`{f.name}`"))
        except Exception:  # noqa: BLE001
            continue
    if asked:
        row = df.agg(*(c.alias(str(i)) for i, c in enumerate(asked.values()))).first()
        out += [name for name, held in zip(asked, row) if held]
    return [c for c in df.columns if c in out]


@verb
def tran_select_if(df: Table, fun: Callable[..., Any]) -> Table:
    """Columns for which ``fun`` holds."""
    return df.to(df.df.select(*quoted(passing(df.df, fun))))


@verb
def tran_drop_if(df: Table, fun: Callable[..., Any]) -> Table:
    gone = set(passing(df.df, fun))
    return df.to(df.df.select(*quoted(c for c in df.columns if c not in gone)))


@verb
def tran_rename(df: Table, **names: Any) -> Table:
    """``new=old``, all at once."""
    old = {named(o): n for n, o in names.items()}
    if missing := set(old) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    groups = tuple(old.get(g, g) for g in df.groups)
    return df.to(df.df.withColumnsRenamed(old), groups=groups)


@verb
def tran_mutate(df: Table, **columns: Any) -> Table:
    """New columns, all from the table as it comes in; aggregates are those of the row's group."""
    ctx = df.context()
    made = {k: v if not isinstance(v, Expr) else ctx.column(v) for k, v in columns.items()}
    made = {k: v if hasattr(v, "_jc") else F.lit(v) for k, v in made.items()}
    kept = [F.col(f"`{c}`") if c not in made else made[c].alias(c) for c in df.columns]
    return df.to(ctx.flush().select(*kept, *(c.alias(k) for k, c in made.items() if k not in df.columns)))


@verb
def tran_mutate_if(df: Table, predicate: Callable[..., Any], fun: Callable[[Expr], Any]) -> Table:
    """``fun`` applied to each column for which ``predicate`` holds."""
    root = Root()
    return tran_mutate(df, **{c: fun(root[c]) for c in passing(df.df, predicate)})


@verb
def tran_pull(df: Table, col: Any = -1) -> DataFrame:
    """One column as a DataFrame of one column; the last, unless one is given by name, place or expression."""
    return df.df.select(*quoted([df.columns[col] if isinstance(col, int) else named(col)]))


tf_select, tf_drop, tf_select_if, tf_drop_if = map(add_pipe, (tran_select, tran_drop, tran_select_if, tran_drop_if))
tf_rename, tf_mutate, tf_mutate_if, tf_pull = map(add_pipe, (tran_rename, tran_mutate, tran_mutate_if, tran_pull))
