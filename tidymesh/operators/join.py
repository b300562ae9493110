"""Joins and bindings of two tables. Missing keys match each other, as values do."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.operators.select import quoted
from tidymesh.plans.rowindex import with_row_index
from tidymesh.table import Table, add_pipe, as_table, named, verb


def get_join_parameters(left: DataFrame, right: DataFrame, by: Any = None) -> list[tuple[str, str]]:
    """Pairs of key columns. ``by``: None (all common names), a name, a pair (left, right), or a list of either."""
    if by is None:
        common = [c for c in left.columns if c in right.columns]
        if not common:
            raise ValueError("no common columns to join by")
        return [(c, c) for c in common]
    if isinstance(by, tuple) and len(by) == 2:
        return [(named(by[0]), named(by[1]))]
    if not isinstance(by, (list, tuple)):
        return [(named(by), named(by))]
    return [(named(b[0]), named(b[1])) if isinstance(b, (list, tuple)) else (named(b), named(b)) for b in by]


def _join(df: Table, other: Any, how: str, by: Any, suffixes: tuple[str, str]) -> Table:
    left, right = df.df, as_table(other).df
    keys = get_join_parameters(left, right, by)
    # names that can't clash, and then the names to show
    a = left.toDF(*(f"__l{i}" for i in range(len(left.columns))))
    b = right.toDF(*(f"__r{i}" for i in range(len(right.columns))))
    la, rb = dict(zip(left.columns, a.columns)), dict(zip(right.columns, b.columns))
    on = None
    for x, y in keys:
        same = F.col(la[x]).eqNullSafe(F.col(rb[y]))
        on = same if on is None else on & same
    met = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return df.to(met.toDF(*left.columns))
    shared = {x for x, y in keys if x == y}
    both = (set(left.columns) & set(right.columns)) - shared
    out: list[Column] = []
    for c in left.columns:
        value = F.coalesce(F.col(la[c]), F.col(rb[c])) if c in shared and how in ("full_outer", "right") else F.col(la[c])
        out.append(value.alias(c + suffixes[0] if c in both else c))
    out += [F.col(rb[c]).alias(c + suffixes[1] if c in both else c) for c in right.columns if c not in shared]
    return df.to(met.select(*out), order=())


def _verb(how: str, what: str):
    @verb
    def join(df: Table, other: Any, by: Any = None, suffixes: tuple[str, str] = ("_x", "_y")) -> Table:
        return _join(df, other, how, by, suffixes)

    join.__doc__ = f"{what} Spark picks the strategy by the sides' sizes."
    return join


tran_inner_join = _verb("inner", "Rows with a match on both sides.")
tran_full_join = _verb("full_outer", "All rows of both sides.")
tran_outer_join = tran_full_join
tran_left_join = _verb("left", "All rows of the left side.")
tran_right_join = _verb("right", "All rows of the right side.")
tran_semi_join = _verb("left_semi", "Rows of the left side that have a match, each once.")
tran_anti_join = _verb("left_anti", "Rows of the left side that have no match.")


@verb
def tran_bind_rows(df: Table, other: Any, join: str = "outer") -> Table:
    """Rows of both tables, repeats kept: with all columns (``outer``) or the common ones (``inner``)."""
    right = as_table(other).df
    if join == "inner":
        common = [c for c in df.columns if c in right.columns]
        return df.to(df.df.select(*quoted(common)).unionByName(right.select(*quoted(common))), order=())
    return df.to(df.df.unionByName(right, allowMissingColumns=True), order=())


@verb
def tran_bind_cols(df: Table, other: Any, join: str = "outer") -> Table:
    """Columns of both tables side by side, row by row in their orders; the shorter is filled up (``outer``) or sets
    the length (``inner``)."""
    right = as_table(other)
    a = with_row_index(df.df, list(df.order), "__place")
    b = with_row_index(right.df, list(right.order), "__place")
    names = df.columns + right.columns
    a, b = a.toDF(*(f"__l{i}" for i in range(len(df.columns))), "__place"), b.toDF(*(f"__r{i}" for i in range(len(right.columns))), "__place")
    met = a.join(b, "__place", "full_outer" if join == "outer" else "inner").orderBy("__place")
    return df.to(met.drop("__place").toDF(*names), order=())


@verb
def tran_outer(df: Table, df_outer: Any) -> Table:
    """Each row of the table with each row of a small one, such as levels or a grid; an empty side gives the other."""
    right = as_table(df_outer).df
    if not right.columns or right.isEmpty():
        if df.df.isEmpty():
            raise ValueError("both tables are empty")
        return df
    if df.df.isEmpty():
        return df.to(right)
    return df.to(df.df.crossJoin(right), order=())


tf_inner_join, tf_full_join, tf_outer_join, tf_left_join = map(add_pipe, (tran_inner_join, tran_full_join, tran_outer_join, tran_left_join))
tf_right_join, tf_semi_join, tf_anti_join = map(add_pipe, (tran_right_join, tran_semi_join, tran_anti_join))
tf_bind_rows, tf_bind_cols, tf_outer = map(add_pipe, (tran_bind_rows, tran_bind_cols, tran_outer))
