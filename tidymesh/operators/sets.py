"""Set operations on tables with the same columns in the same order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymesh.operators.select import quoted
from tidymesh.table import Table, add_pipe, as_table, verb


def validate_set_ops(df: DataFrame, other: DataFrame) -> None:
    if df.columns != other.columns:
        raise ValueError(f"columns differ: {df.columns} and {other.columns}")


def _once(df: DataFrame) -> DataFrame:
    return df.groupBy(*quoted(df.columns)).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")


def _set(combine):
    @verb
    def operation(df: Table, other: Any, keep: str | bool = "first") -> Table:
        right = as_table(other).df
        validate_set_ops(df.df, right)
        return df.to(combine(df.df, right, keep), order=())

    return operation


tran_union = _set(lambda a, b, keep: a.union(b).distinct() if keep else _once(a.union(b)))
tran_union.__doc__ = "Rows of either table, each once; ``keep=False``: rows that come only once."
tran_intersect = _set(lambda a, b, keep: a.intersect(b) if keep else _once(a).intersect(b))
tran_intersect.__doc__ = "Rows of both tables, each once; missing values are equal."
tran_set_diff = _set(lambda a, b, keep: a.subtract(b) if keep else _once(a).subtract(b))
tran_set_diff.__doc__ = "Rows of the first table that the second has not, each once."
tf_union, tf_intersect, tf_set_diff = map(add_pipe, (tran_union, tran_intersect, tran_set_diff))
