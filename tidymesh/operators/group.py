"""Groups and summaries."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.expr import Expr, Root
from tidymesh.operators.select import quoted, resolve_selection
from tidymesh.plans.quantiles import exact_quantiles
from tidymesh.table import Table, add_pipe, flatten, named, verb


@verb
def tran_group_by(df: Table, *args: Any) -> Table:
    """State the groups for the verbs that follow; no data moves."""
    names = tuple(named(a) for a in flatten(args))
    if missing := set(names) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    return df.to(df.df, groups=names)


@verb
def tran_ungroup(df: Table) -> Table:
    return df.to(df.df, groups=())


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df


@verb
def tran_summarize(df: Table, **columns: Any) -> Table:
    """One row for each group (rows with a missing key have no group), or one for the table. The keys are stated as its order; rows are
    sorted by them only where that is asked for, as sorting takes a shuffle."""
    ctx = df.context(summary=True)
    made = {}
    for name, x in columns.items():
        if not isinstance(x, Expr):
            made[name] = F.lit(x)
        elif x._depth:
            made[name] = ctx.column(x)
        else:
            made[name] = ctx.aggregated(lambda inner, x=x: F.first(inner(x)))
    return Table(ctx.summarized(made), order=tuple(k.asc() for k in quoted(df.groups)), meta=df.meta)


@verb
def tran_summarize_each(df: Table, functions: list[Callable[[Expr], Expr]], *args: Any) -> Table:
    """Each function of each column, named column_function."""
    root = Root()
    return tran_summarize(df, **{f"{c}_{f.__name__}": f(root[c]) for c in resolve_selection(df.columns, *args) for f in functions})


@verb
def tran_count(df: Table, *args: Any) -> Table:
    """Rows of each combination of keys, as ``n``."""
    keys = [named(a) for a in flatten(args)] or list(df.groups)
    out = _known(df.df, keys).groupBy(*quoted(keys)).agg((F.count(F.lit(1)) if df.weight is None else F.sum(df.weight)).alias("n"))
    return Table(out, order=tuple(k.asc() for k in quoted(keys)))


@verb
def tran_describe(df: Table) -> Table:
    """count, mean, std, min, quartiles and max of the numeric columns, a row for each statistic: a pass of aggregates and one of counts of values."""
    names = [f.name for f in df.df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "25%": 0.25, "50%": 0.5, "75%": 0.75, "max": F.max}
    shares = [p for p in stats.values() if isinstance(p, float)]
    wide = df.df.agg(*(f(F.col(f"`{c}`")).cast("double").alias(f"{s}{i}") for s, f in stats.items() if callable(f) for i, c in enumerate(names)))
    found = exact_quantiles(df.df, [], [(F.col(f"`{c}`"), shares) for c in names])
    wide = wide.crossJoin(F.broadcast(found))  # a row each
    at = {s: (lambda i, s=s: f"{s}{i}") if callable(f) else (lambda i, f=f: f"q{i}_{shares.index(f)}") for s, f in stats.items()}
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), *(F.col(f"`{at[s](i)}`").alias(c) for i, c in enumerate(names))) for s in stats)))
    return Table(wide.select(rows.alias("r")).select("r.statistic", *(F.col("r")[c].alias(c) for c in names)))


@verb
def tran_apply(df: Table, fun: Callable[[Any], Any], schema: str) -> Table:
    """A Python function of each group's rows as a pandas frame, for what no expression can say; ``schema``: what it gives.
    A group must fit a worker. Without groups, the function gets the rows in batches."""
    if df.groups:
        return Table(df.df.groupBy(*quoted(df.groups)).applyInPandas(fun, schema))

    def run(frames: Any) -> Any:
        for f in frames:
            yield fun(f)

    return Table(df.df.mapInPandas(run, schema))


tf_apply = add_pipe(tran_apply)
tf_group_by, tf_ungroup, tf_summarize, tf_summarize_each, tf_count, tf_describe = map(add_pipe, (tran_group_by, tran_ungroup, tran_summarize, tran_summarize_each, tran_count, tran_describe))
tran_summarise, tf_summarise = tran_summarize, tf_summarize
