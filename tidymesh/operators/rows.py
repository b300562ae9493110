"""Verbs that pick or order rows."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidymesh.expr import Expr
from tidymesh.operators.select import quoted
from tidymesh.plans.rowindex import with_row_index
from tidymesh.table import Table, add_pipe, flatten, named, verb


def _columns(df: Table, args: tuple[Any, ...], summary: bool = False) -> tuple[Any, list[Column]]:
    ctx = df.context(summary)
    made = [ctx.column(a) if isinstance(a, Expr) else F.col(f"`{df.columns[a]}`") if isinstance(a, int) else a if isinstance(a, Column) else F.col(f"`{a}`") for a in args]
    return ctx, made


def _keys(df: Table) -> list[Column]:
    return quoted(df.groups)


@verb
def tran_filter(df: Table, *args: Any) -> Table:
    """Rows for which all conditions hold; conditions may use aggregates and windows of the row's group."""
    ctx, made = _columns(df, args)
    out = ctx.flush()
    for c in made:
        out = out.where(c)
    return df.to(out.select(*quoted(df.columns)))


mask = tran_filter


@verb
def tran_dropna(df: Table, how: str = "any", subset: list[str] | None = None) -> Table:
    """Rows without missing values (NULL or NaN); ``how="all"``: rows with a known value."""
    return df.to(df.df.dropna(how, subset=[named(s) for s in subset] if subset else None))


@verb
def tran_distinct(df: Table, *args: Any, keep: str | bool = "first") -> Table:
    """One row for each combination of the columns (all, if none are given): the first or last in row order, or, with
    ``keep=False``, only rows that have no like. Over all columns no order is needed, and no window."""
    names = [df.columns[a] if isinstance(a, int) else named(a) for a in flatten(args)] or df.columns
    if keep not in ("first", "last", False):
        raise ValueError("keep: first, last or False")
    if set(names) == set(df.columns) and keep:
        return df.to(df.df.dropDuplicates())
    if keep is False:
        if set(names) == set(df.columns):
            once = df.df.groupBy(*quoted(names)).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1")
            return df.to(once.select(*quoted(df.columns)))
        kept = df.df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*quoted(names)))).where("__n = 1")
        return df.to(kept.select(*quoted(df.columns)))
    return df.to(_nth_rows(df, 1, quoted(names), keep == "last"))


def _nth_rows(df: Table, n: int, partition: list[Column], last: bool):
    """The first or last ``n`` rows of each partition, in row order."""
    if last:
        placed = df.df.withColumn("__place", F.row_number().over(Window.partitionBy(*partition).orderBy(*df.rows)))
        placed = placed.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*partition)))
        kept = placed.where(F.col("__place") > F.col("__size") - n)
    else:
        # a bound on the row number becomes a limit for each partition before the shuffle
        kept = df.df.withColumn("__place", F.row_number().over(Window.partitionBy(*partition).orderBy(*df.rows))).where(F.col("__place") <= n)
    return kept.select(*quoted(df.columns))


@verb
def tran_head(df: Table, n: int = 5) -> Table:
    """The first rows, of each group if there are groups."""
    if df.groups:
        return df.to(_nth_rows(df, n, _keys(df), False))
    return df.to(df.df.orderBy(*df.order).limit(n) if df.order else df.df.limit(n))


@verb
def tran_tail(df: Table, n: int = 5) -> Table:
    if df.groups:
        return df.to(_nth_rows(df, n, _keys(df), True))
    numbered = with_row_index(df.df, list(df.order), "__place")
    # the n largest places: each task keeps n rows
    return df.to(numbered.orderBy(F.desc("__place")).limit(n).orderBy("__place").select(*quoted(df.columns)))


@verb
def tran_sample(df: Table, n: int | None = None, frac: float | None = None, replace: bool = False, weights: Any = None, random_state: int | None = None) -> Table:
    """Rows at random, of each group if there are groups: ``n`` of them, or each with chance ``frac``.

    ``weights``: chances in proportion to a column (the n largest of u ** (1 / w)). ``replace``: each row comes as
    often as a Poisson number with mean ``frac`` says; with ``n``, ``n`` rows are drawn by their places.
    """
    seed = random_state if random_state is not None else 0
    if (n is None) == (frac is None):
        n, frac = (1, None) if n is None else (_refuse("n or frac, not both"), None)
    if replace:
        if df.groups:
            raise ValueError("with replacement: ungroup first")
        if frac is not None:
            return df.to(df.df.sample(withReplacement=True, fraction=frac, seed=seed))
        numbered = with_row_index(df.df, list(df.order), "__place")
        size = numbered.count()
        drawn = df.df.sparkSession.range(n if size else 0).select(F.floor(F.rand(seed) * size).alias("__place"))
        return df.to(drawn.join(numbered, "__place").select(*quoted(df.columns)))
    chance = F.rand(seed)
    if weights is not None:
        w = F.col(f"`{named(weights)}`")
        chance = F.when(w > 0, -F.ln(F.rand(seed)) / w)
    if frac is not None and weights is None and not df.groups:
        return df.to(df.df.sample(fraction=frac, seed=seed))
    drawn = df.df.withColumn("__u", chance).where(F.col("__u").isNotNull())
    if not df.groups and n is not None:
        return df.to(drawn.orderBy("__u").limit(n).select(*quoted(df.columns)))
    spec = Window.partitionBy(*_keys(df))
    drawn = drawn.withColumn("__k", F.row_number().over(spec.orderBy("__u")))
    if n is None:
        drawn = drawn.withColumn("__n", F.count(F.lit(1)).over(spec)).where(F.col("__k") <= F.bround(F.col("__n") * frac))
    else:
        drawn = drawn.where(F.col("__k") <= n)
    return df.to(drawn.select(*quoted(df.columns)))


def _refuse(why: str) -> Any:
    raise ValueError(why)


@verb
def tran_row_slice(df: Table, indices: int | list[int] | list[bool]) -> Table:
    """Rows by place from 0 (of each group), in the order of ``indices``; truth values say for each row whether it stays."""
    places = [indices] if isinstance(indices, int) else list(indices)
    if places and all(isinstance(p, bool) for p in places):
        places = [i for i, p in enumerate(places) if p]
    wanted = df.df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(places)], "__place bigint, __turn bigint")
    if df.groups:
        place = (F.row_number().over(Window.partitionBy(*_keys(df)).orderBy(*df.rows)) - 1).cast("long")
        numbered = df.df.withColumn("__place", place)
    else:
        numbered = with_row_index(df.df, list(df.order), "__place")
    if any(p < 0 for p in places):
        size = F.count(F.lit(1)).over(Window.partitionBy(*_keys(df))) if df.groups else F.lit(numbered.count())
        back = numbered.withColumn("__place", F.col("__place") - size)
        numbered = numbered.unionByName(back)
    met = numbered.join(F.broadcast(wanted), "__place")
    return df.to(met.orderBy(*_keys(df), "__turn").select(*quoted(df.columns)))


@verb
def tran_top_n(df: Table, n: int, ascending: bool = True, col: Any = -1) -> Table:
    """Rows with one of the ``n`` largest values (``ascending=False``: smallest), ties included, of each group."""
    c = F.col(f"`{df.columns[col] if isinstance(col, int) else named(col)}`")
    key = c.desc_nulls_last() if ascending else c.asc_nulls_last()
    if df.groups:
        kept = df.df.where(c.isNotNull()).withColumn("__k", F.rank().over(Window.partitionBy(*_keys(df)).orderBy(key))).where(F.col("__k") <= n)
        return df.to(kept.select(*quoted(df.columns)))
    # the n-th value first: each task sends n rows, and the table is not sorted
    edge = df.df.where(c.isNotNull()).select(c.alias("__v")).orderBy(F.desc("__v") if ascending else F.asc("__v")).limit(n)
    edge = edge.agg((F.min if ascending else F.max)("__v").alias("__edge"))
    met = df.df.crossJoin(F.broadcast(edge)).where(c >= F.col("__edge") if ascending else c <= F.col("__edge"))
    return df.to(met.select(*quoted(df.columns)))


@verb
def tran_arrange(df: Table, *args: Any, ascending: bool | list[bool] = True) -> Table:
    """Rows sorted by the keys, missing values last; with groups, within each group. The order stays known."""
    ctx, made = _columns(df, args)
    ways = ascending if isinstance(ascending, list) else [ascending] * len(made)
    # an expression that already states its direction keeps it
    keys = []
    for a, c, up in zip(args, made, ways):
        text = c._jc.toString()
        stated = " NULLS " in text
        keys.append(c if stated else c.asc_nulls_last() if up else c.desc_nulls_last())
    out = ctx.flush()
    keys = [k.asc_nulls_last() for k in _keys(df)] + keys
    temporary = [c for c in out.columns if c not in df.columns]
    sorted_ = out.orderBy(*keys)
    return replace(df, df=sorted_.drop(*temporary) if temporary else sorted_, order=() if temporary else tuple(keys))


tf_filter = tf_mask = add_pipe(tran_filter)
tf_dropna, tf_distinct, tf_head, tf_tail, tf_sample = map(add_pipe, (tran_dropna, tran_distinct, tran_head, tran_tail, tran_sample))
tf_row_slice, tf_top_n, tf_arrange = map(add_pipe, (tran_row_slice, tran_top_n, tran_arrange))
