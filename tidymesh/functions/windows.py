"""Functions that look at other rows of the group, in the table's row order or in the order of their values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidymesh.expr import AGGREGATE, WINDOW, Context, Expr, X, scalar, temporary, window
from tidymesh.functions.aggregates import median, place
from tidymesh.plans.rowindex import with_row_index
from tidymesh.plans.storage import settle


def _whole(grouped: Expr, x: Any, alone: Callable[[Context, str], Column]) -> Expr:
    """``grouped`` within groups; over a whole table, ``alone`` with the value as a column of that name."""

    def build(ctx: Context) -> Column:
        if ctx.groups or ctx.summary:
            return grouped._build(ctx)
        name, value = temporary(), ctx.hoisted(x)
        ctx.df = ctx.flush().withColumn(name, value)
        return alone(ctx, name)

    return Expr(build, WINDOW)


@window
def _shifted(frame, c: Column, i: int) -> Column:
    return (F.lead(c, i) if i >= 0 else F.lag(c, -i)).over(frame.by(*frame.rows))


def lead(x: Any, i: int = 1) -> Expr:
    """The value ``i`` rows on. Over a whole table, rows meet by their places."""

    def alone(ctx: Context, name: str) -> Column:
        place, other, at = temporary(), temporary(), temporary()
        df = with_row_index(ctx.df, ctx.order, place)
        ahead = df.select((F.col(place) - i).alias(at), F.col(name).alias(other))
        ctx.df = df.join(ahead, F.col(place) == F.col(at), "left").drop(place, at)
        return F.col(other)

    return _whole(_shifted(x, i), x, alone)


def lag(x: Any, i: int = 1) -> Expr:
    """The value ``i`` rows before."""
    return lead(x, -i)


def _by_value(c: Column, ascending: bool) -> Column:
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def _ranked(kind: str, fun: Callable[[], Column]) -> Callable[..., Expr]:
    @window
    def within(frame, c: Column, ascending: bool) -> Column:
        return F.when(c.isNotNull(), fun().over(frame.by(_by_value(c, ascending)))).cast("double")

    def call(x: Any, ascending: bool = True) -> Expr:
        def alone(ctx: Context, name: str) -> Column:
            """Distinct values are counted and put in order; their places, or the rows before them, are joined back."""
            v, place, before, size = temporary(), temporary(), temporary(), temporary()
            values = ctx.df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(v)).agg(F.count(F.lit(1)).alias(size))
            if kind == "dense":
                values = with_row_index(values, [_by_value(F.col(v), ascending)], place).withColumn(place, (F.col(place) + 1).cast("double"))
            else:
                run = Context(values, [], [_by_value(F.col(v), ascending)])
                (total,) = _in_blocks(run, F.col(size), [_SUM])
                values = run.df.withColumn(place, (total - F.col(size) + 1).cast("double"))
            if kind == "percent":
                rows = ctx.df.agg(F.count(F.lit(1)).alias(before))
                values = values.crossJoin(F.broadcast(rows))  # one row
                values = values.withColumn(place, F.coalesce(F.try_divide(F.col(place) - 1, F.col(before) - 1), F.lit(0.0)))
            ctx.df = ctx.df.join(values.select(v, place), F.col(name) == F.col(v), "left").drop(v)
            return F.col(place)

        return _whole(within(x, ascending), x, alone)

    return call


dense_rank = _ranked("dense", F.dense_rank)
min_rank = _ranked("min", F.rank)
percent_rank = _ranked("percent", F.percent_rank)


@window
def _numbered(frame, c: Column, ascending: bool) -> Column:
    return F.when(c.isNotNull(), F.row_number().over(frame.by(_by_value(c, ascending), *frame.rows))).cast("double")


def row_number(x: Any, ascending: bool = True) -> Expr:
    """Place by value; ties by row order."""

    def alone(ctx: Context, name: str) -> Column:
        place = temporary()
        ctx.df = with_row_index(ctx.df, [_by_value(F.col(name), ascending), *ctx.order], place)
        return F.when(F.col(name).isNotNull(), (F.col(place) + 1).cast("double"))

    return _whole(_numbered(x, ascending), x, alone)


#: Rows in a block of a running function over an ungrouped table.
BLOCK = 250_000

_Merge = Callable[[Column, Column], Column]
_SUM: tuple[Callable[[Column], Column], _Merge] = (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
_COUNT: tuple[Callable[[Column], Column], _Merge] = (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
_PRODUCT: tuple[Callable[[Column], Column], _Merge] = (F.product, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b))


def _in_blocks(ctx: Context, c: Column, parts: list[tuple[Callable[[Column], Column], _Merge]]) -> list[Column]:
    """Running values over all rows without one task for all: rows get their place, each block of places runs by
    itself, and what the blocks before have come to (a row for each block) is broadcast and merged in."""
    value, place, block = temporary(), temporary(), temporary()
    names = ctx.df.columns
    df = with_row_index(ctx.flush().withColumn(value, c), ctx.order, place).withColumn(block, F.floor(F.col(place) / BLOCK))
    v = F.col(value)
    whole = df.groupBy(block).agg(*(agg(v).alias(f"__p{i}") for i, (agg, _) in enumerate(parts)))
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(block, *(agg_of(agg)(f"__p{i}").over(before).alias(f"__p{i}") for i, (agg, _) in enumerate(parts)))
    spec = Window.partitionBy(block).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = [temporary() for _ in parts]
    met = df.join(F.broadcast(whole), block).withColumns({m: agg(v).over(spec) for m, (agg, _) in zip(made, parts)})
    met = met.withColumns({m: merge(F.col(f"__p{i}"), F.col(m)) for i, (m, (_, merge)) in enumerate(zip(made, parts))})
    ctx.df = met.select(*(F.col(f"`{n}`") for n in names), *made)
    return [F.col(m) for m in made]


def agg_of(agg: Callable) -> Callable:
    """How the blocks' values add up: as the rows' do, but counts are summed."""
    return F.sum if agg is F.count else agg


def _running(fun: Callable[[Column], Column], parts: list | None = None, final: Callable[..., Column] = lambda x: x) -> Callable[..., Expr]:
    @window
    def over(frame, c: Column) -> Column:
        return F.when(c.isNotNull(), fun(c).over(frame.running()))

    def call(x: Any) -> Expr:
        grouped = over(x)

        def build(ctx: Context) -> Column:
            if ctx.groups or ctx.summary or parts is None:
                return grouped._build(ctx)
            name, value = temporary(), ctx.hoisted(x)
            ctx.df = ctx.flush().withColumn(name, value)
            got = _in_blocks(ctx, F.col(name), parts)
            return F.when(F.col(name).isNotNull(), final(*got))

        return Expr(build, grouped._depth)

    call.__name__ = fun.__name__
    return call


cumsum = _running(F.sum, [_SUM])
cummean = _running(F.avg, [_SUM, _COUNT], lambda s, n: s / n)
cumsd = _running(F.stddev_samp)
cummax = _running(F.max, [(F.max, F.greatest)])
cummin = _running(F.min, [(F.min, F.least)])
cumprod = _running(F.product, [_PRODUCT])
cumany = _running(F.bool_or, [(F.bool_or, lambda a, b: F.greatest(a, b))])
cumall = _running(F.bool_and, [(F.bool_and, lambda a, b: F.least(a, b))])


@window
def _gaps(frame, c: Column) -> Column:
    return F.sum((~F.coalesce(c, F.lit(False))).cast("int")).over(frame.running())


@window
def _run_length(frame, c: Column, run: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(frame.by(partition=(run,)))


def consec(x: Any, i: int = 3) -> Expr:
    """True for rows in a run of ``i`` or more true rows."""
    return scalar(lambda c, n: F.coalesce(c, F.lit(False)) & (n >= i))(x, _run_length(x, _gaps(x)))


@scalar
def desc(x: Column) -> Column:
    """A sort key from large to small, missing values last."""
    return x.desc_nulls_last()


@window
def _plot_place(frame, c: Column) -> Column:
    i = F.row_number().over(frame.by(c.asc_nulls_last(), *frame.rows)).cast("double")
    n = F.count(F.lit(1)).over(frame.by()).cast("double")
    end = F.pow(F.lit(0.5), 1 / n)
    return F.when(i == 1, 1 - end).when(i == n, end).otherwise((i - 0.3175) / (n + 0.365))


def qqvals(x: Any, dist: Any = None, marg: Any = None) -> Expr:
    """What the law expects in the place of each value; the standard normal law, unless a marginal is given."""
    from tidymesh.functions.scalar import qnorm

    q = marg.q if marg is not None else qnorm
    return scalar(lambda p: q(p))(_plot_place(x))


@window
def _dominated(frame, *costs: Column) -> Column:
    """Two costs: sorted by the first, a row is dominated if a smaller or equal second cost came at most as late."""
    x, y = costs
    key = frame.by(x)
    earlier = F.min(y).over(key.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.count(F.lit(1)).over(frame.by(partition=(x, y)))
    ahead = F.min(F.struct(y.alias("y"), x.alias("x"))).over(key.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (same > 1) | (earlier < y) | (ahead["x"] < x) & (ahead["y"] <= y)


def pareto_min(*costs: Any) -> Expr:
    """True for rows that no other row of the group matches or betters in all costs (copies dominate each other).

    Over a whole table, tasks thin their rows to fronts first; within groups, two costs go by one sorted window.
    """

    def build(ctx: Context) -> Column:
        if ctx.groups or ctx.summary:
            if len(costs) != 2:
                raise ValueError("within groups, pareto_min takes two costs")
            return ~_dominated(*costs)._build(ctx)
        from tidymesh.transforms.pareto import thin

        names, values = [temporary() for _ in costs], [ctx.hoisted(c) for c in costs]
        ctx.df = ctx.flush().withColumns({n: v.cast("double") for n, v in zip(names, values)})
        best, keys = temporary(), [temporary() for _ in costs]
        front = thin(ctx.df.select(*names), names).where("__n = 1").select(*(F.col(n).alias(k) for n, k in zip(names, keys)), F.lit(True).alias(best))
        ctx.df = ctx.df.join(front, [F.col(n) == F.col(k) for n, k in zip(names, keys)], "left").drop(*keys)
        return F.coalesce(F.col(best), F.lit(False))

    return Expr(build, WINDOW)


def stratum_min(*costs: Any, max_depth: int = 10) -> Expr:
    """Which front of the whole table a row is in, fronts peeled off one after the other up to ``max_depth``; missing beyond, and for copies."""

    def build(ctx: Context) -> Column:
        if ctx.groups or ctx.summary:
            raise ValueError("stratum_min is of a whole table: ungroup it first")
        from tidymesh.transforms.pareto import strata

        names, depth = [temporary() for _ in costs], temporary()
        values = [ctx.hoisted(c) for c in costs]
        ctx.df = ctx.flush().withColumns({n: v.cast("double") for n, v in zip(names, values)})
        found = strata(ctx.df, names, max_depth)
        if found is None:
            return F.lit(None).cast("double")
        keys = [temporary() for _ in costs]
        ctx.df = ctx.df.join(found.toDF(*keys, depth), [F.col(n) == F.col(k) for n, k in zip(names, keys)], "left").drop(*keys)
        return F.col(depth)

    return Expr(build, WINDOW)


def order_series_by(x: Any, *keys: Any) -> Expr:
    """The values of ``x`` in the order of ``keys`` (desc() for a falling one), laid down the rows of the table or group in its own order; ties keep the row order."""

    def build(ctx: Context) -> Column:
        if ctx.summary:
            raise ValueError("order_series_by is for rows; first, last and nth take order_by")
        own, sorted_, value, key = (temporary() for _ in range(4))
        here, there = place(), place([*keys, place()])
        for name, e in ((own, here), (sorted_, there), (value, x)):
            column = ctx.hoisted(e)
            ctx.df = ctx.flush().withColumn(name, column)
        groups = [temporary() for _ in ctx.groups]
        ctx.df = settle(ctx.df, "series")  # it meets itself
        other = ctx.df.select(*(F.col(f"`{g}`").alias(k) for g, k in zip(ctx.groups, groups)), F.col(sorted_).alias(key), F.col(value).alias(f"{value}s"))
        on = [F.col(f"`{g}`").eqNullSafe(F.col(k)) for g, k in zip(ctx.groups, groups)] + [F.col(own) == F.col(key)]
        ctx.df = ctx.df.join(other, on, "left").drop(*groups, key)
        return F.col(f"{value}s")

    return Expr(build, WINDOW)


def fct_reorder(f: Any, x: Any, fun: Callable = median) -> Expr:
    """The place of a row's level among the levels of ``f``, from 1, by ``fun`` of ``x`` over each level.

    Levels are ranked in a table of their own, a row each, and joined back.
    """

    def build(ctx: Context) -> Column:
        key, value = ctx.hoisted(f), ctx.hoisted(x)
        place, level, by, held = temporary(), temporary(), temporary(), temporary()
        keys = [temporary() for _ in ctx.groups]
        ctx.df = ctx.flush()
        rows = ctx.df.where(key.isNotNull()).select(*(F.col(f"`{g}`").alias(k) for g, k in zip(ctx.groups, keys)), key.alias(level), value.alias(held))
        inner = Context(rows, [*keys, level], [], True)
        found = inner.summarized({by: inner.column(fun(X[held]))})
        spec = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last(), level)
        found = found.select(*keys, level, F.dense_rank().over(spec).alias(place))
        on = [F.col(f"`{g}`") == F.col(k) for g, k in zip(ctx.groups, keys)] + [key == F.col(level)]
        ctx.df = ctx.df.join(found, on, "left").drop(*keys, level)
        return F.col(place)

    return Expr(build, AGGREGATE)
