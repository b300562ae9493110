"""Aggregate functions, for use in summaries, and inside other verbs as a value of the row's group."""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymesh.expr import AGGREGATE, WEIGHT, WINDOW, Context, Expr, Unweighted, aggregate, as_column, scalar, temporary, window
from tidymesh.plans.quantiles import placed_values
from tidymesh.plans.rowindex import with_row_index


def _z(alpha: float) -> float:
    return -NormalDist().inv_cdf(alpha)


def weighted(fun: Any) -> Any:
    """An aggregate that carries the row weight, if there is one."""
    return aggregate(fun, weighted=True)


def _count(c: Column | None = None) -> Column:
    w = WEIGHT.get()
    if w is None:
        return F.count(F.lit(1) if c is None else c)
    return F.coalesce(F.sum(w if c is None else F.when(c.isNotNull(), w)), F.lit(0)).cast("long")


def _sum(c: Column) -> Column:
    w = WEIGHT.get()
    return F.sum(c) if w is None else F.sum(c * w)


def _avg(c: Column) -> Column:
    return F.avg(c) if WEIGHT.get() is None else F.try_divide(_sum(c.cast("double")), _count(c))


def _drawn(c: Column) -> Column:
    """Values of rows that count at all."""
    w = WEIGHT.get()
    return c if w is None else F.when(w > 0, c)


def _central(c: Column, k: int) -> Column:
    """The mean of the k-th powers of deviations, from sums of powers."""
    m = [F.lit(1.0), *(_avg(F.pow(c.cast("double"), F.lit(float(j)))) for j in range(1, k + 1))]
    total = F.lit(0.0)
    for j in range(k + 1):
        total = total + math.comb(k, j) * m[j] * F.pow(-m[1], F.lit(float(k - j)))
    return total


def _var_pop(c: Column) -> Column:
    return F.var_pop(c) if WEIGHT.get() is None else F.greatest(_central(c, 2), F.lit(0.0))


def _var_samp(c: Column) -> Column:
    if WEIGHT.get() is None:
        return F.var_samp(c)
    return F.when(_count(c) > 1, _var_pop(c) * _count(c) / (_count(c) - 1))


def _sd_samp(c: Column) -> Column:
    return F.stddev_samp(c) if WEIGHT.get() is None else F.sqrt(_var_samp(c))


def _quantile(x: Any, p: float) -> Expr:
    return Expr(lambda ctx: ctx.statistic(x, p), AGGREGATE)


@weighted
def mean(c: Column) -> Column:
    return _avg(c)


@weighted
def sum(c: Column) -> Column:
    """0 where nothing is known."""
    return F.coalesce(_sum(c), F.lit(0))


@weighted
def min(c: Column) -> Column:
    return F.min(_drawn(c))


@weighted
def max(c: Column) -> Column:
    return F.max(_drawn(c))


def median(x: Any) -> Expr:
    return _quantile(x, 0.5)


def quant(x: Any, p: float) -> Expr:
    """Exact quantile, by linear interpolation; found over counts of values, so no task holds a group (plans/quantiles.py)."""
    return _quantile(x, p)


def IQR(x: Any) -> Expr:
    return scalar(lambda up, lo: up - lo)(_quantile(x, 0.75), _quantile(x, 0.25))


@weighted
def var(c: Column) -> Column:
    return _var_samp(c)


@weighted
def sd(c: Column) -> Column:
    return _sd_samp(c)


@weighted
def skew(c: Column, bias: bool = True) -> Column:
    n = _count(c).cast("double")
    g = F.skewness(c) if WEIGHT.get() is None else F.try_divide(_central(c, 3), F.pow(_var_pop(c), F.lit(1.5)))
    return g if bias else F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


@weighted
def kurt(c: Column, bias: bool = True, excess: bool = False) -> Column:
    """3 for a normal law, unless ``excess``."""
    n = _count(c).cast("double")
    k = F.kurtosis(c) if WEIGHT.get() is None else F.try_divide(_central(c, 4), _var_pop(c) * _var_pop(c)) - 3
    if not bias:
        k = F.when(n > 3, ((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return k if excess else k + 3


def _order(frame, keys: Any) -> list[Column]:
    return frame.rows if keys is None else [k if isinstance(k, Column) else as_column(k) for k in (keys if isinstance(keys, list) else [keys])]


def first(x: Any, order_by: Any = None) -> Expr:
    """The first value in row order, or in that of ``order_by`` (one key or a list)."""
    return nth(x, 0, order_by)


def last(x: Any, order_by: Any = None) -> Expr:
    return nth(x, -1, order_by)


@window
def _place_in_group(frame, keys: Any) -> Column:
    return F.row_number().over(frame.by(*_order(frame, keys)))


def place(keys: Any = None) -> Expr:
    """Each row's place in its group, from 1, in row order or in that of ``keys``; over a whole table without one task
    for all rows."""
    grouped = _place_in_group(keys)

    def build(ctx: Context) -> Column:
        if ctx.groups:
            return grouped._build(ctx)
        row = ctx.row()
        wanted = keys if isinstance(keys, list) else [keys]
        order = list(ctx.order) if keys is None else [as_column(row.hoisted(k)) for k in wanted]
        name = temporary()
        row.df = with_row_index(row.flush(), order, name)
        return F.col(name) + 1

    return Expr(build, WINDOW)


@aggregate
def _at(c: Column, place: Column, i: int) -> Column:
    if i >= 0:
        return F.max(F.when(place == i + 1, c))
    return F.max_by(c, place)


@aggregate
def _at_end(c: Column, place: Column, rows: Column, i: int) -> Column:
    return F.max(F.when(place == rows + (i + 1), c))


def _rows() -> Expr:
    """Rows of the group."""
    return n()


def nth(x: Any, n: int, order_by: Any = None) -> Expr:
    """The value at place ``n`` from 0, or from the end below 0; missing outside."""
    if n < -1:
        return _at_end(x, place(order_by), _rows(), n)
    return _at(x, place(order_by), n)


@weighted
def n(c: Column | None = None) -> Column:
    """Rows, missing values included."""
    return _count()


@weighted
def n_distinct(c: Column) -> Column:
    """Distinct values; missing counts as one."""
    return F.count_distinct(_drawn(c)) + F.coalesce(F.max(_drawn(c.isNull().cast("int"))), F.lit(0))


@weighted
def mean_lo(c: Column, alpha: float = 0.005) -> Column:
    """Lower confidence bound of the mean by the normal law."""
    return _avg(c) - _z(alpha) * _sd_samp(c) / F.sqrt(_count())


@weighted
def mean_up(c: Column, alpha: float = 0.005) -> Column:
    return _avg(c) + _z(alpha) * _sd_samp(c) / F.sqrt(_count())


def _wilson(c: Column, alpha: float) -> tuple[Column, Column]:
    z = _z(alpha / 2)
    n = _count().cast("double")
    k = _sum(c.cast("double"))
    middle = (k + z * z / 2) / (n + z * z)
    half = z / (n + z * z) * F.sqrt(F.try_divide(k * (n - k), n) + z * z / 4)
    return middle - half, middle + half


@weighted
def binomial_ci(c: Column, alpha: float = 0.05, side: str = "both") -> Column:
    """Wilson's interval of a probability: ``both`` bounds as (lo, up), or one."""
    lo, up = _wilson(c, alpha)
    return {"both": F.struct(lo.alias("lo"), up.alias("up")), "lo": lo, "up": up}[side]


@weighted
def pr(c: Column) -> Column:
    """Share of rows that are true."""
    return _avg(c.cast("double"))


@weighted
def pr_lo(c: Column, alpha: float = 0.005) -> Column:
    return _wilson(c, alpha)[0]


@weighted
def pr_up(c: Column, alpha: float = 0.005) -> Column:
    return _wilson(c, alpha)[1]


def _average_rank(x: Any, known: Any) -> Expr:
    """The rank of a value among those of the group's rows that are known, ties at their mean; values are placed once each and joined back."""

    def build(ctx: Context) -> Column:
        if ctx.weight is not None:
            raise Unweighted("ranks can't be taken of rows with weights")
        row = ctx.row()
        value = scalar(lambda c, k: F.when(k, c.cast("double")))(x, known)
        name, rank = temporary(), temporary()
        column = row.hoisted(value)
        row.df = row.flush().withColumn(name, column)
        keys = [temporary() for _ in ctx.groups]
        long = row.df.where(F.col(name).isNotNull()).select(*(F.col(f"`{g}`").alias(k) for g, k in zip(ctx.groups, keys)), F.col(name).alias("v"), F.lit(1).alias("w"))
        for k in keys:
            long = long.where(F.col(k).isNotNull())
        placed = placed_values(long, keys, "v", "w").select(*keys, F.col("v").alias(f"{rank}v"), ((F.col("from") + F.col("upto") + 1) / 2).alias(rank))
        on = [F.col(f"`{g}`") == F.col(k) for g, k in zip(ctx.groups, keys)] + [F.col(name) == F.col(f"{rank}v")]
        row.df = row.df.join(placed, on, "left").drop(*keys, f"{rank}v")
        return F.col(rank)

    return Expr(build, WINDOW)


@weighted
def _pearson(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    if WEIGHT.get() is None:  # corr itself fails where a group has one value
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.try_divide(_avg(a * b) - _avg(a) * _avg(b), F.sqrt(_var_pop(a) * _var_pop(b)))


@weighted
def _pairs(a: Column, b: Column) -> Column:
    return _count(F.when(a.isNotNull() & b.isNotNull(), 1))


def t_cdf(t: Column, df: Column, steps: int = 200) -> Column:
    """Two-sided tail of Student's law, by the regularised incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, F.lit(0.5)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("c"), (1 / (1 - (a + b) * x / (a + 1))).alias("d"), (1 / (1 - (a + b) * x / (a + 1))).alias("h"))

        def step(s: Column, m: Column) -> Column:
            e = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d1, c1 = 1 / (1 + e * s["d"]), 1 + e / s["c"]
            o = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d2, c2 = 1 / (1 + o * d1), 1 + o / c1
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])

    def log_gamma(z: Column) -> Column:
        y = z + 7
        terms = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
        shift = F.ln(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6))
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + terms - shift

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    return F.when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)


def corr(a: Any, b: Any, method: str = "pearson", res: str = "corr", nan_drop: bool = False) -> Expr:
    """Correlation of two columns, ``pearson`` or ``spearman``; ``res="both"`` adds the two-sided p-value.

    Missing values raise an error when the query runs, unless ``nan_drop``.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"method: pearson or spearman, not {method!r}")
    x, y = a, b
    if method == "spearman":
        known = scalar(lambda p, q: p.isNotNull() & q.isNotNull())(a, b)
        x, y = _average_rank(a, known), _average_rank(b, known)
    r = _pearson(x, y)
    if not nan_drop:
        missing = _missing(a, b)
        r = scalar(lambda r, m: F.when(m > 0, F.raise_error("corr: missing values; nan_drop=True leaves them out").cast("double")).otherwise(r))(r, missing)
    if res == "corr":
        return r

    def tested(r: Column, n: Column) -> Column:
        left = F.greatest(1 - r * r, F.lit(1e-300))
        p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_cdf(r * F.sqrt(F.greatest(n - 2, F.lit(1)) / left), F.greatest(n - 2, F.lit(1)).cast("double")))
        return F.struct(r.alias("corr"), F.when(n > 2, p).alias("pvalue"))

    return scalar(tested)(r, _pairs(a, b))


@weighted
def _missing(a: Column, b: Column) -> Column:
    return _count(F.when(a.isNull() | b.isNull(), 1))


@weighted
def mad(p: Column, m: Column) -> Column:
    return _avg(F.abs(p - m))


def mead(p: Any, m: Any) -> Expr:
    return _quantile(scalar(lambda p, m: F.abs(p - m))(p, m), 0.5)


@weighted
def mse(p: Column, m: Column) -> Column:
    return _avg((p - m) * (p - m))


@weighted
def rmse(p: Column, m: Column) -> Column:
    return F.sqrt(_avg((p - m) * (p - m)))


@weighted
def rel_mse(p: Column, m: Column) -> Column:
    r = F.try_divide(p - m, m)
    return _avg(r * r)


def _rsq(p: Column, m: Column) -> Column:
    return 1 - F.try_divide(_sum((m - p) * (m - p)), _var_pop(m) * _count(m))


@weighted
def rsq(p: Column, m: Column) -> Column:
    return _rsq(p, m)


@weighted
def ndme(p: Column, m: Column) -> Column:
    """Non-dimensional model error: the square root of what R squared leaves."""
    return F.sqrt(F.greatest(1 - _rsq(p, m), F.lit(0.0)))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _order_statistic(n: int, m: int, j: int, prob: float) -> int:
    """Least k with P(at most k of n old values lie below the j-th of m new ones) >= prob."""
    total, below = _log_choose(n + m, m), 0.0
    for k in range(n + 1):
        below += math.exp(_log_choose(k + j - 1, k) + _log_choose(n + m - k - j, n - k) - total)
        if below >= prob - 1e-12:
            return k
    return n


def pint_lo_index(n: int, m: int, j: int, alpha: float) -> int:
    """Which of ``n`` ordered values bounds the ``j``-th of ``m`` new ones from below, from 1; too few values raise."""
    index = _order_statistic(n, m, j, alpha)
    if index < 1:
        raise ValueError(f"{n} values are too few for a lower bound at {alpha}")
    return index


def pint_up_index(n: int, m: int, j: int, alpha: float) -> int:
    index = _order_statistic(n, m, j, 1 - alpha) + 1
    if index > n:
        raise ValueError(f"{n} values are too few for an upper bound at {alpha}")
    return index


def _index_column(n: Column, m: int, j: int, prob: float, up: bool) -> Column:
    """The index for a column of sample sizes: the same sum as _order_statistic, by an array of n + 1 terms; for one new
    value, in closed form."""
    if m == 1:
        at = F.greatest(F.ceil(prob * (n + 1) - 1 - 1e-9), F.lit(0)).cast("long")
        return at + 1 if up else at

    def term(k: Column) -> Column:
        def lg(x: Any) -> Column:
            y = as_column(x).cast("double") + 7
            z = as_column(x).cast("double")
            shift = F.ln(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6))
            return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

        def choose(a: Column, b: Column) -> Column:
            return lg(a + 1) - lg(b + 1) - lg(a - b + 1)

        return F.exp(choose(k + j - 1, k) + choose(n + m - k - j, n - k) - choose(n + m, F.lit(m)))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))

    def step(s: Column, k: Column) -> Column:
        below = s["sum"] + term(k)
        return F.struct(below.alias("sum"), F.coalesce(s["at"], F.when(below >= prob - 1e-12, k.cast("long"))).alias("at"))

    at = F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda s: F.coalesce(s["at"], n.cast("long")))
    return at + 1 if up else at


def pint_lo(x: Any, m: int = 1, j: int = 1, alpha: float = 0.005) -> Expr:
    """Lower prediction bound without a law: an order statistic of the group's known values; missing where they are too few."""
    return Expr(lambda ctx: ctx.statistic(x, lambda n: _index_column(n, m, j, alpha, False) - 1), AGGREGATE)


def pint_up(x: Any, m: int = 1, j: int = 1, alpha: float = 0.005) -> Expr:
    return Expr(lambda ctx: ctx.statistic(x, lambda n: _index_column(n, m, j, 1 - alpha, True) - 1), AGGREGATE)


@weighted
def neff_is(w: Column) -> Column:
    """Effective number of rows under importance weights."""
    return F.try_divide(_count() * _avg(w) * _avg(w), _avg(w * w))
