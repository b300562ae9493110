"""Marginal distributions: density, distribution function and quantile as Spark columns or on plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymesh.functions.special import Columns, Numbers  # noqa: F401
from tidymesh.functions.special import of as _of
from tidymesh.models.laws import MORE_LAWS
from tidymesh.models.likelihood import first_guess, scoring
from tidymesh.plans.quantiles import exact_quantiles
from tidymesh.table import Table, as_table, named


@dataclass(frozen=True)
class Law:
    """A standard form (location 0, scale 1): its shape parameters, and its functions of (math, x, shapes)."""

    shapes: tuple[str, ...]
    d: Any
    p: Any
    q: Any


def _inside(m: Any, x: Any, lo: float, hi: float, value: Any) -> Any:
    return m.where((x >= lo) & (x <= hi), value, 0.0)


def _triang_q(m: Any, u: Any, c: float) -> Any:
    return m.where(u <= c, m.sqrt(u * c), 1 - m.sqrt((1 - u) * (1 - c)))


LAWS: dict[str, Law] = {
    "norm": Law((), lambda m, x: m.exp(-x * x / 2) / math.sqrt(2 * math.pi), lambda m, x: m.pnorm(x), lambda m, u: m.qnorm(u)),
    "uniform": Law((), lambda m, x: _inside(m, x, 0, 1, 1.0), lambda m, x: m.where(x < 0, 0.0, m.where(x > 1, 1.0, x)), lambda m, u: u),
    "lognorm": Law(("s",), lambda m, x, s: m.where(x > 0, m.exp(-(m.log(x) ** 2) / (2 * s * s)) / (x * s * math.sqrt(2 * math.pi)), 0.0), lambda m, x, s: m.where(x > 0, m.pnorm(m.log(x) / s), 0.0), lambda m, u, s: m.exp(s * m.qnorm(u))),
    "expon": Law((), lambda m, x: m.where(x >= 0, m.exp(-x), 0.0), lambda m, x: m.where(x >= 0, 1 - m.exp(-x), 0.0), lambda m, u: -m.log(1 - u)),
    "weibull_min": Law(("c",), lambda m, x, c: m.where(x > 0, c * m.power(x, c - 1) * m.exp(-m.power(x, c)), 0.0), lambda m, x, c: m.where(x > 0, 1 - m.exp(-m.power(x, c)), 0.0), lambda m, u, c: m.power(-m.log(1 - u), 1 / c)),
    "logistic": Law((), lambda m, x: m.exp(-x) / m.power(1 + m.exp(-x), 2), lambda m, x: 1 / (1 + m.exp(-x)), lambda m, u: m.log(u / (1 - u))),
    "pareto": Law(("b",), lambda m, x, b: m.where(x >= 1, b / m.power(x, b + 1), 0.0), lambda m, x, b: m.where(x >= 1, 1 - m.power(x, -b), 0.0), lambda m, u, b: m.power(1 - u, -1 / b)),
    "triang": Law(("c",), lambda m, x, c: _inside(m, x, 0, 1, m.where(x < c, 2 * x / c, 2 * (1 - x) / (1 - c))), lambda m, x, c: m.where(x < 0, 0.0, m.where(x > 1, 1.0, m.where(x < c, x * x / c, 1 - (1 - x) * (1 - x) / (1 - c)))), _triang_q),
    "gumbel_r": Law((), lambda m, x: m.exp(-x - m.exp(-x)), lambda m, x: m.exp(-m.exp(-x)), lambda m, u: -m.log(-m.log(u))),
    "gumbel_l": Law((), lambda m, x: m.exp(x - m.exp(x)), lambda m, x: 1 - m.exp(-m.exp(x)), lambda m, u: m.log(-m.log(1 - u))),
    "cauchy": Law((), lambda m, x: 1 / (math.pi * (1 + x * x)), lambda m, x: 0.5 + m.atan(x) / math.pi, lambda m, u: m.tan(math.pi * (u - 0.5))),
    "laplace": Law((), lambda m, x: m.exp(-m.abs(x)) / 2, lambda m, x: m.where(x < 0, m.exp(x) / 2, 1 - m.exp(-x) / 2), lambda m, u: m.where(u < 0.5, m.log(2 * u), -m.log(2 * (1 - u)))),
    "rayleigh": Law((), lambda m, x: m.where(x >= 0, x * m.exp(-x * x / 2), 0.0), lambda m, x: m.where(x >= 0, 1 - m.exp(-x * x / 2), 0.0), lambda m, u: m.sqrt(-2 * m.log(1 - u))),
    "powerlaw": Law(("a",), lambda m, x, a: _inside(m, x, 0, 1, a * m.power(x, a - 1)), lambda m, x, a: m.where(x < 0, 0.0, m.where(x > 1, 1.0, m.power(x, a))), lambda m, u, a: m.power(u, 1 / a)),
}
# laws that hold themselves to their support
LAWS |= {name: Law(x.shapes, lambda m, v, *s, x=x: x.d(v, *s), lambda m, v, *s, x=x: x.p(v, *s), lambda m, v, *s, x=x: x.q(v, *s)) for name, x in MORE_LAWS.items()}


class Marginal:
    """``sign``: which way is conservative (-1, 0, 1). d, p and q take columns or numbers."""

    sign: int = 0

    def d(self, x: Any) -> Any:
        raise NotImplementedError

    def p(self, x: Any) -> Any:
        raise NotImplementedError

    def q(self, u: Any) -> Any:
        raise NotImplementedError

    def summary(self) -> str:
        return repr(self)


def _known(x: Any, value: Any) -> Any:
    return F.when(x.isNotNull(), value) if isinstance(x, Column) else value


@dataclass(frozen=True)
class MarginalNamed(Marginal):
    """A named law with its parameters: loc, scale and its shapes."""

    d_name: str
    d_param: dict[str, float] = field(default_factory=dict)
    sign: int = 0

    def __post_init__(self) -> None:
        if self.d_name not in LAWS:
            raise ValueError(f"no law {self.d_name!r}; there are {sorted(LAWS)}")
        if unknown := set(self.d_param) - {"loc", "scale", *LAWS[self.d_name].shapes}:
            raise ValueError(f"{self.d_name} has no parameters {sorted(unknown)}")

    @property
    def _parts(self) -> tuple[Law, float, float, list[float]]:
        law = LAWS[self.d_name]
        return law, float(self.d_param.get("loc", 0.0)), float(self.d_param.get("scale", 1.0)), [float(self.d_param[s]) for s in law.shapes]

    def d(self, x: Any) -> Any:
        law, loc, scale, shapes = self._parts
        return _known(x, law.d(_of(x), (x - loc) / scale, *shapes) / scale)

    def p(self, x: Any) -> Any:
        law, loc, scale, shapes = self._parts
        return _known(x, law.p(_of(x), (x - loc) / scale, *shapes))

    def q(self, u: Any) -> Any:
        law, loc, scale, shapes = self._parts
        return _known(u, law.q(_of(u), u, *shapes) * scale + loc)


@dataclass(frozen=True)
class MarginalTruncated(Marginal):
    """A law held to an interval."""

    marg: Marginal
    lo: float = -math.inf
    up: float = math.inf
    sign: int = 0

    @property
    def _ends(self) -> tuple[float, float]:
        a = float(self.marg.p(self.lo)) if math.isfinite(self.lo) else 0.0
        b = float(self.marg.p(self.up)) if math.isfinite(self.up) else 1.0
        return a, b

    def d(self, x: Any) -> Any:
        a, b = self._ends
        return _of(x).where((x >= self.lo) & (x <= self.up), self.marg.d(x) / (b - a), 0.0)

    def p(self, x: Any) -> Any:
        a, b = self._ends
        m = _of(x)
        return m.where(x < self.lo, 0.0, m.where(x > self.up, 1.0, (self.marg.p(x) - a) / (b - a)))

    def q(self, u: Any) -> Any:
        a, b = self._ends
        return self.marg.q(a + (b - a) * u)


@dataclass(frozen=True)
class MarginalGKDE(Marginal):
    """Gaussian kernels at kept points (the data, or even quantiles of them); quantiles are read from a table of the
    distribution function."""

    points: tuple[float, ...]
    h: float
    sign: int = 0

    def _sum(self, x: Any, f: Any) -> Any:
        if isinstance(x, Column):
            at = F.array(*(F.lit(p) for p in self.points))
            return F.aggregate(at, F.lit(0.0), lambda s, p: s + f(Columns, (x - p) / self.h)) / len(self.points)
        z = (np.asarray(x, float)[..., None] - np.array(self.points)) / self.h
        return f(Numbers, z).mean(axis=-1)

    def d(self, x: Any) -> Any:
        return self._sum(x, LAWS["norm"].d) / self.h

    def p(self, x: Any) -> Any:
        return self._sum(x, LAWS["norm"].p)

    def q(self, u: Any) -> Any:
        grid = np.linspace(min(self.points) - 6 * self.h, max(self.points) + 6 * self.h, 401)
        cdf = np.maximum.accumulate(self.p(grid))
        if not isinstance(u, Column):
            return np.interp(u, cdf, grid)
        steps = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for a, b, x, y in zip(cdf, cdf[1:], grid, grid[1:])))
        cell = F.try_element_at(F.filter(steps, lambda s: s["b"] >= u), F.lit(1))
        return F.coalesce(cell["x"] + (cell["y"] - cell["x"]) * F.greatest(F.coalesce(F.try_divide(u - cell["a"], cell["b"] - cell["a"]), F.lit(0.0)), F.lit(0.0)), F.lit(float(grid[-1])))


def marg_named(dist: str, sign: int = 0, **param: float) -> MarginalNamed:
    return MarginalNamed(dist, param, sign)


def marg_mom(dist: str, mean: float | None = None, sd: float | None = None, cov: float | None = None, var: float | None = None, lo: float | None = None, up: float | None = None, floc: float | None = None, sign: int = 0) -> Marginal:
    """A law with the stated mean and spread (sd, var, or cov = sd / mean)."""
    if mean is None:
        raise ValueError("a mean is needed")
    spread = [s for s in (sd, None if var is None else math.sqrt(var), None if cov is None else abs(cov * mean)) if s is not None]
    if len(spread) != 1:
        raise ValueError("one of sd, var and cov is needed")
    s = spread[0]
    g = 0.5772156649015329
    if dist == "norm":
        param = {"loc": mean, "scale": s}
    elif dist == "uniform":
        param = {"loc": mean - math.sqrt(3) * s, "scale": 2 * math.sqrt(3) * s}
    elif dist == "lognorm":
        at = mean - (floc or 0.0)
        w = math.sqrt(math.log(1 + (s / at) ** 2))
        param = {"s": w, "scale": at * math.exp(-w * w / 2), "loc": floc or 0.0}
    elif dist == "expon":
        param = {"loc": mean - s, "scale": s}
    elif dist == "logistic":
        param = {"loc": mean, "scale": s * math.sqrt(3) / math.pi}
    elif dist == "laplace":
        param = {"loc": mean, "scale": s / math.sqrt(2)}
    elif dist in ("gumbel_r", "gumbel_l"):
        b = s * math.sqrt(6) / math.pi
        param = {"loc": mean - g * b if dist == "gumbel_r" else mean + g * b, "scale": b}
    elif dist == "rayleigh":
        b = s / math.sqrt((4 - math.pi) / 2)
        param = {"loc": mean - b * math.sqrt(math.pi / 2), "scale": b}
    elif dist == "weibull_min":
        at = mean - (floc or 0.0)
        lo_c, hi_c = 0.1, 100.0
        for _ in range(200):
            c = math.sqrt(lo_c * hi_c)
            ratio = math.exp(math.lgamma(1 + 2 / c) - 2 * math.lgamma(1 + 1 / c)) - 1
            lo_c, hi_c = (c, hi_c) if ratio > (s / at) ** 2 else (lo_c, c)
        param = {"c": c, "scale": at / math.gamma(1 + 1 / c), "loc": floc or 0.0}
    else:
        raise ValueError(f"no moments rule for {dist!r}")
    out: Marginal = MarginalNamed(dist, param, sign)
    return marg_trunc(out, lo, up, sign) if lo is not None or up is not None else out


def marg_trunc(marg: Marginal, lo: float | None = None, up: float | None = None, sign: int = 0) -> MarginalTruncated:
    if lo is None and up is None:
        raise ValueError("a bound is needed")
    return MarginalTruncated(marg, -math.inf if lo is None else lo, math.inf if up is None else up, sign or marg.sign)


#: Laws whose fit one pass of aggregates gives, and the ends of the laws above for the others.
CLOSED_FITS = ("norm", "uniform", "expon", "lognorm", "rayleigh", "pareto", "powerlaw")
FITTED_ENDS = {"lognorm": (0.0, math.inf), "expon": (0.0, math.inf), "weibull_min": (0.0, math.inf), "pareto": (0.0, math.inf), "rayleigh": (0.0, math.inf), "triang": (0.0, 1.0), "powerlaw": (0.0, 1.0), "uniform": (0.0, 1.0)}


def fit_columns(dist: str, x: Column) -> dict[str, Column]:
    """Aggregates that are the law's parameters of greatest likelihood."""
    if dist == "norm":
        return {"loc": F.avg(x), "scale": F.stddev_pop(x)}
    if dist == "uniform":
        return {"loc": F.min(x), "scale": F.max(x) - F.min(x)}
    if dist == "expon":
        return {"loc": F.min(x), "scale": F.avg(x) - F.min(x)}
    if dist == "lognorm":
        return {"s": F.stddev_pop(F.ln(x)), "scale": F.exp(F.avg(F.ln(x))), "loc": F.lit(0.0)}
    if dist == "rayleigh":
        return {"loc": F.lit(0.0), "scale": F.sqrt(F.avg(x * x) / 2)}
    if dist == "pareto":
        return {"scale": F.min(x), "b": 1 / (F.avg(F.ln(x)) - F.ln(F.min(x))), "loc": F.lit(0.0)}
    if dist == "powerlaw":
        return {"scale": F.max(x), "a": 1 / (F.ln(F.max(x)) - F.avg(F.ln(x))), "loc": F.lit(0.0)}
    raise ValueError(f"no rule of greatest likelihood for {dist!r}")


def marg_fit(dist: str, data: Table, col: Any = None, sign: int = 0, **given: float) -> MarginalNamed:
    """The law of greatest likelihood for a column.

    Where aggregates give it, from one pass; else by scoring (models/likelihood.py). ``floc``, ``fscale`` and ``f<shape>`` fix a parameter;
    ``loc``, ``scale`` and shapes are first guesses. The location is 0 for laws with an end, and free for those of all numbers, unless
    floc fixes it or a guess of loc frees it. Laws of an interval (such as beta) keep location 0 and scale 1 where the data are inside.
    """
    if dist not in LAWS:
        raise ValueError(f"no law {dist!r}; there are {sorted(LAWS)}")
    shapes = LAWS[dist].shapes
    fixed = {k[1:]: float(v) for k, v in given.items() if k[:1] == "f" and k[1:] in ("loc", "scale", *shapes)}
    guesses = {k: float(v) for k, v in given.items() if k not in {"f" + n for n in fixed}}
    if unknown := set(guesses) - {"loc", "scale", *shapes}:
        raise ValueError(f"{dist} has no parameters {sorted(unknown)}")
    df = as_table(data).df
    x = F.col(f"`{named(col) if col is not None else df.columns[0]}`")
    if not given and dist == "laplace":
        at = exact_quantiles(df, [], [(x, [0.5])]).first()[0]
        return MarginalNamed(dist, {"loc": at, "scale": df.agg(F.avg(F.abs(x - at))).first()[0]}, sign)
    if not given and dist in CLOSED_FITS:
        row = df.agg(*(c.alias(k) for k, c in fit_columns(dist, x).items())).first()
        return MarginalNamed(dist, row.asDict(), sign)
    mean, sd, least, most = (None if v is None else float(v) for v in df.agg(F.avg(x), F.stddev_pop(x), F.min(x), F.max(x)).first())
    if mean is None:
        raise ValueError("no values to fit a law to")
    lo, hi = MORE_LAWS[dist].support(*(1.0 for _ in shapes)) if dist in MORE_LAWS else FITTED_ENDS.get(dist, (-math.inf, math.inf))
    start = {"loc": 0.0} | first_guess(dist, shapes, mean, sd or 0.0) | guesses
    if math.isfinite(lo) and math.isfinite(hi) and "loc" not in guesses:
        inside = lo < least and most < hi
        room = 0.0 if inside else (most - least) * 0.001 or 1.0
        wide = {"loc": 0.0, "scale": 1.0} if inside else {"loc": least - room - lo * (most - least + 2 * room) / (hi - lo), "scale": (most - least + 2 * room) / (hi - lo)}
        start |= wide
        fixed = wide | fixed
    elif (math.isfinite(lo) or math.isfinite(hi)) and dist not in ("genextreme", "kappa4", "pearson3"):  # their ends move with the shape
        fixed = ({} if "loc" in guesses else {"loc": 0.0}) | fixed
    elif "loc" not in guesses:
        start["loc"] = mean
    start = {k: v for k, v in start.items() if k not in fixed}

    def density(param: dict[str, float], x: Column) -> Column:
        return MarginalNamed(dist, param).d(x)

    return MarginalNamed(dist, scoring(dist, df, x, density, start, fixed), sign)


def marg_gkde(data: Table, col: Any = None, sign: int = 0, points: int = 500, seed: int = 1) -> MarginalGKDE:
    """Kernels of Scott's width on all rows, or beyond ``points`` on so many even quantiles of them (to 1/100,000 of the
    rows in rank), each of equal weight. ``seed`` has no effect: nothing is drawn."""
    df = as_table(data).df
    x = F.col(f"`{named(col) if col is not None else df.columns[0]}`").cast("double").alias("x")
    known = df.select(x).where("x IS NOT NULL")
    n, sd = known.agg(F.count("x"), F.stddev_samp("x")).first()
    if n <= points:
        kept = [r.x for r in known.orderBy("x").collect()]
    else:
        kept = known.agg(F.percentile_approx("x", [(i + 0.5) / points for i in range(points)], 100_000)).first()[0]
    return MarginalGKDE(tuple(kept), float(sd) * n ** (-1 / 5), sign)
