"""Incomplete gamma and beta functions and their inverses, on Spark columns and on plain numbers.

Shapes are plain numbers, so their constants are taken once. On columns, series and continued fractions run to a number of terms that
the shapes give; inverses are read from a table over even steps of log odds and mended by Newton steps held inside the table's cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymesh.functions import scalar as S

_NORMAL = NormalDist()
#: Log odds of the first and last knot of an inverse's table, and its cells; beyond the ends the last cell is carried on.
ENDS, KNOTS = 36.0, 288
NEWTON = 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


class Numbers:
    """The functions that formulas use, on numbers and arrays."""

    exp, log, sqrt, abs, tan, atan, sin, cos, asin, sinh, tanh = np.exp, np.log, np.sqrt, np.abs, np.tan, np.arctan, np.sin, np.cos, np.arcsin, np.sinh, np.tanh
    asinh, log1p, expm1, sign, least, greatest = np.arcsinh, np.log1p, np.expm1, np.sign, np.minimum, np.maximum
    pnorm = staticmethod(np.vectorize(_NORMAL.cdf, otypes=[float]))
    qnorm = staticmethod(np.vectorize(lambda p: _NORMAL.inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5), otypes=[float]))

    @staticmethod
    def where(c: Any, a: Any, b: Any) -> Any:
        return np.where(c, a, b)

    @staticmethod
    def power(a: Any, b: Any) -> Any:
        return np.power(a, b)

    @staticmethod
    def let(value: Any, use: Callable[[Any], Any]) -> Any:
        return use(value)

    @staticmethod
    def sum_of(first: float, step: Callable[[Any, int], Any], terms: int) -> Any:
        """first * (1 + r1 + r1 r2 + ...), r = step(k)."""
        term = total = first
        for k in range(1, terms + 1):
            term = term * step(k)
            total = total + term
        return total

    @staticmethod
    def backward(deepest: Any, step: Callable[[Any, int], Any], terms: int) -> Any:
        """step applied from ``terms`` down to 1."""
        out = deepest
        for k in range(terms, 0, -1):
            out = step(out, k)
        return out


class Columns:
    """The same on Spark columns."""

    exp, log, sqrt, abs, tan, atan, sin, cos, asin, sinh, tanh = F.exp, F.ln, F.sqrt, F.abs, F.tan, F.atan, F.sin, F.cos, F.asin, F.sinh, F.tanh
    asinh, log1p, expm1, sign = F.asinh, F.log1p, F.expm1, F.signum
    pnorm, qnorm = staticmethod(S.pnorm), staticmethod(S.qnorm)
    let = staticmethod(let)

    @staticmethod
    def least(a: Any, b: Any) -> Column:
        return F.least(S.as_column(a), S.as_column(b))

    @staticmethod
    def greatest(a: Any, b: Any) -> Column:
        return F.greatest(S.as_column(a), S.as_column(b))

    @staticmethod
    def where(c: Column, a: Any, b: Any) -> Column:
        return F.when(c, a).otherwise(b)

    @staticmethod
    def power(a: Any, b: Any) -> Column:
        return F.pow(a, b)

    @staticmethod
    def sum_of(first: float, step: Callable[[Column], Column], terms: int) -> Column:
        start = F.struct(F.lit(first).alias("t"), F.lit(first).alias("s"))

        def more(a: Column, k: Column) -> Column:
            return let(a["t"] * step(k), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, more, lambda a: a["s"])

    @staticmethod
    def backward(deepest: Column, step: Callable[[Column, Column], Column], terms: int) -> Column:
        return F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), deepest, step)


def of(x: Any) -> Any:
    return Columns if isinstance(x, Column) else Numbers


def _terms(shape: float) -> int:
    return int(50 + 10 * math.sqrt(shape + 1))


def gamma_p(x: Any, a: float) -> Any:
    """Regularised lower incomplete gamma function of x >= 0."""
    m, head = of(x), math.lgamma(a)
    below = m is Numbers

    def front(x: Any) -> Any:
        return m.exp(a * m.log(x) - x - head)

    def series(x: Any) -> Any:
        return front(x) * m.sum_of(1.0 / a, lambda k: x / (a + k), _terms(a))

    def fraction(x: Any) -> Any:
        # x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / (x + 5 - a - ...))
        n = 2 * _terms(a)
        return 1 - front(x) / m.backward(x + (2 * n + 1 - a), lambda rest, k: x + (2 * k - 1 - a) - k * (k - a) / rest, n)

    if below:
        x = np.asarray(x, float)
        lo, hi = np.clip(x, 1e-300, a + 1), np.clip(x, a + 1, 1e300)
        with np.errstate(all="ignore"):
            out = np.where(x < a + 1, series(lo), fraction(hi))
        return np.where(x <= 0, 0.0, np.where(x > a + 1 + 800 + 40 * math.sqrt(a), 1.0, out))
    return F.when(x <= 0, F.lit(0.0)).when(x < a + 1, series(x)).when(x > a + 801 + 40 * math.sqrt(a), F.lit(1.0)).otherwise(fraction(x))


def beta_p(x: Any, a: float, b: float) -> Any:
    """Regularised incomplete beta function of x from 0 to 1."""
    m = of(x)
    head = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def side(x: Any, a: float, b: float) -> Any:
        n = _terms(max(a, b))

        def pair(rest: Any, k: Any) -> Any:
            # 1 + d(2k-1) / (1 + d(2k) / rest), the two coefficients of round k
            odd = -(a + k - 1) * (a + b + k - 1) * x / ((a + 2 * k - 2) * (a + 2 * k - 1))
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            return 1 + odd / (1 + even / rest)

        return m.exp(a * m.log(x) + b * m.log1p(-x) + head) / a / m.backward(1 + 0 * x, pair, n)

    cut = (a + 1) / (a + b + 2)
    if m is Numbers:
        x = np.asarray(x, float)
        lo, hi = np.clip(x, 1e-300, cut), np.clip(x, cut, 1 - 1e-16)
        with np.errstate(all="ignore"):
            out = np.where(x < cut, side(lo, a, b), 1 - side(1 - hi, b, a))
        return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < cut, side(x, a, b)).otherwise(1 - side(1 - x, b, a))


@lru_cache(maxsize=256)
def _knots(p: Callable[[np.ndarray], np.ndarray], scale: str) -> np.ndarray:
    """Inner values z at even log odds, so that p(x(z)) has them; by bisection on the driver, all knots at once.

    ``scale``: how x is told: ``log`` (x > 0), ``logit`` (0 < x < 1) or ``wide`` (any; x = sinh z).
    """
    u = 1 / (1 + np.exp(-np.linspace(-ENDS, ENDS, KNOTS + 1)))
    lo, hi = np.full(len(u), -700.0), np.full(len(u), 700.0)
    with np.errstate(all="ignore"):
        for _ in range(100):
            z = (lo + hi) / 2
            less = np.nan_to_num(p(_outer(Numbers, z, scale)), nan=0.0) < u
            lo, hi = np.where(less, z, lo), np.where(less, hi, z)
    return (lo + hi) / 2


def _outer(m: Any, z: Any, scale: str) -> Any:
    return m.exp(z) if scale == "log" else 1 / (1 + m.exp(-z)) if scale == "logit" else m.sinh(z)


def inverse(u: Any, p: Callable[[Any], Any], d: Callable[[Any], Any], scale: str, key: Callable[[np.ndarray], np.ndarray] | None = None) -> Any:
    """The x with p(x) = u, where d is p's slope: a table's cell, then Newton steps that stay in it. 0 and 1 give the ends."""
    m = of(u)
    knots = _knots(key or p, scale)
    h = 2 * ENDS / KNOTS
    low, top = {"log": (0.0, math.inf), "logit": (0.0, 1.0), "wide": (-math.inf, math.inf)}[scale]

    def slope(z: Any, x: Any) -> Any:
        """dx/dz."""
        return x if scale == "log" else x * (1 - x) if scale == "logit" else m.sqrt(1 + x * x)

    if m is Numbers:
        u = np.asarray(u, float)
        inner = np.clip(u, 1e-300, 1 - 1e-16)
        with np.errstate(all="ignore"):
            at = (np.log(inner) - np.log1p(-inner) + ENDS) / h
            cell = np.clip(np.floor(at), 0, KNOTS - 1).astype(int)
            z = knots[cell] + (at - cell) * (knots[cell + 1] - knots[cell])
            lo, hi = np.where(at < 0, -np.inf, knots[cell]), np.where(at > KNOTS, np.inf, knots[cell + 1])
            for _ in range(NEWTON + 3):
                x = _outer(m, z, scale)
                step = (p(x) - inner) / (d(x) * slope(z, x))
                z = np.clip(np.where(np.isfinite(step), z - step, z), lo, hi)
            x = _outer(m, z, scale)
        return np.where(u <= 0, low, np.where(u >= 1, top, x))
    table = F.array(*(F.lit(float(z)) for z in knots))

    def found(at: Column) -> Column:
        cell = F.greatest(F.least(F.floor(at), F.lit(KNOTS - 1)), F.lit(0)).cast("int")
        start = let(cell, lambda c: F.struct((at - c).alias("w"), F.element_at(table, c + 1).alias("lo"), F.element_at(table, c + 2).alias("hi")))

        def step(z: Column, ends: Column) -> Column:
            def newton(x: Column) -> Column:
                move = F.try_divide(p(x) - u, d(x) * slope(z, x))
                return F.when(move.isNull() | F.isnan(move), z).otherwise(z - move)

            inside = let(_outer(m, z, scale), newton)
            # beyond the table's ends there is no cell to stay in
            return F.when((at < 0) | (at > KNOTS), inside).otherwise(F.greatest(F.least(inside, ends["hi"]), ends["lo"]))

        def steps(ends: Column) -> Column:
            z = ends["lo"] + ends["w"] * (ends["hi"] - ends["lo"])
            return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), z, lambda z, _: step(z, ends))

        return let(start, steps)

    x = _outer(m, let((F.ln(u) - F.log1p(-u) + ENDS) / h, found), scale)
    return F.when(u <= 0, F.lit(low)).when(u >= 1, F.lit(top)).when(u.isNotNull(), x)


@lru_cache(maxsize=256)
def _gamma_key(a: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: gamma_p(x, a)


@lru_cache(maxsize=256)
def _beta_key(a: float, b: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: beta_p(x, a, b)


def gamma_d(x: Any, a: float) -> Any:
    """Its slope, for x > 0."""
    m = of(x)
    return m.exp((a - 1) * m.log(x) - x - math.lgamma(a))


def beta_d(x: Any, a: float, b: float) -> Any:
    m = of(x)
    return m.exp((a - 1) * m.log(x) + (b - 1) * m.log1p(-x) + (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)))


def gamma_q(u: Any, a: float) -> Any:
    return inverse(u, lambda x: gamma_p(x, a), lambda x: gamma_d(x, a), "log", _gamma_key(a))


def beta_q(u: Any, a: float, b: float) -> Any:
    return inverse(u, lambda x: beta_p(x, a, b), lambda x: beta_d(x, a, b), "logit", _beta_key(a, b))
