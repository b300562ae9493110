"""Named laws in their standard forms (location 0, scale 1): support, density, distribution function, quantile.

Formulas take the functions they use from ``m``, so that they run on columns and on numbers. A law whose quantile has no closed form has
it by a table of its distribution function and Newton steps (functions/special.py). On columns, what goes in series, fractions or Newton
steps takes whole batches of numbers, each distinct value of a batch once; all else stays an expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymesh.functions.special import Numbers, beta_d, beta_p, beta_q, gamma_d, gamma_p, gamma_q, inverse, of

INF = math.inf
ROOT = math.sqrt(2 * math.pi)


def in_batches(f: Callable[[np.ndarray], Any], x: Column) -> Column:
    """``f`` of a column, by arrays of its distinct values."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        values, at = np.unique(x.to_numpy(float), return_inverse=True)
        return pd.Series(np.asarray(f(values), float)[at])

    return run(x)


@dataclass(frozen=True)
class Law:
    """``d``, ``p`` and ``q`` of (math, x, *shapes). ``ends``: the support, numbers or functions of the shapes. ``long``: p and q of columns go
    in batches."""

    shapes: tuple[str, ...]
    ends: tuple[Any, Any]
    density: Callable[..., Any]
    below: Callable[..., Any]
    level: Callable[..., Any] | None = None
    long: bool = False

    def support(self, *shapes: float) -> tuple[float, float]:
        return tuple(float(e(*shapes)) if callable(e) else float(e) for e in self.ends)  # type: ignore[return-value]

    def _held(self, x: Any, inner: Callable[[Any], Any], before: float, after: float, shapes: tuple[float, ...]) -> Any:
        """inner inside the support; the ends themselves count as outside unless both neighbours agree."""
        lo, hi = self.support(*shapes)
        if isinstance(x, Column):
            x = x.cast("double")
            out = inner(x)
            if lo > -INF or hi < INF:
                out = F.when(x <= lo, F.lit(before)).when(x >= hi, F.lit(after)).otherwise(out)
            return F.when(x.isNotNull(), out)
        x = np.asarray(x, float)
        inside = (x > lo) & (x < hi)
        safe = np.where(inside, x, (lo + hi) / 2 if math.isfinite(lo + hi) else lo + 1 if math.isfinite(lo) else hi - 1 if math.isfinite(hi) else 0.0)
        with np.errstate(all="ignore"):
            out = np.where(inside, inner(safe), np.where(np.isnan(x), np.nan, np.where(x <= lo, before, after)))
        return out if out.ndim else float(out)

    def d(self, x: Any, *shapes: float) -> Any:
        return self._held(x, lambda x: self.density(of(x), x, *shapes), 0.0, 0.0, shapes)

    def p(self, x: Any, *shapes: float) -> Any:
        def inner(x: Any) -> Any:
            return in_batches(lambda y: self.p(y, *shapes), x) if self.long and isinstance(x, Column) else self.below(of(x), x, *shapes)

        return self._held(x, inner, 0.0, 1.0, shapes)

    def q(self, u: Any, *shapes: float) -> Any:
        """The ends of the support at 0 and 1; missing (NaN) outside of them."""
        lo, hi = self.support(*shapes)

        def inner(u: Any) -> Any:
            return self.level(of(u), u, *shapes) if self.level else self._inverse(u, lo, hi, shapes)

        if isinstance(u, Column):
            u = u.cast("double")
            found = in_batches(lambda y: self.q(y, *shapes), u) if self.long or self.level is None else inner(u)
            return F.when(u == 0, F.lit(lo)).when(u == 1, F.lit(hi)).when((u > 0) & (u < 1), found)
        u = np.asarray(u, float)
        inside = (u > 0) & (u < 1)
        with np.errstate(all="ignore"):
            out = np.where(inside, inner(np.where(inside, u, 0.5)), np.where(u == 0, lo, np.where(u == 1, hi, np.nan)))
        return out if out.ndim else float(out)

    def _inverse(self, u: Any, lo: float, hi: float, shapes: tuple[float, ...]) -> Any:
        """The support is brought to (0, inf), (0, 1) or all numbers."""
        if math.isfinite(lo) and math.isfinite(hi):
            kind, w, sign, at = "logit", hi - lo, 1.0, lo
        elif math.isfinite(lo) or math.isfinite(hi):
            kind, w, sign, at = "log", 1.0, 1.0 if math.isfinite(lo) else -1.0, lo if math.isfinite(lo) else hi
        else:
            kind, w, sign, at = "wide", 1.0, 1.0, 0.0

        def p(y: Any) -> Any:
            value = self.p(at + sign * w * y, *shapes)
            return value if sign > 0 else 1 - value

        found = inverse(u if sign > 0 else 1 - u, p, lambda y: self.d(at + sign * w * y, *shapes) * w, kind, _key(self, shapes))
        return at + sign * w * found


@lru_cache(maxsize=256)
def _key(law: Law, shapes: tuple[float, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """One function for each law and shapes, so that its table is made once."""
    lo, hi = law.support(*shapes)
    if math.isfinite(lo) and math.isfinite(hi):
        return lambda y: law.p(lo + (hi - lo) * y, *shapes)
    if math.isfinite(lo):
        return lambda y: law.p(lo + y, *shapes)
    if math.isfinite(hi):
        return lambda y: 1 - law.p(hi - y, *shapes)
    return lambda y: law.p(y, *shapes)


def phi(m: Any, x: Any) -> Any:
    return m.exp(x * x * -0.5) / ROOT


def pnorm(m: Any, x: Any) -> Any:
    """With its argument computed once, as its formula has it many times."""
    return m.let(x, lambda x: m.pnorm(x))


def qnorm(m: Any, u: Any) -> Any:
    return m.let(u, lambda u: m.qnorm(u))


def _lb(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _mirrored(m: Any, u: Any, half: Callable[[Any], Any]) -> Any:
    """The quantile of a law that is even about 0; ``half`` takes the level of its absolute value."""
    return m.sign(u - 0.5) * half(m.abs(2 * u - 1))


def _t_p(m: Any, x: Any, df: float) -> Any:
    tail = beta_p(df / (df + x * x), df / 2, 0.5) / 2
    return m.where(x > 0, 1 - tail, tail)


def _t_q(m: Any, u: Any, df: float) -> Any:
    return m.let(m.least(u, 1 - u), lambda tail: m.sign(u - 0.5) * m.let(beta_q(2 * tail, df / 2, 0.5), lambda y: m.sqrt(df * (1 - y) / y)))


def _psi(m: Any, x: Any) -> Any:
    """P(3/2, x^2/2) / 2 for x > 0."""
    return gamma_p(x * x / 2, 1.5) / 2


def _kappa4(h: float, k: float) -> tuple[float, float]:
    lo = (1 - h**-k) / k if h > 0 and k != 0 else math.log(h) if h > 0 else 1 / k if k < 0 else -INF
    return lo, 1 / k if k > 0 else INF


def _kappa4_y(m: Any, x: Any, k: float) -> Any:
    return m.power(1 - k * x, 1 / k) if k else m.exp(-x)


def _kappa4_p(m: Any, x: Any, h: float, k: float) -> Any:
    y = _kappa4_y(m, x, k)
    return m.power(1 - h * y, 1 / h) if h else m.exp(-y)


def _kappa4_d(m: Any, x: Any, h: float, k: float) -> Any:
    slope = m.power(1 - k * x, 1 / k - 1) if k else m.exp(-x)
    return slope * m.power(_kappa4_p(m, x, h, k), 1 - h)


def _kappa4_q(m: Any, u: Any, h: float, k: float) -> Any:
    y = (1 - m.power(u, h)) / h if h else -m.log(u)
    return (1 - m.power(y, k)) / k if k else -m.log(y)


def _crystal(beta: float, n: float) -> tuple[float, float, float]:
    """(what makes the whole 1, the tail's factor, its distance)."""
    core = math.exp(-beta * beta / 2)
    return 1 / (n / beta / (n - 1) * core + ROOT * float(Numbers.pnorm(beta))), (n / beta) ** n * core, n / beta - beta


def _crystal_d(m: Any, x: Any, beta: float, n: float) -> Any:
    c, a, b = _crystal(beta, n)
    return m.where(x > -beta, c * m.exp(x * x * -0.5), c * a * m.power(m.greatest(b - x, 1e-300), -n))


def _crystal_p(m: Any, x: Any, beta: float, n: float) -> Any:
    c, a, b = _crystal(beta, n)
    return m.where(x > -beta, c * (n / beta * math.exp(-beta * beta / 2) / (n - 1) + ROOT * (pnorm(m, x) - float(Numbers.pnorm(-beta)))), c * a / (n - 1) * m.power(m.greatest(b - x, 1e-300), 1 - n))


def _kolmogorov(m: Any, x: Any, slope: bool) -> Any:
    """The limit law of Kolmogorov's statistic: one series for small x, one for large."""
    small, large = 0.0, 0.0 if slope else 1.0
    y = m.greatest(x, 0.04)
    for k in range(1, 9):
        c = (2 * k - 1) ** 2 * math.pi**2 / 8
        near = m.exp(-c / (y * y)) * ROOT / y
        small = small + (near * (2 * c / (y * y * y) - 1 / y) if slope else near)
        far = (-1) ** (k - 1) * m.exp(-2.0 * k * k * y * y)
        large = large + (8.0 * k * k * y * far if slope else -2 * far)
    return m.where(x < 0.04, 0.0, m.where(x < 1, small, large))


def _bessel(kappa: float) -> list[float]:
    """I_k(kappa) / I_0(kappa), k from 1 until it is below 1e-17."""
    n = int(30 + 2 * kappa)
    ratio, out = 0.0, [0.0] * (n + 2)
    for k in range(n + 1, 0, -1):
        ratio = kappa / (2 * k + kappa * ratio)
        out[k] = ratio
    return [float(x) for x in np.cumprod(out[1:]) if x > 1e-17]


def _bessel_0(kappa: float) -> float:
    t = np.linspace(0, np.pi, 2001)
    return float(np.trapezoid(np.exp(kappa * np.cos(t)), t) / np.pi)


def _mises_p(m: Any, x: Any, kappa: float) -> Any:
    return 0.5 + x / (2 * math.pi) + sum((m.sin(x * k) * (r / k / math.pi) for k, r in enumerate(_bessel(kappa), 1)), 0 * x)


def _pearson(skew: float) -> tuple[float, float, float]:
    rate = 2 / skew
    return rate * rate, rate, -rate


def _pearson_d(m: Any, x: Any, skew: float) -> Any:
    if not skew:
        return phi(m, x)
    a, rate, at = _pearson(skew)
    return gamma_d(rate * (x - at), a) * abs(rate)


def _pearson_p(m: Any, x: Any, skew: float) -> Any:
    if not skew:
        return pnorm(m, x)
    a, rate, at = _pearson(skew)
    p = gamma_p(rate * (x - at), a)
    return p if skew > 0 else 1 - p


def _pearson_q(m: Any, u: Any, skew: float) -> Any:
    if not skew:
        return qnorm(m, u)
    a, rate, at = _pearson(skew)
    return at + gamma_q(u if skew > 0 else 1 - u, a) / rate


def _gen_gamma_p(m: Any, x: Any, a: float, c: float) -> Any:
    p = gamma_p(m.power(x, c), a)
    return p if c > 0 else 1 - p


def _gev_ends(c: float) -> tuple[float, float]:
    return (-INF, 1 / c) if c > 0 else (1 / c, INF) if c < 0 else (-INF, INF)


def _gev_y(m: Any, x: Any, c: float) -> Any:
    return m.power(1 - c * x, 1 / c) if c else m.exp(-x)


def _wrapped_p(m: Any, x: Any, c: float) -> Any:
    val = (1 + c) / (1 - c)
    return m.where(x < math.pi, m.atan(val * m.tan(m.least(x, math.pi) / 2)) / math.pi, 1 - m.atan(val * m.tan((2 * math.pi - m.greatest(x, math.pi)) / 2)) / math.pi)


def _wrapped_q(m: Any, u: Any, c: float) -> Any:
    val = (1 + c) / (1 - c)
    return m.where(u < 0.5, 2 * m.atan(m.tan(math.pi * m.least(u, 0.5)) / val), 2 * math.pi - 2 * m.atan(m.tan(math.pi * (1 - m.greatest(u, 0.5))) / val))


def _trapez_d(m: Any, x: Any, c: float, d: float) -> Any:
    u = 2 / (d - c + 1)
    return m.where(x < c, u * x / (c or 1), m.where(x <= d, u, u * (1 - x) / ((1 - d) or 1)))


def _trapez_p(m: Any, x: Any, c: float, d: float) -> Any:
    u = 2 / (d - c + 1)
    return m.where(x < c, u * x * x / (2 * (c or 1)), m.where(x <= d, u * (x - c / 2), 1 - u * (1 - x) * (1 - x) / (2 * ((1 - d) or 1))))


def _trapez_q(m: Any, v: Any, c: float, d: float) -> Any:
    u = 2 / (d - c + 1)
    return m.where(v < u * c / 2, m.sqrt(2 * c * v / u), m.where(v <= u * (d - c / 2), v / u + c / 2, 1 - m.sqrt(m.greatest(2 * (1 - d) * (1 - v) / u, 0.0))))


def _inv_gauss_p(m: Any, x: Any, mu: float) -> Any:
    r = m.sqrt(x)
    return pnorm(m, (x / mu - 1) / r) + math.exp(2 / mu) * pnorm(m, (x / mu + 1) / r * -1)


def _inv_gauss_d(m: Any, x: Any, mu: float) -> Any:
    return m.exp((x - mu) * (x - mu) / (x * (-2 * mu * mu))) / (m.sqrt(x) * x * ROOT)


def _gen_exp(m: Any, x: Any, a: float, b: float, c: float) -> Any:
    return m.exp((1 - m.exp(x * -c)) * (b / c) - x * (a + b))


_GAMMA = Law(("a",), (0, INF), lambda m, x, a: gamma_d(x, a), lambda m, x, a: gamma_p(x, a), lambda m, u, a: gamma_q(u, a))
_WALD = (lambda m, x: _inv_gauss_d(m, x, 1.0), lambda m, x: _inv_gauss_p(m, x, 1.0))
_MISES = Law(("kappa",), (-math.pi, math.pi), lambda m, x, k: m.exp(k * m.cos(x)) / (2 * math.pi * _bessel_0(k)), _mises_p)

MORE_LAWS: dict[str, Law] = {
    "alpha": Law(("a",), (0, INF), lambda m, x, a: phi(m, a - 1 / x) / (x * x * float(Numbers.pnorm(a))), lambda m, x, a: pnorm(m, a - 1 / x) / float(Numbers.pnorm(a)), lambda m, u, a: 1 / (a - qnorm(m, u * float(Numbers.pnorm(a))))),
    "anglit": Law((), (-math.pi / 4, math.pi / 4), lambda m, x: m.cos(2 * x), lambda m, x: m.power(m.sin(x + math.pi / 4), 2), lambda m, u: m.asin(m.sqrt(u)) - math.pi / 4),
    "arcsine": Law((), (0, 1), lambda m, x: 1 / (math.pi * m.sqrt(x * (1 - x))), lambda m, x: 2 / math.pi * m.asin(m.sqrt(x)), lambda m, u: m.power(m.sin(math.pi / 2 * u), 2)),
    "argus": Law(("chi",), (0, 1), lambda m, x, c: c**3 / (ROOT * float(_psi(Numbers, c))) * x * m.sqrt(1 - x * x) * m.exp((1 - x * x) * (-c * c / 2)), lambda m, x, c: 1 - _psi(m, c * m.sqrt(1 - x * x)) / float(_psi(Numbers, c))),
    "beta": Law(("a", "b"), (0, 1), lambda m, x, a, b: beta_d(x, a, b), lambda m, x, a, b: beta_p(x, a, b), lambda m, u, a, b: beta_q(u, a, b)),
    "betaprime": Law(("a", "b"), (0, INF), lambda m, x, a, b: m.exp((a - 1) * m.log(x) - (a + b) * m.log1p(x) - _lb(a, b)), lambda m, x, a, b: beta_p(x / (1 + x), a, b), lambda m, u, a, b: m.let(beta_q(u, a, b), lambda y: y / (1 - y))),
    "bradford": Law(("c",), (0, 1), lambda m, x, c: c / (math.log1p(c) * (1 + c * x)), lambda m, x, c: m.log1p(c * x) / math.log1p(c), lambda m, u, c: m.expm1(u * math.log1p(c)) / c),
    "burr": Law(("c", "d"), (0, INF), lambda m, x, c, d: c * d * m.power(x, -c - 1) * m.power(1 + m.power(x, -c), -d - 1), lambda m, x, c, d: m.power(1 + m.power(x, -c), -d), lambda m, u, c, d: m.power(m.power(u, -1 / d) - 1, -1 / c)),
    "burr12": Law(("c", "d"), (0, INF), lambda m, x, c, d: c * d * m.power(x, c - 1) * m.power(1 + m.power(x, c), -d - 1), lambda m, x, c, d: 1 - m.power(1 + m.power(x, c), -d), lambda m, u, c, d: m.power(m.expm1(m.log1p(-u) / -d), 1 / c)),
    "chi": Law(("df",), (0, INF), lambda m, x, k: gamma_d(x * x / 2, k / 2) * x, lambda m, x, k: gamma_p(x * x / 2, k / 2), lambda m, u, k: m.sqrt(2 * gamma_q(u, k / 2))),
    "chi2": Law(("df",), (0, INF), lambda m, x, k: gamma_d(x / 2, k / 2) / 2, lambda m, x, k: gamma_p(x / 2, k / 2), lambda m, u, k: 2 * gamma_q(u, k / 2)),
    "cosine": Law((), (-math.pi, math.pi), lambda m, x: (1 + m.cos(x)) / (2 * math.pi), lambda m, x: (math.pi + x + m.sin(x)) / (2 * math.pi)),
    "crystalball": Law(("beta", "m"), (-INF, INF), _crystal_d, _crystal_p),
    "dgamma": Law(("a",), (-INF, INF), lambda m, x, a: gamma_d(m.greatest(m.abs(x), 1e-300), a) / 2, lambda m, x, a: 0.5 + m.sign(x) * gamma_p(m.abs(x), a) / 2, lambda m, u, a: _mirrored(m, u, lambda v: gamma_q(v, a))),
    "dweibull": Law(("c",), (-INF, INF), lambda m, x, c: c / 2 * m.power(m.abs(x), c - 1) * m.exp(-m.power(m.abs(x), c)), lambda m, x, c: 0.5 - m.sign(x) * m.expm1(-m.power(m.abs(x), c)) / 2, lambda m, u, c: _mirrored(m, u, lambda v: m.power(-m.log1p(-v), 1 / c))),
    "erlang": _GAMMA,
    "exponnorm": Law(("K",), (-INF, INF), lambda m, x, k: m.exp(1 / (2 * k * k) - x / k) * pnorm(m, x - 1 / k) / k, lambda m, x, k: pnorm(m, x) - m.exp(1 / (2 * k * k) - x / k) * pnorm(m, x - 1 / k)),
    "exponweib": Law(("a", "c"), (0, INF), lambda m, x, a, c: a * c * m.power(-m.expm1(-m.power(x, c)), a - 1) * m.exp(-m.power(x, c)) * m.power(x, c - 1), lambda m, x, a, c: m.power(-m.expm1(-m.power(x, c)), a), lambda m, u, a, c: m.power(-m.log1p(-m.power(u, 1 / a)), 1 / c)),
    "exponpow": Law(("b",), (0, INF), lambda m, x, b: b * m.power(x, b - 1) * m.exp(1 + m.power(x, b) - m.exp(m.power(x, b))), lambda m, x, b: -m.expm1(-m.expm1(m.power(x, b))), lambda m, u, b: m.power(m.log1p(-m.log1p(-u)), 1 / b)),
    "f": Law(("dfn", "dfd"), (0, INF), lambda m, x, n, d: m.exp((n / 2 - 1) * m.log(x) - (n + d) / 2 * m.log1p(n / d * x) + n / 2 * math.log(n / d) - _lb(n / 2, d / 2)), lambda m, x, n, d: beta_p(n * x / (n * x + d), n / 2, d / 2), lambda m, u, n, d: m.let(beta_q(u, n / 2, d / 2), lambda y: d * y / (n * (1 - y)))),
    "fatiguelife": Law(("c",), (0, INF), lambda m, x, c: (x + 1) / (2 * c * x * m.sqrt(x)) * phi(m, (m.sqrt(x) - 1 / m.sqrt(x)) / c), lambda m, x, c: pnorm(m, (m.sqrt(x) - 1 / m.sqrt(x)) / c), lambda m, u, c: m.let(c * qnorm(m, u), lambda z: m.power(z + m.sqrt(z * z + 4), 2) / 4)),
    "fisk": Law(("c",), (0, INF), lambda m, x, c: c * m.power(x, -c - 1) * m.power(1 + m.power(x, -c), -2), lambda m, x, c: 1 / (1 + m.power(x, -c)), lambda m, u, c: m.power(1 / u - 1, -1 / c)),
    "foldcauchy": Law(("c",), (0, INF), lambda m, x, c: (1 / (1 + (x - c) * (x - c)) + 1 / (1 + (x + c) * (x + c))) / math.pi, lambda m, x, c: (m.atan(x - c) + m.atan(x + c)) / math.pi),
    "foldnorm": Law(("c",), (0, INF), lambda m, x, c: phi(m, x - c) + phi(m, x + c), lambda m, x, c: pnorm(m, x - c) - pnorm(m, x * -1 - c)),
    "genlogistic": Law(("c",), (-INF, INF), lambda m, x, c: c * m.exp(-x) * m.power(1 + m.exp(-x), -c - 1), lambda m, x, c: m.power(1 + m.exp(-x), -c), lambda m, u, c: -m.log(m.expm1(-m.log(u) / c))),
    "gennorm": Law(("beta",), (-INF, INF), lambda m, x, b: b / 2 * m.exp(-m.power(m.abs(x), b) - math.lgamma(1 / b)), lambda m, x, b: 0.5 + m.sign(x) * gamma_p(m.power(m.abs(x), b), 1 / b) / 2, lambda m, u, b: _mirrored(m, u, lambda v: m.power(gamma_q(v, 1 / b), 1 / b))),
    "genpareto": Law(("c",), (0, lambda c: -1 / c if c < 0 else INF), lambda m, x, c: m.power(1 + c * x, -1 - 1 / c) if c else m.exp(-x), lambda m, x, c: 1 - m.power(1 + c * x, -1 / c) if c else -m.expm1(-x), lambda m, u, c: m.expm1(m.log1p(-u) * -c) / c if c else -m.log1p(-u)),
    "genexpon": Law(("a", "b", "c"), (0, INF), lambda m, x, a, b, c: (a + b * (1 - m.exp(x * -c))) * _gen_exp(m, x, a, b, c), lambda m, x, a, b, c: 1 - _gen_exp(m, x, a, b, c)),
    "genextreme": Law(("c",), (lambda c: _gev_ends(c)[0], lambda c: _gev_ends(c)[1]), lambda m, x, c: m.exp(-_gev_y(m, x, c)) * m.power(_gev_y(m, x, c), 1 - c), lambda m, x, c: m.exp(-_gev_y(m, x, c)), lambda m, u, c: (1 - m.power(-m.log(u), c)) / c if c else -m.log(-m.log(u))),
    "gamma": _GAMMA,
    "gengamma": Law(("a", "c"), (0, INF), lambda m, x, a, c: abs(c) * m.exp((c * a - 1) * m.log(x) - m.power(x, c) - math.lgamma(a)), _gen_gamma_p, lambda m, u, a, c: m.power(gamma_q(u if c > 0 else 1 - u, a), 1 / c)),
    "genhalflogistic": Law(("c",), (0, lambda c: 1 / c), lambda m, x, c: 2 * m.power(1 - c * x, 1 / c - 1) / m.power(1 + m.power(1 - c * x, 1 / c), 2), lambda m, x, c: (1 - m.power(1 - c * x, 1 / c)) / (1 + m.power(1 - c * x, 1 / c)), lambda m, u, c: (1 - m.power((1 - u) / (1 + u), c)) / c),
    "gibrat": Law((), (0, INF), lambda m, x: phi(m, m.log(x)) / x, lambda m, x: pnorm(m, m.log(x)), lambda m, u: m.exp(qnorm(m, u))),
    "gompertz": Law(("c",), (0, INF), lambda m, x, c: c * m.exp(x - c * m.expm1(x)), lambda m, x, c: -m.expm1(-c * m.expm1(x)), lambda m, u, c: m.log1p(m.log1p(-u) / -c)),
    "halfcauchy": Law((), (0, INF), lambda m, x: 2 / (math.pi * (1 + x * x)), lambda m, x: 2 / math.pi * m.atan(x), lambda m, u: m.tan(math.pi / 2 * u)),
    "halflogistic": Law((), (0, INF), lambda m, x: 2 * m.exp(-x) / m.power(1 + m.exp(-x), 2), lambda m, x: m.tanh(x / 2), lambda m, u: m.log((1 + u) / (1 - u))),
    "halfnorm": Law((), (0, INF), lambda m, x: 2 * phi(m, x), lambda m, x: 2 * pnorm(m, x) - 1, lambda m, u: qnorm(m, (1 + u) / 2)),
    "halfgennorm": Law(("beta",), (0, INF), lambda m, x, b: b * m.exp(-m.power(x, b) - math.lgamma(1 / b)), lambda m, x, b: gamma_p(m.power(x, b), 1 / b), lambda m, u, b: m.power(gamma_q(u, 1 / b), 1 / b)),
    "hypsecant": Law((), (-INF, INF), lambda m, x: 2 / math.pi * m.exp(-m.abs(x)) / (1 + m.exp(-2 * m.abs(x))), lambda m, x: 2 / math.pi * m.atan(m.exp(x)), lambda m, u: m.log(m.tan(math.pi / 2 * u))),
    "invgamma": Law(("a",), (0, INF), lambda m, x, a: m.exp(-(a + 1) * m.log(x) - 1 / x - math.lgamma(a)), lambda m, x, a: 1 - gamma_p(1 / x, a), lambda m, u, a: 1 / gamma_q(1 - u, a)),
    "invgauss": Law(("mu",), (0, INF), _inv_gauss_d, _inv_gauss_p),
    "invweibull": Law(("c",), (0, INF), lambda m, x, c: c * m.power(x, -c - 1) * m.exp(-m.power(x, -c)), lambda m, x, c: m.exp(-m.power(x, -c)), lambda m, u, c: m.power(-m.log(u), -1 / c)),
    "johnsonsb": Law(("a", "b"), (0, 1), lambda m, x, a, b: b / (x * (1 - x)) * phi(m, a + b * m.log(x / (1 - x))), lambda m, x, a, b: pnorm(m, a + b * m.log(x / (1 - x))), lambda m, u, a, b: 1 / (1 + m.exp((a - qnorm(m, u)) / b))),
    "johnsonsu": Law(("a", "b"), (-INF, INF), lambda m, x, a, b: b / m.sqrt(x * x + 1) * phi(m, a + b * m.asinh(x)), lambda m, x, a, b: pnorm(m, a + b * m.asinh(x)), lambda m, u, a, b: m.sinh((qnorm(m, u) - a) / b)),
    "kappa4": Law(("h", "k"), (lambda h, k: _kappa4(h, k)[0], lambda h, k: _kappa4(h, k)[1]), _kappa4_d, _kappa4_p, _kappa4_q),
    "kappa3": Law(("a",), (0, INF), lambda m, x, a: a * m.power(a + m.power(x, a), -(a + 1) / a), lambda m, x, a: x * m.power(a + m.power(x, a), -1 / a), lambda m, u, a: m.power(a / (m.power(u, -a) - 1), 1 / a)),
    "kstwobign": Law((), (0, INF), lambda m, x: _kolmogorov(m, x, True), lambda m, x: _kolmogorov(m, x, False)),
    "levy": Law((), (0, INF), lambda m, x: m.exp(-0.5 / x) / (ROOT * x * m.sqrt(x)), lambda m, x: 2 * pnorm(m, -1 / m.sqrt(x)), lambda m, u: 1 / m.power(qnorm(m, u / 2), 2)),
    "levy_l": Law((), (-INF, 0), lambda m, x: m.exp(0.5 / x) / (ROOT * m.abs(x) * m.sqrt(m.abs(x))), lambda m, x: 1 - 2 * pnorm(m, -1 / m.sqrt(m.abs(x))), lambda m, u: -1 / m.power(qnorm(m, (1 - u) / 2), 2)),
    "loggamma": Law(("c",), (-INF, INF), lambda m, x, c: m.exp(c * x - m.exp(x) - math.lgamma(c)), lambda m, x, c: gamma_p(m.exp(x), c), lambda m, u, c: m.log(gamma_q(u, c))),
    "loglaplace": Law(("c",), (0, INF), lambda m, x, c: c / 2 * m.where(x < 1, m.power(x, c - 1), m.power(x, -c - 1)), lambda m, x, c: m.where(x < 1, m.power(x, c) / 2, 1 - m.power(x, -c) / 2), lambda m, u, c: m.where(u < 0.5, m.power(2 * u, 1 / c), m.power(2 - 2 * u, -1 / c))),
    "lomax": Law(("c",), (0, INF), lambda m, x, c: c * m.power(1 + x, -c - 1), lambda m, x, c: 1 - m.power(1 + x, -c), lambda m, u, c: m.expm1(m.log1p(-u) / -c)),
    "maxwell": Law((), (0, INF), lambda m, x: 2 * x * x * phi(m, x), lambda m, x: gamma_p(x * x / 2, 1.5), lambda m, u: m.sqrt(2 * gamma_q(u, 1.5))),
    "mielke": Law(("k", "s"), (0, INF), lambda m, x, k, s: k * m.power(x, k - 1) * m.power(1 + m.power(x, s), -1 - k / s), lambda m, x, k, s: m.power(x, k) * m.power(1 + m.power(x, s), -k / s), lambda m, u, k, s: m.let(m.power(u, s / k), lambda y: m.power(y / (1 - y), 1 / s))),
    "moyal": Law((), (-INF, INF), lambda m, x: m.exp((x + m.exp(-x)) / -2) / ROOT, lambda m, x: 2 * pnorm(m, -m.exp(x / -2)), lambda m, u: -2 * m.log(-qnorm(m, u / 2))),
    "nakagami": Law(("nu",), (0, INF), lambda m, x, v: gamma_d(v * x * x, v) * 2 * v * x, lambda m, x, v: gamma_p(v * x * x, v), lambda m, u, v: m.sqrt(gamma_q(u, v) / v)),
    "pearson3": Law(("skew",), (lambda s: -2 / s if s > 0 else -INF, lambda s: -2 / s if s < 0 else INF), _pearson_d, _pearson_p, _pearson_q),
    "powerlognorm": Law(("c", "s"), (0, INF), lambda m, x, c, s: c / (x * s) * phi(m, m.log(x) / s) * m.power(pnorm(m, m.log(x) / -s), c - 1), lambda m, x, c, s: 1 - m.power(pnorm(m, m.log(x) / -s), c), lambda m, u, c, s: m.exp(qnorm(m, m.power(1 - u, 1 / c)) * -s)),
    "powernorm": Law(("c",), (-INF, INF), lambda m, x, c: c * phi(m, x) * m.power(pnorm(m, -x), c - 1), lambda m, x, c: 1 - m.power(pnorm(m, -x), c), lambda m, u, c: -qnorm(m, m.power(1 - u, 1 / c))),
    "rdist": Law(("c",), (-1, 1), lambda m, x, c: beta_d((x + 1) / 2, c / 2, c / 2) / 2, lambda m, x, c: beta_p((x + 1) / 2, c / 2, c / 2), lambda m, u, c: 2 * beta_q(u, c / 2, c / 2) - 1),
    "recipinvgauss": Law(("mu",), (0, INF), lambda m, x, mu: m.exp((1 - mu * x) * (1 - mu * x) / (x * (-2 * mu * mu))) / (ROOT * m.sqrt(x)), lambda m, x, mu: pnorm(m, (x - 1 / mu) / m.sqrt(x)) - math.exp(2 / mu) * pnorm(m, (x + 1 / mu) / m.sqrt(x) * -1)),
    "t": Law(("df",), (-INF, INF), lambda m, x, v: m.exp(m.log1p(x * x / v) * (-(v + 1) / 2) - _lb(v / 2, 0.5)) / math.sqrt(v), _t_p, _t_q),
    "trapz": Law(("c", "d"), (0, 1), _trapez_d, _trapez_p, _trapez_q),
    "truncexpon": Law(("b",), (0, lambda b: b), lambda m, x, b: m.exp(-x) / -math.expm1(-b), lambda m, x, b: m.expm1(-x) / math.expm1(-b), lambda m, u, b: -m.log1p(u * math.expm1(-b))),
    "truncnorm": Law(("a", "b"), (lambda a, b: a, lambda a, b: b), lambda m, x, a, b: phi(m, x) / float(Numbers.pnorm(b) - Numbers.pnorm(a)), lambda m, x, a, b: (pnorm(m, x) - float(Numbers.pnorm(a))) / float(Numbers.pnorm(b) - Numbers.pnorm(a)), lambda m, u, a, b: qnorm(m, u * float(Numbers.pnorm(b) - Numbers.pnorm(a)) + float(Numbers.pnorm(a)))),
    "vonmises": _MISES,
    "vonmises_line": _MISES,
    "wald": Law((), (0, INF), *_WALD),
    "weibull_max": Law(("c",), (-INF, 0), lambda m, x, c: c * m.power(-x, c - 1) * m.exp(-m.power(-x, c)), lambda m, x, c: m.exp(-m.power(-x, c)), lambda m, u, c: -m.power(-m.log(u), 1 / c)),
    "wrapcauchy": Law(("c",), (0, 2 * math.pi), lambda m, x, c: (1 - c * c) / (2 * math.pi * (1 + c * c - 2 * c * m.cos(x))), _wrapped_p, _wrapped_q),
}
#: Laws on incomplete gamma and beta functions.
LONG = (
    "argus", "beta", "betaprime", "chi", "chi2", "dgamma", "erlang", "f", "gamma", "gengamma", "gennorm", "halfgennorm", "invgamma", "loggamma", "maxwell", "nakagami", "pearson3", "rdist", "t",
)
MORE_LAWS |= {name: replace(MORE_LAWS[name], long=True) for name in LONG}
