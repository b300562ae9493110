"""Every law: density against the slope of its distribution function, quantiles against it, columns against numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidymesh.functions.special import beta_p, beta_q, gamma_p, gamma_q
from tidymesh.models.laws import MORE_LAWS
from tidymesh.models.marginals import LAWS, MarginalNamed

SHAPES = {
    "alpha": (2.5,), "argus": (1.3,), "beta": (2.3, 0.7), "betaprime": (3.0, 4.0), "bradford": (2.0,), "burr": (3.0, 1.5), "burr12": (2.0, 3.0), "chi": (3.0,), "chi2": (4.5,), "crystalball": (1.2, 3.0),
    "dgamma": (1.7,), "dweibull": (2.2,), "erlang": (3.0,), "exponnorm": (1.5,), "exponweib": (2.0, 1.4), "exponpow": (1.6,), "f": (5.0, 7.0), "fatiguelife": (0.9,), "fisk": (3.0,), "foldcauchy": (2.0,),
    "foldnorm": (1.2,), "genlogistic": (1.8,), "gennorm": (1.5,), "genpareto": (0.4,), "genexpon": (1.0, 2.0, 3.0), "genextreme": (-0.2,), "gamma": (2.4,), "gengamma": (1.5, 2.0), "genhalflogistic": (0.7,),
    "gompertz": (0.8,), "halfgennorm": (0.9,), "invgamma": (3.5,), "invgauss": (0.8,), "invweibull": (2.5,), "johnsonsb": (0.5, 1.2), "johnsonsu": (-0.4, 1.5), "kappa4": (0.2, 0.3), "kappa3": (2.0,),
    "loggamma": (2.0,), "loglaplace": (2.5,), "lomax": (2.5,), "mielke": (3.0, 4.0), "nakagami": (1.8,), "pearson3": (0.7,), "powerlognorm": (2.0, 0.6), "powernorm": (3.0,), "rdist": (3.0,), "recipinvgauss": (0.7,),
    "t": (4.0,), "trapz": (0.2, 0.7), "truncexpon": (3.0,), "truncnorm": (-1.0, 2.0), "vonmises": (1.4,), "vonmises_line": (2.5,), "weibull_max": (2.0,), "wrapcauchy": (0.4,), "lognorm": (0.5,), "weibull_min": (1.7,),
    "pareto": (3.0,), "triang": (0.3,), "powerlaw": (2.0,),
}
LEVELS = np.array([0.001, 0.02, 0.1, 0.26, 0.37, 0.52, 0.68, 0.81, 0.93, 0.985, 0.999])


def law(name, loc=0.0, scale=1.0):
    return MarginalNamed(name, {"loc": loc, "scale": scale} | dict(zip(LAWS[name].shapes, SHAPES.get(name, ()))))


def test_incomplete_functions_of_whole_shapes():
    """Against the sums of Poisson and binomial probabilities."""
    for a in (1, 4, 30, 200):
        for x in (0.1, 1.0, a * 0.9, a + 1.5, a * 2.0):
            tail = sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(a))
            assert abs(float(gamma_p(x, a)) - (1 - tail)) < 1e-12
    for a, b in ((1, 1), (2, 5), (20, 30), (7, 1)):
        for x in (0.01, 0.3, 0.5, 0.95):
            n = a + b - 1
            assert abs(float(beta_p(x, a, b)) - sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))) < 1e-12
    u = np.array([1e-12, 1e-5, 0.2, 0.7, 1 - 1e-9])
    for a in (0.2, 1.0, 9.0, 500.0):
        assert np.allclose(gamma_p(gamma_q(u, a), a), u, rtol=1e-10, atol=0)
    for a, b in ((0.4, 3.0), (8.0, 2.0), (300.0, 400.0)):
        assert np.allclose(beta_p(beta_q(u, a, b), a, b), u, rtol=1e-10, atol=0)
    assert gamma_q(0.0, 2.0) == 0 and gamma_q(1.0, 2.0) == math.inf and beta_q(1.0, 2.0, 2.0) == 1


@pytest.mark.parametrize("name", sorted(LAWS))
def test_slope_and_round_trip(name):
    m = law(name, 0.5, 2.0)
    x = np.asarray(m.q(LEVELS), float)
    assert np.all(np.diff(x) > 0) and np.allclose(m.p(x), LEVELS, rtol=1e-7, atol=1e-9), name
    h = 1e-5 * np.minimum(1, np.minimum(np.diff(x, prepend=x[0] - 1), np.diff(x, append=x[-1] + 1)))
    slope = (np.asarray(m.p(x + h)) - np.asarray(m.p(x - h))) / (2 * h)
    assert np.allclose(m.d(x), slope, rtol=2e-4, atol=1e-6), (name, m.d(x), slope)


@pytest.mark.parametrize("part", range(8))
def test_columns_are_as_numbers(spark, part):
    names = sorted(LAWS)[part::8]
    rows = [(n, float(u), float(law(n).q(u))) for n in names for u in LEVELS]
    rows += [(n, None, None) for n in names]
    df = spark.createDataFrame(rows, "name string, u double, x double")
    for n in names:
        m = law(n)
        got = df.where(F.col("name") == n).select("u", "x", m.d(F.col("x")).alias("d"), m.p(F.col("x")).alias("p"), m.q(F.col("u")).alias("q")).collect()
        assert len(got) == len(LEVELS) + 1
        for r in got:
            if r.u is None:
                assert r.p is None and r.q is None
                continue
            for a, b in ((r.d, m.d(r.x)), (r.p, m.p(r.x)), (r.q, m.q(r.u))):
                assert math.isclose(a, float(b), rel_tol=1e-9, abs_tol=1e-12), (n, r, float(b))


def test_ends_of_the_support(spark):
    for name in ("gamma", "beta", "weibull_max", "genpareto", "truncnorm", "wrapcauchy", "pearson3"):
        x, s = MORE_LAWS[name], SHAPES[name]
        lo, hi = x.support(*s)
        ends = [e for e in (lo - 1, lo, hi, hi + 1) if math.isfinite(e)]
        want = [0.0 if e <= lo else 1.0 for e in ends]
        assert [x.p(e, *s) for e in ends] == want and [x.d(e, *s) for e in ends] == [0.0] * len(ends)
        got = spark.createDataFrame([(e,) for e in ends], "x double").select(x.p(F.col("x"), *s).alias("p"), x.d(F.col("x"), *s).alias("d")).collect()
        assert [r.p for r in got] == want and [r.d for r in got] == [0.0] * len(ends)
        assert x.q(0.0, *s) == lo and x.q(1.0, *s) == hi and math.isnan(x.q(1.5, *s))


def test_long_laws_go_in_batches(spark):
    """Copies of a value, nulls and ends of the support in one batch."""
    m = law("gamma", 0.5, 2.0)
    df = spark.range(3000).selectExpr("CASE WHEN id % 7 > 0 THEN (id % 5) / 2.0D END AS x", "CASE WHEN id % 7 > 0 THEN (id % 5) / 4.0D END AS u")
    plan = df.select(m.p(F.col("x")), m.q(F.col("u")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 1
    got = df.select("x", "u", m.p(F.col("x")).alias("p"), m.q(F.col("u")).alias("q")).distinct().collect()
    assert len(got) == 6
    for r in got:
        assert (r.p is None and r.q is None) if r.x is None else (math.isclose(r.p, float(m.p(r.x)), abs_tol=1e-12) and (r.q == float(m.q(r.u)) or math.isclose(r.q, float(m.q(r.u)))))
