"""Ready models, and fits by scoring, against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidymesh.models import evaluate as ev
from tidymesh.models import library as lib
from tidymesh.models.marginals import MarginalNamed, marg_fit
from tidymesh.table import as_table

MODELS = [
    lib.make_test, lib.make_linear_normal, lib.make_poly, lib.make_ishigami, lib.make_cantilever_beam, lib.make_prlc, lib.make_prlc_rand, lib.make_piston, lib.make_piston_rand, lib.make_trajectory_linear,
    lib.make_channel_nondim, lib.make_channel, lib.make_pareto_random, lambda: lib.make_pareto_random(False), lib.make_pipe_friction, lib.make_sir, lambda: lib.make_composite_plate_tension([0.3, -0.3, 0.0]),
]


@pytest.mark.parametrize("k", range(len(MODELS)))
def test_columns_are_as_numbers(spark, k):
    md = MODELS[k]()
    rng, cols = np.random.default_rng(k), {}
    for v in md.var:
        if v in md.density.marginals:
            cols[v] = np.asarray(md.density.marginals[v].q(rng.uniform(0.05, 0.95, 12)), float)
        else:
            lo, up = (float(b) for b in md.domain.get_bound(v))
            cols[v] = rng.uniform(lo if math.isfinite(lo) else -1, up if math.isfinite(up) else (lo if math.isfinite(lo) else 0) + 2, 12)
    df = spark.createDataFrame([(i, *(float(cols[v][i]) for v in md.var)) for i in range(12)], "row_no int, " + ", ".join(f"`{v}` double" for v in md.var))
    got = sorted(ev.eval_df(md, df).df.collect(), key=lambda r: r.row_no)
    want = md.numbers(cols)
    for o in md.out:
        assert np.allclose([r[o] for r in got], want[o], rtol=1e-9, atol=1e-12), o


def test_epidemic_against_small_steps(spark):
    def steps(s, i, beta, gamma, t, h=0.01):
        y = np.array([s, i, 0.0])

        def f(y):
            caught = beta * y[0] * y[1] / y.sum()
            return np.array([-caught, caught - gamma * y[1], gamma * y[1]])

        for _ in range(round(t / h)):
            a = f(y)
            b = f(y + h / 2 * a)
            c = f(y + h / 2 * b)
            y = y + h / 6 * (a + 2 * b + 2 * c + f(y + h * c))
        return y

    sets = [(99.0, 1.0, 0.5, 0.1), (90.0, 10.0, 0.2, 0.4), (95.0, 5.0, 0.0, 0.3)]
    rows = [(100.0, i, b, g, float(t)) for _, i, b, g in sets for t in (0, 0.5, 7, 40, 100)] + [(100.0, None, 0.1, 0.1, 1.0), (100.0, 1.0, 0.1, 0.1, 0.0), (100.0, 1.0, 0.5, 0.1, -3.0)]
    df = spark.createDataFrame(rows, "N double, I0 double, beta double, gamma double, t double")
    for rtol, atol, far in ((1e-9, 1e-11, 1e-6), (1e-4, 1e-6, 2e-2)):
        for r in ev.eval_df(lib.make_sir(rtol, atol), df).collect():
            if r.I0 is None:
                assert r.S is None and r.I is None
                continue
            want = steps(100 - r.I0, r.I0, r.beta, r.gamma, max(r.t, 0))
            assert np.abs(np.array([r.S, r.I, r.R]) - want).max() < far
    assert ev.eval_df(lib.make_sir(), df.limit(0)).df.count() == 0


def test_times_of_one_set_are_spread(spark):
    """A set with very many times is integrated once; its rows stay where they are."""
    df = spark.range(50_000).selectExpr("100.0D AS N", "5.0D AS I0", "0.4D AS beta", "0.1D AS gamma", "id / 500.0D AS t")
    got = ev.eval_df(lib.make_sir(1e-8, 1e-10), df).df.agg(F.count("S"), F.max(F.abs(F.col("S") + F.col("I") + F.col("R") - 100))).first()
    assert got[0] == 50_000 and got[1] < 1e-6


def test_pipe_residual(spark):
    rows = [(1.2, float(u), 1.5, 1.2e-5, eps) for u in (1e-4, 0.01, 0.1, 1, 10) for eps in (0.05, 0.2)]
    for r in ev.eval_df(lib.make_pipe_friction(), spark.createDataFrame(rows, "rho double, u double, d double, mu double, eps double")).collect():
        re = r.rho * r.u * r.d / r.mu
        assert abs(r.f - 64 / re) < 1e-15 if re < 3000 else abs(1 + 2 * math.sqrt(r.f) * math.log10(r.eps / 3.6 / r.d + 2.51 / re / math.sqrt(r.f))) < 1e-10


def test_laminate():
    """A known laminate's stiffness, and one ply's stresses."""
    x = {f"{k}_{i}": np.array([v]) for i, a in enumerate((45, -45, 0, 90)) for k, v in zip(lib.PLY, (180e9, 10e9, 0.3, 7e9, math.radians(a), 1e-3, *[1e9] * 5))} | {"Nx": np.array([1e5])}
    got = lib.laminate_limits(lib.Inputs(x), 4)
    # the stiffness of the whole, by closed form (Tsai and Pagano's invariants), and the fibre strain it leaves in the ply along the load
    nu21 = 0.3 * 10e9 / 180e9
    q11, q22, q12, q66 = 180e9 / (1 - 0.3 * nu21), 10e9 / (1 - 0.3 * nu21), 0.3 * 10e9 / (1 - 0.3 * nu21), 7e9
    u1, u4 = (3 * q11 + 3 * q22 + 2 * q12 + 4 * q66) / 8, (q11 + q22 + 6 * q12 - 4 * q66) / 8
    a11, a12 = 4e-3 * u1, 4e-3 * u4
    ex, ey = 1e5 * a11 / (a11**2 - a12**2), -1e5 * a12 / (a11**2 - a12**2)
    assert math.isclose((1 - got["g_11_tension_2"][0]) * 1e9, q11 * ex + q12 * ey, rel_tol=1e-5) and math.isclose((1 - got["g_22_tension_2"][0]) * 1e9, q12 * ex + q22 * ey, rel_tol=1e-5)
    one = lib.laminate_limits(lib.Inputs({f"{k}_0": np.array([v]) for k, v in zip(lib.PLY, (114e9, 7e9, 0.45, 4e9, 0.4, 1e-3, 1.4e9, 1.4e6, 0.5e9, 0.5e6, 62e6))} | {"Nx": np.array([1e6])}), 1)
    assert math.isclose(one["g_11_tension_0"][0], 1 - 1e9 * math.cos(0.4) ** 2 / 1.4e9, rel_tol=1e-9) and math.isclose(one["g_12_shear_0"][0], 1 - 1e9 * math.sin(0.4) * math.cos(0.4) / 62e6, rel_tol=1e-9)


def test_plate_of_measured_data(spark):
    rows = [(10_000.0 + 50 * math.sin(i), 0.3 + 0.02 * math.cos(i)) for i in range(200)]
    md = lib.make_plate_buckle(spark.createDataFrame(rows, "stiff double, ratio double"), E="stiff", mu="ratio")
    assert abs(md.density.marginals["E"].d_param["loc"] - np.mean([r[0] for r in rows])) < 1e-6 and md.density.marginals["mu"].d_name == "beta"


@pytest.mark.parametrize(
    ("dist", "param"),
    [("gamma", {"a": 2.5, "scale": 3.0}), ("beta", {"a": 2.0, "b": 5.0}), ("weibull_min", {"c": 1.8, "scale": 40.0}), ("t", {"df": 4.0, "loc": 1.0, "scale": 2.0}), ("logistic", {"loc": -3.0, "scale": 0.5}), ("invgauss", {"mu": 0.7, "scale": 2.0}), ("genextreme", {"c": -0.15, "loc": 10.0, "scale": 2.0})],
)
def test_fits_find_planted_parameters(spark, dist, param):
    n = 4000
    x = MarginalNamed(dist, param).q((np.arange(n) + 0.5) / n)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = marg_fit(dist, as_table(df), "x").d_param
    for k, v in param.items():
        assert math.isclose(got[k], v, rel_tol=0.03, abs_tol=0.02), (k, got)


def test_fixed_parameters(spark):
    df = spark.createDataFrame([(float(v),) for v in MarginalNamed("gamma", {"a": 2.0, "loc": 5.0, "scale": 3.0}).q((np.arange(2000) + 0.5) / 2000)], "x double")
    got = marg_fit("gamma", as_table(df), "x", floc=5.0, fscale=3.0).d_param
    assert got["loc"] == 5 and got["scale"] == 3 and abs(got["a"] - 2) < 0.02
    for wrong in ({"nothing": 1.0}, {"fc": 2.0}):
        with pytest.raises(ValueError):
            marg_fit("gamma", as_table(df), "x", **wrong)
    with pytest.raises(ValueError):
        marg_fit("gamma", as_table(df.limit(0)), "x")
    assert marg_fit("laplace", as_table(spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")), "x").d_param == {"loc": 2.0, "scale": 5 / 3}


def test_scoring_takes_each_value_once(spark, monkeypatch):
    """Rounds read 40 counted values of 9,000 rows; the law is that of the rows, by the equation of its likelihood."""
    from tidymesh.models import likelihood

    read, settle = [], likelihood.settle
    monkeypatch.setattr(likelihood, "settle", lambda df, name: read.append(settle(df, name)) or read[-1])
    rows = spark.range(9_000).selectExpr("IF(id % 9 = 0, NULL, 1 + (id * id) % 40) AS v").selectExpr("CAST(v AS DOUBLE) AS v")
    m = marg_fit("gamma", rows, "v")
    known = np.array([r.v for r in rows.where("v IS NOT NULL").collect()])
    assert read[0].count() == len(set(known)) and read[0].agg({"n": "sum"}).first()[0] == len(known)
    a, h = m.d_param["a"], 1e-5
    psi = (math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h)
    assert abs(math.log(a) - psi - (math.log(known.mean()) - np.log(known).mean())) < 1e-6 and abs(a * m.d_param["scale"] - known.mean()) < 1e-5
