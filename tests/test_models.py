"""Models, their evaluation and fits."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_laws import SHAPES
from tidymesh import verbs as tm
from tidymesh.catalog.model_queries import beam, square
from tidymesh.models import compose as cp
from tidymesh.models import evaluate as ev
from tidymesh.models import fit as ft
from tidymesh.models.core import Domain, Model
from tidymesh.models.marginals import LAWS, marg_gkde, marg_mom, marg_named, marg_trunc


def test_roles_and_guards():
    md = beam()
    assert md.out == ["c_area", "g_stress", "g_disp"] and set(md.var_rand) == set("HVEY") and set(md.var_det) == {"w", "t"}
    assert md.det_nom() == {"w": 3.0, "t": 3.0}
    d = Domain({"a": (0, 2), "b": (1, math.inf)})
    assert d.get_nominal("a") == 1 and d.get_nominal("b") == 1 and math.isnan(d.get_nominal("c")) and d.get_width("a") == 2
    with pytest.raises(ValueError):
        cp.comp_function(md, fun=lambda x: x, var=["w"], out=["c_area"])
    with pytest.raises(ValueError):
        cp.comp_function(Model(), fun=lambda x: x, var=["w"], out=["w"])
    with pytest.raises(ValueError):
        cp.comp_freeze(md, nope=1)
    with pytest.raises(ValueError):
        marg_named("nolaw")
    with pytest.raises(ValueError):
        marg_trunc(marg_named("norm"))
    auto = cp.comp_function(Model(), fun=lambda x: x[0] + x[1], var=2, out=1)
    assert auto.var == ["x0", "x1"] and auto.out == ["y0"] and (Model() >> cp.cp_bounds(q=(0, 1))).var == ["q"]


@pytest.mark.parametrize("name", list(LAWS))
def test_laws(name):
    shapes = {"lognorm": {"s": 0.6}, "weibull_min": {"c": 1.7}, "pareto": {"b": 4.0}, "triang": {"c": 0.4}, "powerlaw": {"a": 2.0}}.get(name)
    shapes = dict(zip(LAWS[name].shapes, SHAPES.get(name, ()))) if shapes is None else shapes
    m = marg_named(name, loc=1.0, scale=2.0, **shapes)
    # the densities of these two have no slope in the middle
    u = np.array([0.03, 0.2, 0.52 if name in ("dgamma", "dweibull") else 0.5, 0.77, 0.97])
    x = m.q(u)
    assert np.allclose(m.p(x), u, atol=1e-9)
    h = 1e-5
    assert np.allclose((m.p(x + h) - m.p(x - h)) / (2 * h), m.d(x), rtol=1e-4)


def test_moments():
    u = (np.arange(200_000) + 0.5) / 200_000
    for law in ("norm", "uniform", "lognorm", "expon", "logistic", "laplace", "gumbel_r", "gumbel_l", "rayleigh", "weibull_min"):
        x = marg_mom(law, mean=5.0, sd=1.3).q(u)
        assert abs(x.mean() - 5) < 0.01 and abs(x.std() - 1.3) < 0.02, law
    t = marg_mom("norm", mean=0, sd=1, lo=-1, up=1)
    assert t.q(np.array([0.0001]))[0] > -1 and t.p(1.5) == 1
    with pytest.raises(ValueError):
        marg_mom("norm", mean=1)


def test_linear_variance(spark):
    md = cp.comp_vec_function(Model(), lambda x: {"y0": x.x0 + x.x1 + x.x2}, var=["x0", "x1", "x2"], out=["y0"])
    md = cp.comp_marginals(md, x1=marg_named("norm"), x2=marg_named("norm"))
    pairs = spark.createDataFrame([("x1", "x2", 0.5)], "var1 string, var2 string, corr double")
    md = cp.comp_copula_gaussian(md, df_corr=pairs)
    base = spark.createDataFrame([(0.0, 0.0, 0.0)], "x0 double, x1 double, x2 double")
    assert abs(ev.eval_linup(md, df_base=base, n=20_000).df.first()["var"] - 3) < 0.15
    s = ev.eval_sample(md, n=20_000, df_det=tm.df_make(x0=[0.0])).df
    assert abs(s.selectExpr("var_samp(y0) AS v").first().v - 3) < 0.15
    bad = spark.createDataFrame([("x1", "x2", 1.5)], "var1 string, var2 string, corr double")
    with pytest.warns(UserWarning):
        cp.comp_copula_gaussian(md, df_corr=bad)


def test_sampling_is_reproducible(spark):
    a, b = (ev.eval_sample(square(), n=300, seed=4).df for _ in range(2))
    assert tm.df_equal(a, b.repartition(7)) and not tm.df_equal(a, ev.eval_sample(square(), n=300, seed=5))
    with pytest.raises(ValueError):
        ev.eval_sample(cp.comp_marginals(Model(), a=marg_named("norm")), n=3, skip=True)
    with pytest.raises(ValueError):
        ev.eval_sample(beam(), n=3)


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        got = sorted(r[0] for r in spark.range(n).select(ev.permuted(F.col("id"), n, 3, "a")).collect())
        assert got == list(range(n))


def test_gradient_of_python_function(spark):
    md = cp.comp_function(Model(), fun=lambda a, b: math.pow(a, 2) + 3 * b, var=["a", "b"], out=["f"])
    base = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    got = sorted((r.a, round(r.Df_Da, 4), round(r.Df_Db, 4)) for r in ev.eval_grad_fd(md, df_base=base).df.collect())
    assert got == [(1.0, 2.0, 3.0), (3.0, 6.0, 3.0)]


def test_designs(spark):
    sweep = ev.eval_sinews(square(), n_density=5, n_sweeps=2).df
    assert sweep.count() == 2 * 2 * 5 and sweep.select("sweep_ind").distinct().count() == 4
    h = ev.eval_hybrid(square(), n=10, plan="total").df
    assert h.count() == 30
    with pytest.raises(ValueError):
        ev.eval_hybrid(beam().with_(density=beam().density.__class__(beam().density.marginals, None)), n=2, df_det="nom")
    both = ev.eval_sample(beam(), n=10, df_det=tm.df_grid(w=[2.0, 3.0], t=[2.0]), comm=True, ind_comm="i").df
    assert both.groupBy("i").agg({"H": "min"}).count() == 10 and both.count() == 20


def test_kernel_law(spark):
    df = spark.range(400).selectExpr("CAST(id % 20 AS DOUBLE) AS v")
    m = marg_gkde(df)
    got = df.select(m.p(df["v"]).alias("p"), m.d(df["v"]).alias("d"), m.q(m.p(df["v"])).alias("q"), "v").limit(20).collect()
    assert all(0 < r.p < 1 and r.d > 0 and abs(r.q - r.v) < 0.1 for r in got)


def test_fits(spark):
    df = spark.range(200).selectExpr("id / 20.0D AS a", "(id % 7) / 3.0D AS b").selectExpr("a", "b", "1 + 2 * a - b AS y")
    lm = ft.fit_lm(df, var=["a", "b"], out=["y"])
    assert lm.apply(df).selectExpr("max(abs(y - y_mean)) AS e").first().e < 1e-8 and lm.domain.get_bound("a") == (0.0, 9.95)
    data = spark.range(60).selectExpr("id / 10.0D AS s").selectExpr("s", "2.5 * exp(-0.7 * s) + 0.01 * sin(37 * s) AS y")
    from tidymesh.catalog.model_queries import decay

    uq = ft.fit_nls(data, md=decay(), uq_method="linpool")
    m = uq.density.marginals
    assert abs(m["a"].d_param["loc"] - 2.5) < 0.05 and 0 < m["k"].d_param["scale"] < 0.05 and set(uq.var_rand) == {"a", "k"}
    two = spark.createDataFrame([(x + d, x) for x in (0.0, 10.0) for d in (0.0, 0.1, 0.2, 0.3)], "x double, y double")
    km = ft.fit_kmeans(two, var=["x", "y"], n_clusters=2, seed=1)
    got = km.apply(two).collect()
    assert len({r.cluster_id for r in got if r.y == 0}) == 1 and len({r.cluster_id for r in got}) == 2


def test_reliability(spark):
    md = cp.comp_function(Model(), fun=lambda x: 6 - x[0] - math.sqrt(3) * x[1], var=["x0", "x1"], out=["g"])
    md = cp.comp_copula_independence(cp.comp_marginals(md, x0=marg_named("norm"), x1=marg_named("norm")))
    assert abs(ev.eval_form_ria(md).df.first()["beta_g"] - 3) < 1e-4
    assert abs(ev.eval_form_ria(md, format="pofs").df.first()["pof_g"] - 0.00134990) < 1e-6
    for args in ({"betas": {"g": 3.0}}, {"rels": {"g": 0.9986501}}, {"pofs": {"g": 0.0013499}}):
        assert abs(ev.eval_form_pma(md, **args).df.first()["g"]) < 1e-3
    with pytest.raises(ValueError):
        ev.eval_form_pma(md)


def test_constrained_minimum(spark):
    md = cp.comp_vec_function(Model(), lambda v: {"f": v.x**2 + v.y**2, "c": v.x + v.y - 1}, var=["x", "y"], out=["f", "c"])
    md = cp.comp_bounds(md, x=(-2, 2), y=(-2, 2))
    r = ev.eval_min(md, out_min="f", out_geq=["c"]).df.first()
    assert abs(r.x - 0.5) < 1e-3 and abs(r.y - 0.5) < 1e-3 and r.success == 1
    r = ev.eval_min(md, out_min="f", out_eq=["c"]).df.first()
    assert abs(r.f - 0.5) < 1e-3


def test_contour_lines(spark):
    md = cp.comp_vec_function(Model(), lambda v: {"g": v.x + v.y}, var=["x", "y"], out=["g"])
    got = ev.eval_contour(cp.comp_bounds(md, x=(-1, 1), y=(-1, 1)), var=("x", "y"), levels=[0.1], n_side=10).df.collect()
    assert got and all(abs(r.x_start + r.y_start - 0.1) < 1e-9 and abs(r.x_end + r.y_end - 0.1) < 1e-9 for r in got)


def test_predicted_dominance():
    train = np.array([[0.0, 1.0], [1.0, 0.0], [0.5, 0.5]])
    p = ev.approx_pnd(np.array([[-1.0, -1.0], [2.0, 2.0]]), np.array([np.eye(2) * 1e-3] * 2), train, np.array([1, 1]))
    assert p[0] > 0.95 and p[1] < 0.05


def test_predicted_dominance_of_many_rows(spark):
    """Equal predictions of a batch are scored once and told for every row; densities are those of the plain formula."""
    rng = np.random.default_rng(5)
    at, s, x = rng.random((150, 2)), np.array([[0.02, 0.006], [0.006, 0.01]]), rng.random((40, 2))
    far = x[:, None] - at[None]
    want = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", far, np.linalg.inv(s), far)).mean(axis=1) / (2 * math.pi * math.sqrt(np.linalg.det(s)))
    assert np.allclose(ev.dprop(x, s, at), want, rtol=1e-9)
    md = cp.comp_vec_function(Model(), lambda v: {"a_mean": v.u, "b_mean": v.w, "a_sd": 0.05 + 0 * v.u, "b_sd": 0.05 + 0 * v.u}, var=["u", "w"], out=["a_mean", "b_mean", "a_sd", "b_sd"])
    train = spark.createDataFrame([(0.3, 0.7), (0.5, 0.5), (0.7, 0.3)], "a double, b double")
    test = spark.range(20_000).selectExpr("id", "(id % 5) / 4.0D AS u", "(id % 4) / 3.0D AS w")
    began = time.perf_counter()
    got = ev.eval_pnd(md, train, test, signs={"a": 1, "b": 1}, n=20_000).df.collect()
    assert time.perf_counter() - began < 25  # a density of each row at each draw takes minutes
    assert len({r.id for r in got}) == len(got) == 20_000
    for r in got:
        if r.u == 0 or r.w == 0:
            assert r.pr_scores > 0.95
        elif r.u >= 0.75 and r.w > 0.6:
            assert r.pr_scores < 0.05



def test_queries_take_whole_tables(spark, sf_dir, monkeypatch):
    from tidymesh.catalog import model_queries
    from tidymesh.catalog.registry import QUERIES

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert QUERIES["pareto_probability"](spark, sf_dir).count() == parts
    taken = []
    monkeypatch.setattr(model_queries.st, "tran_bootstrap", lambda data, **kw: taken.append(data.df.count()) or tm.as_table(tm.df_make(m_lo=[0.0], m=[1.0], m_up=[2.0])))
    assert QUERIES["bootstrap_interval"](spark, sf_dir).count() == 1 and taken == [parts]


def test_kernel_law_of_repeated_values(spark):
    """50 values of 600 rows each: the law has all of them, not the copies of one."""
    m = marg_gkde(spark.range(30_000).selectExpr("CAST(id % 50 AS DOUBLE) AS v"), "v")
    assert len(set(m.points)) == 50
    assert all(abs(float(m.p(49 * u)) - u) < 0.05 for u in (0.25, 0.5, 0.75))
