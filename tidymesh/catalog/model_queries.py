"""Queries of models, fits and statistical transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidymesh import verbs as tm
from tidymesh.catalog.registry import Tables, query
from tidymesh.models import compose as cp
from tidymesh.models import evaluate as ev
from tidymesh.models import fit as ft
from tidymesh.models.core import Model
from tidymesh.models.marginals import marg_fit, marg_gkde, marg_mom, marg_named, marg_trunc
from tidymesh.transforms import charts, pareto, spc, statistics as st
from tidymesh.verbs import X


def beam() -> Model:
    """A cantilever beam: width and thickness are chosen, loads and material are random."""
    md = cp.comp_vec_function(Model("beam"), lambda x: {"c_area": x.w * x.t}, var=["w", "t"], out=["c_area"], name="area")
    md = cp.comp_vec_function(md, lambda x: {"g_stress": (x.Y - 600 * x.V / x.w / x.t**2 - 600 * x.H / x.w**2 / x.t) / 1e4}, var=["w", "t", "H", "V", "Y"], out=["g_stress"], name="stress")
    md = cp.comp_vec_function(
        md, lambda x: {"g_disp": 2.2535 - 4e6 / x.E / x.w / x.t * tm.sqrt((x.V / x.t**2) ** 2 + (x.H / x.w**2) ** 2)}, var=["w", "t", "H", "V", "E"], out=["g_disp"], name="displacement"
    )
    md = cp.comp_bounds(md, w=(2, 4), t=(2, 4))
    md = cp.comp_marginals(
        md, H=marg_named("norm", sign=1, loc=500, scale=100), V=marg_named("norm", sign=1, loc=1000, scale=100), E=marg_named("norm", sign=-1, loc=2.9e7, scale=1.45e6), Y=marg_named("norm", sign=-1, loc=40000, scale=2000)
    )
    return cp.comp_copula_independence(md)


def _inputs(t: Tables):
    return t("lineitem") >> tm.tf_select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice") >> tm.tf_mutate(
        w=2 + X.l_quantity / 25, t=2 + X.l_discount * 10, H=400 + X.l_quantity * 4, V=900 + X.l_tax * 1000, E=2.9e7 + X.l_quantity * 1e4, Y=40000 - X.l_quantity * 10
    )


_INPUT_SQL = "SELECT l_orderkey, l_linenumber, 2 + l_quantity / 25 AS w, 2 + l_discount * 10 AS t, 400 + l_quantity * 4 AS H, 900 + l_tax * 1000 AS V, 2.9e7 + l_quantity * 1e4 AS E, 40000 - l_quantity * 10 AS Y FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, round_even(w * t, 6) AS c_area, round_even((Y - 600 * V / w / t ** 2 - 600 * H / w ** 2 / t) / 1e4 + 1e-8, 6) AS g_stress,
    round_even(2.2535 - 4e6 / E / w / t * sqrt((V / t ** 2) ** 2 + (H / w ** 2) ** 2) + 1e-8, 6) AS g_disp FROM ({_INPUT_SQL})""")
def model_evaluate(t: Tables):
    out = ev.eval_df(beam(), _inputs(t))
    return out >> tm.tf_mutate(c_area=tm.round(X.c_area, 6), g_stress=tm.round(X.g_stress + 1e-8, 6), g_disp=tm.round(X.g_disp + 1e-8, 6)) >> tm.tf_select("l_orderkey", "l_linenumber", "c_area", "g_stress", "g_disp")


@query(f"SELECT l_orderkey, l_linenumber, round(w * t, 6) AS area FROM ({_INPUT_SQL})")
def model_python_function(t: Tables):
    """A function that no column goes through, so it runs in Arrow batches."""
    md = cp.comp_function(Model(), fun=lambda w, t: math.fsum([w * t, 0.0]), var=["w", "t"], out=["area"])
    return _inputs(t) >> st.tf_md(md) >> tm.tf_mutate(area=tm.round(X.area, 6)) >> tm.tf_select("l_orderkey", "l_linenumber", "area")


@query(f"SELECT l_orderkey, l_linenumber, round(3 * t + w * w, 6) AS res FROM ({_INPUT_SQL})")
def model_frozen_nested(t: Tables):
    inner = cp.comp_vec_function(Model("inner"), lambda x: {"z": x.k * x.t}, var=["k", "t"], out=["z"])
    inner = cp.comp_freeze(inner, k=3.0)
    md = cp.comp_function(cp.comp_md_det(Model(), inner), fun=lambda x: x[0] + x[1] * x[1], var=["z", "w"], out=["res"])
    return _inputs(t) >> st.tf_md(md) >> tm.tf_mutate(res=tm.round(X.res, 6)) >> tm.tf_select("l_orderkey", "l_linenumber", "res")


@query("""SELECT a.w, b.t, 500::DOUBLE AS H, 1000::DOUBLE AS V, 2.9e7::DOUBLE AS E, 40000::DOUBLE AS Y, a.w * b.t AS c_area, round((40000 - 600 * 1000 / a.w / b.t ** 2 - 600 * 500 / a.w ** 2 / b.t) / 1e4, 8) AS g_stress
    FROM (VALUES (2.0::DOUBLE), (3.0)) a(w), (VALUES (2.5::DOUBLE), (4.0)) b(t)""")
def model_nominal(t: Tables):
    out = ev.eval_nominal(beam(), df_det=tm.df_grid(w=[2.0, 3.0], t=[2.5, 4.0]))
    return out >> tm.tf_mutate(g_stress=tm.round(X.g_stress, 8)) >> tm.tf_select("w", "t", "H", "V", "E", "Y", "c_area", "g_stress")


@query("SELECT 3::DOUBLE AS w, 3::DOUBLE AS t, round(500 + 2.3263478740408408e0 * 100, 6) AS H, round(1000 + 2.3263478740408408e0 * 100, 6) AS V, round(40000 - 2.3263478740408408e0 * 2000, 6) AS Y")
def model_conservative(t: Tables):
    out = ev.eval_conservative(beam(), df_det="nom")
    return out >> tm.tf_mutate(H=tm.round(X.H, 6), V=tm.round(X.V, 6), Y=tm.round(X.Y, 6)) >> tm.tf_select("w", "t", "H", "V", "Y")


def _draw(i: str, seed: int, name: str) -> str:
    return f"((('0x' || substr(md5(({i})::VARCHAR || '/{seed}/{name}'), 1, 12))::BIGINT + 0.5) / 281474976710656)"


def square() -> Model:
    md = cp.comp_vec_function(Model(), lambda x: {"y": x.a * x.a + x.b, "z": x.a - x.b}, var=["a", "b"], out=["y", "z"])
    md = cp.comp_marginals(md, a={"dist": "uniform", "loc": -1, "scale": 2}, b={"dist": "expon", "scale": 0.5})
    return cp.comp_copula_independence(md)


@query(f"SELECT round(a, 9) AS a, round(b, 9) AS b, round(a * a + b, 9) AS y, round(a - b, 9) AS z FROM (SELECT -1 + 2 * {_draw('i', 7, 'a')} AS a, -0.5 * ln(1 - {_draw('i', 7, 'b')}) AS b FROM range(2000) r(i))")
def model_sample(t: Tables):
    """Draws are hashes, so any engine makes the same."""
    out = ev.eval_sample(square(), n=2000, seed=7)
    return out >> tm.tf_mutate(a=tm.round(X.a, 9), b=tm.round(X.b, 9), y=tm.round(X.y, 9), z=tm.round(X.z, 9))


@query("SELECT 500 * 4 AS n, 0 AS far FROM range(1)".replace("500 * 4 AS n", "2000::BIGINT AS n").replace("0 AS far", "false AS far"))
def model_sample_levels(t: Tables):
    out = ev.eval_sample(beam(), n=500, df_det=tm.df_grid(w=[2.0, 3.0], t=[2.0, 3.0]), comm=False, seed=3)
    return out >> tm.tf_summarize(n=tm.n(), far=tm.abs(tm.mean(X.H) - 500) > 10)


@query("SELECT 100::BIGINT AS n, 100::BIGINT AS slices_a, 100::BIGINT AS slices_b FROM range(1)")
def model_latin_hypercube(t: Tables):
    """Each hundredth of each law is drawn from once."""
    out = ev.eval_lhs(square(), n=100, seed=5)
    m = square().density.marginals
    from tidymesh.expr import scalar

    slot = {v: scalar((lambda v: lambda c: tm.floor(m[v].p(c) * 100))(v)) for v in m}
    return out >> tm.tf_mutate(sa=slot["a"](X.a), sb=slot["b"](X.b)) >> tm.tf_summarize(n=tm.n(), slices_a=tm.n_distinct(X.sa), slices_b=tm.n_distinct(X.sb))


@query("SELECT round(a, 6) AS a, round(2 * a, 4) AS dya, 1::DOUBLE AS dyb, 1::DOUBLE AS dza, -1::DOUBLE AS dzb FROM (SELECT p_size / 10.0 AS a FROM part)")
def model_gradient(t: Tables):
    base = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, b=X.p_size * 1.0) >> tm.tf_select("a", "b")
    out = ev.eval_grad_fd(square(), df_base=base)
    r = lambda c: tm.round(c, 4)
    return out >> tm.tf_mutate(a=tm.round(X.a, 6), dya=r(X.Dy_Da), dyb=r(X.Dy_Db), dza=r(X.Dz_Da), dzb=r(X.Dz_Db)) >> tm.tf_select("a", "dya", "dyb", "dza", "dzb")


@query(f"""WITH d AS (SELECT -1 + 2 * {_draw('i', 0, 'a')} AS a, -0.5 * ln(1 - {_draw('i', 0, 'b')}) AS b FROM range(10000) r(i)), c AS (SELECT var_samp(a) AS aa, covar_samp(a, b) AS ab, var_samp(b) AS bb FROM d),
    p AS (SELECT p_partkey, p_size / 10.0 AS a, aa, ab, bb FROM part, c), t AS (SELECT *, 4 * a * a * aa + 4 * a * ab + bb AS y, aa - 2 * ab + bb AS z FROM p)
    SELECT round(a, 6) AS a, 'y' AS out, unnest(['a,a', 'a,b', 'b,b']) AS var_in, round(y, 3) AS var, round(unnest([4 * a * a * aa, 4 * a * ab, bb]) / y, 2) AS var_frac FROM t
    UNION ALL SELECT round(a, 6), 'z', unnest(['a,a', 'a,b', 'b,b']), round(z, 3), round(unnest([aa, -2 * ab, bb]) / z, 2) FROM t""")
def model_linear_uncertainty(t: Tables):
    """At each part, with the covariances of draws that the SQL makes again."""
    base = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, b=X.p_size * 1.0) >> tm.tf_select("a", "b")
    out = ev.eval_linup(square(), df_base=base, decomp=True)
    return out >> tm.tf_mutate(a=tm.round(X.a, 6), var=tm.round(X["var"], 3)) >> tm.tf_select("a", "out", "var_in", "var", "var_frac")


@query(f"""WITH s AS (SELECT s.i, v.v, v.p, k.k, s.i * 2 + v.p AS ind FROM range(30) s(i), (VALUES ('a', 0), ('b', 1)) v(v, p), range(10) k(k)),
    u AS (SELECT v, ind, CASE WHEN v = 'a' THEN k / 9.0 ELSE {_draw('i', 1, 'a')} END AS ua, CASE WHEN v = 'b' THEN k / 9.0 ELSE {_draw('i', 1, 'b')} END AS ub FROM s),
    x AS (SELECT v, ind, -1 + 2 * least(greatest(ua, 0.001), 0.999) AS a, -0.5 * ln(1 - least(greatest(ub, 0.001), 0.999)) AS b FROM u)
    SELECT v AS sweep_var, ind AS sweep_ind, round(a, 9) AS a, round(b, 9) AS b, round(a * a + b, 9) AS y, round(a - b, 9) AS z FROM x""")
def model_sweeps(t: Tables):
    out = ev.eval_sinews(square(), n_density=10, n_sweeps=30, seed=1)
    return out >> tm.tf_mutate(**{c: tm.round(X[c], 9) for c in ("a", "b", "y", "z")}) >> tm.tf_select("sweep_var", "sweep_ind", "a", "b", "y", "z")


@query(f"""WITH s AS (SELECT i, b FROM range(2000) r(i), (VALUES ('_'), ('a'), ('b')) v(b)),
    u AS (SELECT i, b, CASE WHEN b IN ('_', 'a') THEN {_draw('i', 2, 'a')} ELSE {_draw('i', 2, "a''")} END AS ua, CASE WHEN b IN ('_', 'b') THEN {_draw('i', 2, 'b')} ELSE {_draw('i', 2, "b''")} END AS ub FROM s),
    x AS (SELECT i, b AS v, -1 + 2 * ua AS a, -0.5 * ln(1 - ub) AS b FROM u)
    SELECT v AS hybrid_var, i AS hybrid_ind, round(a, 9) AS a, round(b, 9) AS b, round(a * a + b, 9) AS y, round(a - b, 9) AS z FROM x""")
def model_hybrid(t: Tables):
    out = ev.eval_hybrid(square(), n=2000, seed=2)
    return out >> tm.tf_mutate(**{c: tm.round(X[c], 9) for c in ("a", "b", "y", "z")}) >> tm.tf_select("hybrid_var", "hybrid_ind", "a", "b", "y", "z")


@query("SELECT 'a' AS var, true AS ok UNION ALL SELECT 'b', true")
def sobol_indices(t: Tables):
    """z = a - b: variances 1/3 and 1/4, so first-order indices 0.571 and 0.429."""
    out = st.tran_sobol(ev.eval_hybrid(square(), n=4000, seed=2), digits=6)
    return out >> tm.tf_mutate(ok=tm.abs(X.z - tm.case_when([X.var == "a", 4 / 7], [X.var == "b", 3 / 7])) < 0.05) >> tm.tf_select("var", "ok")


@query("SELECT 1::DOUBLE AS beta UNION ALL SELECT 3::DOUBLE")
def reliability_index(t: Tables):
    linear = cp.comp_function(Model(), fun=lambda x: 6 - x[0] - math.sqrt(3) * x[1], var=["x0", "x1"], out=["g"])
    linear = cp.comp_copula_independence(cp.comp_marginals(linear, x0=marg_named("norm"), x1=marg_named("norm")))
    other = cp.comp_vec_function(Model(), lambda x: {"g": math.exp(math.sqrt(2)) - x.x * x.y}, var=["x", "y"], out=["g"])
    other = cp.comp_copula_independence(cp.comp_marginals(other, x=marg_named("lognorm", s=1), y=marg_named("lognorm", s=1)))
    both = ev.eval_form_ria(linear, append=False) >> tm.tf_bind_rows(ev.eval_form_ria(other, append=False))
    return both >> tm.tf_mutate(beta=tm.round(X.beta_g, 4)) >> tm.tf_select("beta")


@query("SELECT 0::DOUBLE AS g, round(1.5, 4)::DOUBLE AS x0, 2.5981::DOUBLE AS x1")
def reliability_measure(t: Tables):
    linear = cp.comp_function(Model(), fun=lambda x: 6 - x[0] - math.sqrt(3) * x[1], var=["x0", "x1"], out=["g"])
    linear = cp.comp_copula_independence(cp.comp_marginals(linear, x0=marg_named("norm"), x1=marg_named("norm")))
    return ev.eval_form_pma(linear, betas={"g": 3.0}) >> tm.tf_mutate(g=tm.abs(tm.round(X.g, 4)), x0=tm.round(X.x0, 4), x1=tm.round(X.x1, 4))


@query("SELECT 1::DOUBLE AS x, 2::DOUBLE AS y, 1::DOUBLE AS success")
def constrained_minimum(t: Tables):
    md = cp.comp_vec_function(Model(), lambda v: {"f": (v.x - 2) ** 2 + (v.y - 3) ** 2, "c": v.x + v.y - 3}, var=["x", "y"], out=["f", "c"])
    out = ev.eval_min(cp.comp_bounds(md, x=(-5, 5), y=(-5, 5)), out_min="f", out_leq=["c"])
    return out >> tm.tf_mutate(x=tm.round(X.x, 3), y=tm.round(X.y, 3)) >> tm.tf_select("x", "y", "success")


def decay() -> Model:
    md = cp.comp_vec_function(Model(), lambda x: {"y": x.a * tm.exp(-x.k * x.s)}, var=["a", "k", "s"], out=["y"])
    return cp.comp_bounds(md, a=(0.1, 10), k=(0.01, 3))


def _decay_data(t: Tables):
    return t("part") >> tm.tf_mutate(s=X.p_size / 10.0) >> tm.tf_mutate(y=2.5 * tm.exp(-0.7 * X.s)) >> tm.tf_select("s", "y")


@query("SELECT 2.5::DOUBLE AS a, 0.7::DOUBLE AS k")
def nonlinear_least_squares(t: Tables):
    return ev.eval_nls(decay(), df_data=_decay_data(t)) >> tm.tf_mutate(a=tm.round(X.a, 5), k=tm.round(X.k, 5)) >> tm.tf_select("a", "k")


@query("SELECT count(*) AS n, 0::DOUBLE AS worst FROM part")
def fit_nonlinear(t: Tables):
    md = ft.fit_nls(_decay_data(t), md=decay())
    data = _decay_data(t) >> tm.tf_rename(seen="y")
    return data >> st.tf_md(md) >> tm.tf_summarize(n=tm.n(), worst=tm.round(tm.max(tm.abs(X.y - X.seen)), 5))


@query("""WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 4) AS predicted FROM lineitem, r""")
def fit_linear(t: Tables):
    md = ft.fit_lm(t("lineitem"), var=["l_quantity"], out=["l_extendedprice"])
    return t("lineitem") >> st.tf_md(md) >> tm.tf_mutate(predicted=tm.round(X.l_extendedprice_mean, 4)) >> tm.tf_select("l_orderkey", "l_linenumber", "predicted")


@query("SELECT count(*) AS n, 0::DOUBLE AS worst FROM part")
def fit_formula(t: Tables):
    data = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, b=X.p_retailprice / 1000) >> tm.tf_mutate(y=1 + 2 * X.a - X.b + 0.5 * X.a * X.b + 0.25 * X.a * X.a) >> tm.tf_select("a", "b", "y")
    md = ft.fit_ols(data, ["y ~ a + b + a:b + I(a**2)"])
    return data >> st.tf_md(md) >> tm.tf_summarize(n=tm.n(), worst=tm.round(tm.max(tm.abs(X.y - X.y_mean)), 6))


@query("SELECT count(*) AS n, true AS good FROM part")
def fit_forest(t: Tables):
    data = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, y=tm.sin(X.p_size / 10.0)) >> tm.tf_select("a", "y")
    md = ft.fit_rf(data, var=["a"], out=["y"], max_depth=6, seed=1)
    return data >> st.tf_md(md) >> tm.tf_summarize(n=tm.n(), good=tm.rsq(X.y_mean, X.y) > 0.95)


@query("SELECT count(*) AS n, true AS good FROM part")
def fit_forest_spread(t: Tables):
    data = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, y=tm.sin(X.p_size / 10.0)) >> tm.tf_select("a", "y")
    md = ft.fit_lolo(data, var=["a"], out=["y"], seed=1, n_estimators=10)
    return data >> st.tf_md(md) >> tm.tf_summarize(n=tm.n(), good=tm.min(X.y_sd) >= 0)


@query("SELECT count(*) AS n, true AS good FROM part")
def fit_gaussian_process(t: Tables):
    data = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, y=tm.sin(X.p_size / 10.0)) >> tm.tf_select("a", "y")
    md = ft.fit_gp(data, var=["a"], out=["y"], inducing=40, n_restart=1)
    return data >> st.tf_md(md) >> tm.tf_summarize(n=tm.n(), good=tm.rmse(X.y_mean, X.y) < 0.05)


@query("SELECT count(*) FILTER (WHERE s_acctbal < m) AS low, count(*) AS n FROM supplier, (SELECT avg(s_acctbal) AS m FROM supplier)".replace("count(*) FILTER (WHERE s_acctbal < m) AS low, ", "2::BIGINT AS clusters, "))
def fit_clusters(t: Tables):
    md = ft.fit_kmeans(t("supplier"), var=["s_acctbal"], n_clusters=2, seed=1)
    return t("supplier") >> st.tf_md(md) >> tm.tf_summarize(clusters=tm.n_distinct(X.cluster_id), n=tm.n())


@query("SELECT count(*) AS n, 0::DOUBLE AS worst FROM part")
def fit_ridge(t: Tables):
    data = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, b=(X.p_partkey % 17) / 5.0) >> tm.tf_mutate(y=tm.pow(X.a + 2 * X.b, 2) + X.a + 2 * X.b) >> tm.tf_select("a", "b", "y")
    md = ft.fit_polyridge(data, var=["a", "b"], out="y", n_dim=1, n_degree=2)
    return data >> st.tf_md(md) >> tm.tf_summarize(n=tm.n(), worst=tm.round(tm.max(tm.abs(X.y - X.y_mean)), 5))


@query("SELECT p_partkey, (p_size - a) / (b - a)::DOUBLE AS z FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)")
def standardize(t: Tables):
    lo, up = ft.column_ranges(t("part"), ["p_size"])
    return tm.as_table(ft.standardize_cols(t("part"), lo, up, ["p_size"])) >> tm.tf_mutate(z=X.p_size) >> tm.tf_select("p_partkey", "z")


@query("SELECT p_partkey, round(p_size, 6)::DOUBLE AS z FROM part")
def standardize_restore(t: Tables):
    lo, up = ft.column_ranges(t("part"), ["p_size"])
    back = ft.restore_cols(ft.standardize_cols(t("part"), lo, up, ["p_size"]), lo, up, ["p_size"])
    return tm.as_table(back) >> tm.tf_mutate(z=tm.round(X.p_size, 6)) >> tm.tf_select("p_partkey", "z")


@query()
def contour_segments(t: Tables):
    md = cp.comp_vec_function(Model(), lambda v: {"f": v.x * v.x + v.y * v.y}, var=["x", "y"], out=["f"])
    return ev.eval_contour(cp.comp_bounds(md, x=(-1, 1), y=(-1, 1)), var=("x", "y"), levels=[0.25, 0.5], n_side=20)


@query("SELECT level, true AS near FROM (VALUES (0.25::DOUBLE), (0.5)) v(level)")
def contour_on_circle(t: Tables):
    """The segments' ends lie on the circles, up to the grid."""
    out = tm.as_table(contour_segments(t)) >> tm.tf_mutate(e=tm.abs(X.x_start**2 + X.y_start**2 - X.level))
    return out >> tm.tf_group_by("level") >> tm.tf_summarize(near=tm.max(X.e) < 0.01)


@query("SELECT p_partkey, NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND b.p_partkey % 50 <= a.p_partkey % 50 AND b.p_partkey <> a.p_partkey) AS optimal FROM part a")
def pareto_front(t: Tables):
    return t("part") >> tm.tf_mutate(k=X.p_partkey % 50) >> pareto.tf_pareto("p_size", "p_retailprice", "k") >> tm.tf_select("p_partkey", "optimal")


@query("SELECT stratum, n FROM (VALUES (1.0::DOUBLE, 2::BIGINT), (2.0, 3), (3.0, 2), (4.0, 1)) v(stratum, n)")
def pareto_strata(t: Tables):
    df = tm.df_make(x=[1, 2, 0, 1, 2, 0, 1, 2], y=[0, 0, 1, 1, 1, 2, 2, 2])
    return df.transform(lambda d: (tm.as_table(d) >> pareto.tf_stratum("x", "y") >> tm.tf_count("stratum")).df)


@query("SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey <= s.s_nationkey AND c.c_acctbal <= s.s_acctbal) AS optimal FROM supplier s".replace("SELECT s_suppkey, ", "SELECT s_nationkey::DOUBLE AS k, s_acctbal AS b, "))
def pareto_relative(t: Tables):
    test = t("supplier") >> tm.tf_mutate(k=tm.as_float(X.s_nationkey), b=X.s_acctbal) >> tm.tf_select("k", "b")
    base = t("customer") >> tm.tf_mutate(k=tm.as_float(X.c_nationkey), b=X.c_acctbal) >> tm.tf_select("k", "b")
    return ev.pareto_min_rel(test, base)


@query()
def pareto_probability(t: Tables):
    train = t("part") >> tm.tf_mutate(a=X.p_size / 50.0, b=X.p_retailprice / 2000) >> tm.tf_select("a", "b")
    test = t("part") >> tm.tf_mutate(u=X.p_size / 50.0, v=X.p_retailprice / 2000) >> tm.tf_select("u", "v")
    md = cp.comp_vec_function(Model(), lambda x: {"a_mean": x.u, "b_mean": x.v, "a_sd": 0.05 + 0 * x.u, "b_sd": 0.05 + 0 * x.v}, var=["u", "v"], out=["a_mean", "b_mean", "a_sd", "b_sd"])
    return ev.eval_pnd(md, train, test, signs={"a": 1, "b": 1}, n=2000)


@query("SELECT round(avg(l_quantity), 8) AS loc, round(stddev_pop(l_quantity), 8) AS scale FROM lineitem")
def marginal_fit(t: Tables):
    m = marg_fit("norm", t("lineitem"), "l_quantity")
    return tm.df_make(loc=round(m.d_param["loc"], 8), scale=round(m.d_param["scale"], 8))


@query("SELECT c_custkey, round(1 - exp(-(c_acctbal + 1000) / 5000), 9) AS p, round(exp(-(c_acctbal + 1000) / 5000) / 5000, 12) AS d FROM customer")
def marginal_functions(t: Tables):
    from tidymesh.expr import scalar

    m = marg_named("expon", loc=-1000, scale=5000)
    return t("customer") >> tm.tf_mutate(p=tm.round(scalar(m.p)(X.c_acctbal), 9), d=tm.round(scalar(m.d)(X.c_acctbal), 12)) >> tm.tf_select("c_custkey", "p", "d")


@query("SELECT count(*) AS n, 0::BIGINT AS wrong FROM part")
def marginal_round_trips(t: Tables):
    """q(p(x)) and p(q(u)) of each law, truncated and by moments too."""
    from pyspark.sql import functions as F

    laws = [marg_named("norm", loc=1, scale=2), marg_named("uniform", loc=-1, scale=3), marg_named("lognorm", s=0.5, scale=2), marg_named("weibull_min", c=1.5, scale=2), marg_named("logistic"), marg_named("pareto", b=3), marg_named("triang", c=0.3),
            marg_named("gumbel_r"), marg_named("gumbel_l"), marg_named("cauchy"), marg_named("laplace"), marg_named("rayleigh", scale=2), marg_named("powerlaw", a=2.5), marg_mom("weibull_min", mean=3, sd=1), marg_trunc(marg_named("norm"), lo=-1, up=2)]
    df = t("part").df.select(((F.col("p_partkey") % 997 + 0.5) / 998).alias("u"))
    df = df.withColumns({f"q{i}": m.q(F.col("u")) for i, m in enumerate(laws)})
    df = df.withColumns({f"p{i}": m.p(F.col(f"q{i}")) for i, m in enumerate(laws)})
    bad = sum(((F.abs(F.col(f"p{i}") - F.col("u")) > 1e-9).cast("int") for i in range(len(laws))), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("wrong"))


@query("SELECT true AS near FROM range(1)")
def marginal_kernel(t: Tables):
    m = marg_gkde(t("supplier"), "s_acctbal")
    return tm.df_make(near=[bool(abs(float(m.p(m.q(0.3))) - 0.3) < 0.01)])


@query("SELECT a.var, a.out, round(CASE WHEN a.out = 'l_tax' THEN corr(x, l_tax) ELSE corr(x, l_extendedprice) END, 8) AS rho FROM (SELECT 'l_quantity' AS var, unnest(['l_tax', 'l_extendedprice']) AS out) a, (SELECT l_quantity AS x, l_tax, l_extendedprice FROM lineitem) GROUP BY 1, 2")
def input_output_correlation(t: Tables):
    return t("lineitem") >> st.tf_iocorr(var=["l_quantity"], out=["l_tax", "l_extendedprice"]) >> tm.tf_mutate(rho=tm.round(X.rho, 8))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + 2 * l_tax, 8) AS dot0, round(l_quantity - l_tax, 8) AS dot1 FROM lineitem")
def inner_products(t: Tables):
    w = tm.df_make(l_quantity=[1.0, 1.0], l_tax=[2.0, -1.0])
    return t("lineitem") >> st.tf_inner(w) >> tm.tf_mutate(dot0=tm.round(X.dot0, 8), dot1=tm.round(X.dot1, 8)) >> tm.tf_select("l_orderkey", "l_linenumber", "dot0", "dot1")


@query("""WITH c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax * 100) AS b, var_samp(l_tax * 100) AS d, count(*) AS n FROM lineitem),
    e AS (SELECT n, unnest([(a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b), (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b)]) AS l FROM c) SELECT round(sqrt(l * (n - 1)), 4) AS lam FROM e""")
def principal_components(t: Tables):
    return t("lineitem") >> tm.tf_mutate(tax=X.l_tax * 100) >> st.tf_pca(var=["l_quantity", "tax"]) >> tm.tf_mutate(lam=tm.round(X.lam, 4)) >> tm.tf_select("lam")


@query("SELECT 'y' AS out, lam FROM (VALUES (1.0::DOUBLE), (0.0)) v(lam)")
def active_subspace(t: Tables):
    grads = t("region") >> tm.tf_mutate(Dy_Da=1 / math.sqrt(2), Dy_Db=1 / math.sqrt(2)) >> tm.tf_select("Dy_Da", "Dy_Db")
    return grads >> st.tf_asub() >> tm.tf_mutate(lam=tm.abs(tm.round(X.lam, 6))) >> tm.tf_select("out", "lam")


@query("SELECT round(acos(sum(l_quantity * l_extendedprice) / sqrt(sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice))), 6) AS angle FROM lineitem")
def subspace_angles(t: Tables):
    """Of two columns of the whole table."""
    a, b = (t("lineitem", "l_orderkey", "l_linenumber") >> tm.tf_select(c) for c in ("l_quantity", "l_extendedprice"))
    return st.tran_angles(a, b) >> tm.tf_mutate(angle=tm.round(X.angle, 6))


_COHORTS = ["", "PARTITION BY a", "PARTITION BY b", "PARTITION BY c", "PARTITION BY a, b", "PARTITION BY a, c", "PARTITION BY b, c", "PARTITION BY a, b, c"]


@query(f"""WITH v AS (SELECT p_partkey, least(floor((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) * 5), 4) AS a,
        least(floor((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 5), 4) AS b, p_partkey % 5 AS c, p_size * p_retailprice / 1000 + p_partkey % 5 AS y FROM part),
    m AS (SELECT p_partkey, {", ".join(f"avg(y) OVER ({c}) AS m{i}" for i, c in enumerate(_COHORTS))} FROM v)
    SELECT p_partkey, round((m1 - m0) / 3 + (m4 - m2) / 6 + (m5 - m3) / 6 + (m7 - m6) / 3, 6) AS y_p_size, round((m2 - m0) / 3 + (m4 - m1) / 6 + (m6 - m3) / 6 + (m7 - m5) / 3, 6) AS y_p_retailprice,
        round((m3 - m0) / 3 + (m5 - m1) / 6 + (m6 - m2) / 6 + (m7 - m4) / 3, 6) AS y_k FROM m""")
def shapley_values(t: Tables):
    """Of all parts; the SQL takes the mean of each row's cohort for each set of inputs."""
    data = t("part") >> tm.tf_mutate(k=X.p_partkey % 5) >> tm.tf_mutate(y=X.p_size * X.p_retailprice / 1000 + X.k)
    out = data >> st.tf_shapley_cohort(var=["p_size", "p_retailprice", "k"], out=["y"], bins=5)
    return out >> tm.tf_mutate(y_p_size=tm.round(X.y_p_size, 6), y_p_retailprice=tm.round(X.y_p_retailprice, 6), y_k=tm.round(X.y_k, 6)) >> tm.tf_select("p_partkey", "y_p_size", "y_p_retailprice", "y_k")


@query("SELECT p_partkey, round(exp(-x * x / 2 / 0.8) / sqrt(0.8) / exp(-x * x / 2), 8) AS weight FROM (SELECT p_partkey, p_size / 25.0 - 1 AS x FROM part)")
def importance_weights(t: Tables):
    md = lambda s: cp.comp_copula_independence(cp.comp_marginals(Model(), x=marg_named("norm", scale=s)))
    data = t("part") >> tm.tf_mutate(x=X.p_size / 25.0 - 1)
    return data >> st.tf_reweight(md(1.0), md(math.sqrt(0.8))) >> tm.tf_mutate(weight=tm.round(X.weight, 8)) >> tm.tf_select("p_partkey", "weight")


@query("SELECT 'a' AS var1, 'b' AS var2, true AS near FROM range(1)")
def copula_correlation(t: Tables):
    md = cp.comp_marginals(Model(), a=marg_named("norm"), b=marg_named("uniform"))
    pairs = t.spark.createDataFrame([("a", "b", 0.6)], "var1 string, var2 string, corr double")
    md = cp.comp_copula_gaussian(md, df_corr=pairs)
    return st.tran_copula_corr(ev.eval_sample(md, n=4000, seed=1, skip=True), model=md) >> tm.tf_mutate(near=tm.abs(X["corr"] - 0.6) < 0.03) >> tm.tf_select("var1", "var2", "near")


@query("""WITH f AS (SELECT *, p_partkey % 4 AS k FROM part), r AS (SELECT a.k, regr_slope(b.p_retailprice, b.p_size) AS s, regr_intercept(b.p_retailprice, b.p_size) AS i FROM (SELECT DISTINCT k FROM f) a JOIN f b ON a.k <> b.k GROUP BY 1)
    SELECT f.k::VARCHAR AS _kfold, round(avg((i + s * p_size - p_retailprice) ** 2), 2) AS mse_p_retailprice FROM f JOIN r ON f.k = r.k GROUP BY 1""")
def cross_validation(t: Tables):
    data = t("part") >> tm.tf_mutate(k=X.p_partkey % 4) >> tm.tf_select("p_size", "p_retailprice", "k")
    out = st.tran_kfolds(data, ft=lambda d: ft.fit_lm(d, var=["p_size"], out=["p_retailprice"]), out=["p_retailprice"], var_fold="k", summaries={"mse": tm.mse})
    return out >> tm.tf_mutate(mse_p_retailprice=tm.round(X.mse_p_retailprice, 2))


@query("SELECT round(avg(p_size), 8) AS m, true AS inside, true AS as_wide FROM part")
def bootstrap_interval(t: Tables):
    """The mean of all parts, and whether the interval is around it and about as wide as the normal law has it."""
    data = t("part") >> tm.tf_select("p_size")
    out = st.tran_bootstrap(data, tran=lambda d: tm.tran_summarize(d, m=tm.mean(X.p_size)), n_boot=60, n_sub=8)
    half = data >> tm.tf_summarize(h=1.645 * tm.sd(X.p_size) / tm.sqrt(tm.n()))
    both = tm.as_table(out.df.crossJoin(F.broadcast(half.df)))  # a row each
    return both >> tm.tf_mutate(inside=(X.m_lo < X.m) & (X.m < X.m_up), as_wide=tm.abs((X.m_up - X.m_lo) / (2 * X.h) - 1) < 0.6) >> tm.tf_mutate(m=tm.round(X.m, 8)) >> tm.tf_select("m", "inside", "as_wide")


@query("SELECT 10::BIGINT AS n FROM range(1)")
def support_points(t: Tables):
    return st.tran_sp(t("supplier") >> tm.tf_select("s_acctbal", "s_nationkey"), n=10, n_maxiter=8) >> tm.tf_summarize(n=tm.n())


@query("SELECT round(1 / sqrt(1 + 4 * (max(bb) - min(bb)) ** 2 / (max(aa) - min(aa)) ** 2), 4) AS a, round(2 * (max(bb) - min(bb)) / (max(aa) - min(aa)) / sqrt(1 + 4 * (max(bb) - min(bb)) ** 2 / (max(aa) - min(aa)) ** 2), 4) AS b FROM (SELECT p_size / 10.0 AS aa, (p_partkey % 17) / 5.0 AS bb FROM part)")
def ridge_transform(t: Tables):
    """The direction that the output was made along, in inputs brought to -1 to 1."""
    data = t("part") >> tm.tf_mutate(a=X.p_size / 10.0, b=(X.p_partkey % 17) / 5.0) >> tm.tf_mutate(y=tm.pow(X.a + 2 * X.b, 2))
    return st.tran_polyridge(data, var=["a", "b"], out="y", n_dim=1, n_degree=2) >> tm.tf_mutate(a=tm.round(X.a, 4), b=tm.round(X.b, 4))


@query("SELECT s_suppkey, true AS placed FROM supplier")
def embedding(t: Tables):
    """Every supplier gets a place."""
    out = st.tran_tsne(t("supplier"), var=["s_acctbal", "s_nationkey"], rows=60, n_iter=50, append=True)
    return out >> tm.tf_mutate(placed=tm.not_nan(X.xi0) & tm.not_nan(X.xi1)) >> tm.tf_select("s_suppkey", "placed")


@query("SELECT 'H2O' AS formula, 2::INTEGER AS n_elements FROM range(1)")
def composition_features(t: Tables):
    return tm.as_table(tm.df_make(formula="H2O")) >> st.tf_feat_composition("formula") >> tm.tf_select("formula", "n_elements")


@query()
def metamodel(t: Tables):
    md = cp.comp_metamodel(square(), n=200, seed=1)
    return ev.eval_df(md, ev.eval_sample(square(), n=50, seed=2, skip=True))


@query("SELECT 3000::BIGINT AS n, true AS near FROM range(1)")
def model_random_nested(t: Tables):
    inner = cp.comp_vec_function(Model("noise"), lambda x: {"e": 1.0 * x.u}, var=["u"], out=["e"])
    inner = cp.comp_copula_independence(cp.comp_marginals(inner, u=marg_named("norm", loc=0, scale=1)))
    md = cp.comp_md_sample(Model(), inner, param={"u": ["loc"]}, seed=4)
    rows = t.spark.range(3000).selectExpr("CAST(5 AS DOUBLE) AS u_loc")
    return md.apply(rows).transform(lambda d: (tm.as_table(d) >> tm.tf_summarize(n=tm.n(), near=tm.abs(tm.mean(X.e) - 5) < 0.1)).df)


@query("SELECT '(var)' AS source, 'area' AS target, 'w' AS variable UNION ALL SELECT '(var)', 'area', 't' UNION ALL SELECT 'area', '(out)', 'c'")
def model_graph(t: Tables):
    return cp.comp_vec_function(Model(), lambda x: {"c": x.w * x.t}, var=["w", "t"], out=["c"], name="area").dag(t.spark)


# process control


@query("SELECT * FROM (VALUES (2, 0.7979::DOUBLE, 0.0::DOUBLE, 3.267::DOUBLE), (5, 0.94, 0.0, 2.089), (6, 0.9515, 0.03, 1.97), (10, 0.9727, 0.284, 1.716)) v(n, c4, b3, b4)")
def control_constants(t: Tables):
    rows = [(n, round(spc.c_sd(n), 4), round(spc.B3(n), 3), round(spc.B4(n), 3)) for n in (2, 5, 6, 10)]
    return t.spark.createDataFrame(rows, "n int, c4 double, b3 double, b4 double")


@query("""WITH s AS (SELECT user_id, avg(value) AS x, stddev_samp(value) AS s FROM events GROUP BY 1), l AS (SELECT user_id, 'X' AS _var, x AS _value FROM s UNION ALL SELECT user_id, 'S', s FROM s)
    SELECT user_id, _var, round(_value, 6) AS _value, round(avg(_value) OVER (PARTITION BY _var), 6) AS _center FROM l""")
def control_chart(t: Tables):
    return t("events") >> spc.tf_xbs("user_id", "value") >> tm.tf_mutate(_value=tm.round(X["_value"], 6), _center=tm.round(X["_center"], 6)) >> tm.tf_select("user_id", "_var", "_value", "_center")


@query("""WITH s AS (SELECT user_id, avg(value) AS x, stddev_samp(value) AS s, count(value)::DOUBLE AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1),
    c AS (SELECT *, sqrt(2 / (mn - 1)) * exp(lgamma(mn / 2) - lgamma((mn - 1) / 2)) AS c4 FROM (SELECT avg(x) AS mx, avg(s) AS ms, avg(n) AS mn FROM s)),
    l AS (SELECT user_id, 'X' AS _var, x AS _value, mx AS _center, mx - 3 * ms / (c4 * sqrt(mn)) AS _lo, mx + 3 * ms / (c4 * sqrt(mn)) AS _up FROM s, c
        UNION ALL SELECT user_id, 'S', s, ms, ms * greatest(1 - 3 / c4 * sqrt(1 - c4 * c4), 0), ms * (1 + 3 / c4 * sqrt(1 - c4 * c4)) FROM s, c),
    d AS (SELECT *, sign(_value - _center) AS side, sign(_value - lag(_value) OVER (PARTITION BY _var ORDER BY user_id)) AS rise FROM l),
    r AS (SELECT *, coalesce((side <> lag(side) OVER o)::INT, 1) AS a, coalesce((rise <> lag(rise) OVER o)::INT, 1) AS b FROM d WINDOW o AS (PARTITION BY _var ORDER BY user_id)),
    q AS (SELECT *, sum(a) OVER o AS ra, sum(b) OVER o AS rb FROM r WINDOW o AS (PARTITION BY _var ORDER BY user_id)),
    z AS (SELECT *, count(*) OVER (PARTITION BY _var, ra) AS na, count(*) OVER (PARTITION BY _var, rb) AS nb FROM q)
    SELECT user_id, _var, round(_lo, 6) AS _lo, round(_up, 6) AS _up, _value < _lo OR _value > _up AS _outlier, coalesce(na >= 9 AND side <> 0, false) AS _run, coalesce(nb >= 5 AND rise <> 0, false) AS _trend,
        CASE WHEN _value > _up THEN 'Above Limit' WHEN _value < _lo THEN 'Below Limit' WHEN coalesce(na >= 9 AND side <> 0, false) THEN '9 Consecutive Same Side' WHEN coalesce(nb >= 5 AND rise <> 0, false) THEN '6 Consecutive Trend' ELSE 'None' END AS _glyph FROM z""")
def control_chart_flags(t: Tables):
    """Limits, runs and trends of every group."""
    out = t("events") >> spc.tf_xbs("user_id", "value") >> tm.tf_mutate(_lo=tm.round(X["_lo"], 6), _up=tm.round(X["_up"], 6))
    return out >> tm.tf_select("user_id", "_var", "_lo", "_up", "_outlier", "_run", "_trend", "_glyph")


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS up FROM lineitem) SELECT 'l_quantity' AS out, least(floor((l_quantity - lo) / ((up - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def chart_histogram(t: Tables):
    return t("lineitem") >> charts.pt_hists(out=["l_quantity"], bins=10) >> tm.tf_select("out", "bin", "n")


@query("SELECT 'l_quantity' AS x, 'l_tax' AS y, round(corr(l_quantity, l_tax), 8) AS fill FROM lineitem")
def chart_tiles(t: Tables):
    out = t("lineitem") >> st.tf_iocorr(var=["l_quantity"], out=["l_tax"]) >> charts.pt_corrtile()
    return out >> tm.tf_mutate(fill=tm.round(X.fill, 8)) >> tm.tf_select("x", "y", "fill")


@query("SELECT count(*) AS n FROM range(360)")
def chart_sweeps(t: Tables):
    out = ev.eval_sinews(beam(), n_density=10, n_sweeps=3, df_det="swp", seed=1) >> charts.pt_sinew_outputs(var=["w", "t", "H", "V", "E", "Y"], out=["g_stress", "g_disp"])
    return out >> tm.tf_summarize(n=tm.n())


@query("SELECT count(*) * 2 AS n FROM supplier")
def chart_scatter_matrix(t: Tables):
    return t("supplier") >> charts.pt_auto(kind="scattermat", var=["s_acctbal", "s_nationkey"]) >> tm.tf_summarize(n=tm.n())


@query("SELECT count(*) AS n FROM range(4)")
def chart_sobol(t: Tables):
    out = st.tran_sobol(ev.eval_hybrid(square(), n=100, seed=2)) >> charts.pt_sobol_outputs()
    return out >> tm.tf_summarize(n=tm.n())
