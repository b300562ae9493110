"""Queries of the ready models, of laws on special functions, and of fits by scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymesh import verbs as tm
from tidymesh.catalog.registry import Tables, query
from tidymesh.models import evaluate as ev
from tidymesh.models import library as lib
from tidymesh.models.marginals import marg_fit, marg_named
from tidymesh.table import Table
from tidymesh.verbs import X

_GAMMA_SQL = "list_sum(list_transform(range(0, 200), lambda n: exp((n + {a}) * ln({x}) - {x} - lgamma(n + {a} + 1))))"
_BETA_SQL = "exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * (1 + list_sum(list_transform(range(0, 400), lambda n: exp(lgamma({a} + 1) + lgamma(n + {a} + {b} + 1) - lgamma({a} + {b}) - lgamma(n + {a} + 2) + (n + 1) * ln({x})))))"


@query(f"""WITH v AS (SELECT p_partkey, (p_size - 0.5) / 50 AS z FROM part)
    SELECT p_partkey, round({_GAMMA_SQL.format(a="2.4", x="(3 * z)")}, 8) AS gamma_p, round(3 * z, 7) AS gamma_q, round(exp(1.4 * ln(3 * z) - 3 * z - lgamma(2.4)), 8) AS gamma_d,
    round({_BETA_SQL.format(a="2.3", b="0.7", x="(0.8 * z)")}, 8) AS beta_p, round(0.8 * z, 7) AS beta_q,
    round({_GAMMA_SQL.format(a="2.25", x="(4 * z)")}, 8) AS chi2_p, round(8 * z, 7) AS chi2_q,
    round({_BETA_SQL.format(a="2.5", b="3.5", x="(10 * z / (10 * z + 7))")}, 8) AS f_p, round(2 * z, 7) AS f_q,
    round(0.5 + 0.375 * (4 * z - 2) / sqrt(1 + (4 * z - 2) ** 2 / 4) * (1 - (4 * z - 2) ** 2 / 12 / (1 + (4 * z - 2) ** 2 / 4)), 8) AS t_p, round(4 * z - 2, 7) AS t_q,
    round(0.375 * (1 + (4 * z - 2) ** 2 / 4) ** -2.5, 8) AS t_d FROM v""")
def marginal_laws(t: Tables):
    """Distribution functions against series, and quantiles of them against the value that they came from."""
    z = (X.p_size - 0.5) / 50
    laws = {
        "gamma": (marg_named("gamma", a=2.4), 3 * z), "beta": (marg_named("beta", a=2.3, b=0.7), 0.8 * z), "chi2": (marg_named("chi2", df=4.5), 8 * z),
        "f": (marg_named("f", dfn=5, dfd=7), 2 * z), "t": (marg_named("t", df=4), 4 * z - 2),
    }
    out = t("part") >> tm.tf_mutate(**{f"x_{k}": x for k, (_, x) in laws.items()})
    df = out.df.withColumns({f"{k}_p": m.p(F.col(f"x_{k}")) for k, (m, _) in laws.items()})
    df = df.withColumns({f"{k}_q": m.q(F.col(f"{k}_p")) for k, (m, _) in laws.items()} | {f"{k}_d": laws[k][0].d(F.col(f"x_{k}")) for k in ("gamma", "t")})
    return Table(df.select("p_partkey", *(F.round(f"{k}_p", 8).alias(f"{k}_p") for k in laws), *(F.round(f"{k}_q", 7).alias(f"{k}_q") for k in laws), *(F.round(f"{k}_d", 8).alias(f"{k}_d") for k in ("gamma", "t"))))


def _weibull_sql(rounds: int) -> str:
    """Newton's rounds for the shape, each over the whole table."""
    out = ["c0 AS (SELECT 1.5::DOUBLE AS c)"]
    for k in range(rounds):
        sums = f"SELECT any_value(c) AS c, sum(y ** c) AS s0, sum(y ** c * ln(y)) AS s1, sum(y ** c * ln(y) ** 2) AS s2, avg(ln(y)) AS m FROM v, c{k}"
        out.append(f"c{k + 1} AS (SELECT c - (s1 / s0 - 1 / c - m) / ((s2 * s0 - s1 * s1) / (s0 * s0) + 1 / (c * c)) AS c FROM ({sums}))")
    return ", ".join(out)


@query(f"""WITH RECURSIVE v AS (SELECT l_extendedprice / (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem), {_weibull_sql(9)},
    g AS (SELECT avg(l_extendedprice) AS m, ln(avg(l_extendedprice)) - avg(ln(l_extendedprice)) AS s FROM lineitem),
    a AS (
        SELECT 0 AS k, 2.0::DOUBLE AS a UNION ALL
        SELECT k + 1, a - (ln(a) - (ln(a + 8) - 1 / (2 * (a + 8)) - 1 / (12 * (a + 8) ** 2) + 1 / (120 * (a + 8) ** 4) - list_sum(list_transform(range(0, 8), lambda j: 1 / (a + j)))) - (SELECT s FROM g))
            / (1 / a - (1 / (a + 8) + 1 / (2 * (a + 8) ** 2) + 1 / (6 * (a + 8) ** 3) - 1 / (30 * (a + 8) ** 5) + list_sum(list_transform(range(0, 8), lambda j: 1 / (a + j) ** 2)))) FROM a WHERE k < 12
    )
    SELECT 'gamma' AS law, round(a, 3) AS shape, round(m / a, 0) AS scale FROM a, g WHERE k = 12
    UNION ALL SELECT 'weibull_min', round(c, 3), round(((SELECT avg(y ** c) FROM v) ** (1 / c)) * (SELECT m FROM g), 0) FROM c9""")
def marginal_scoring(t: Tables):
    """Fits of greatest likelihood without sufficient statistics, against Newton's rounds on the likelihood equations."""
    fits = [(name, marg_fit(name, t("lineitem"), "l_extendedprice").d_param, shape) for name, shape in (("gamma", "a"), ("weibull_min", "c"))]
    rows = [(name, round(p[shape], 3), float(round(p["scale"]))) for name, p, shape in fits]
    return t.spark.createDataFrame(rows, "law string, shape double, scale double")


_SIR_STEPS = 16
_SIR_SQL = """WITH RECURSIVE s AS (SELECT s_suppkey, s_nationkey AS k, s_suppkey % 100 AS t, 1 + s_nationkey % 10 AS i0, 0.1 + s_nationkey / 60.0 AS b, 0.1 + (s_nationkey % 5) / 20.0 AS g FROM supplier),
    p AS (SELECT DISTINCT k, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(i0 AS DOUBLE) AS i0 FROM s),
    r AS (
        SELECT k, b, g, 0 AS n, 100 - i0 AS S, i0 AS I FROM p UNION ALL
        SELECT k, b, g, n + 1, S + h / 6 * (ds1 + 2 * ds2 + 2 * ds3 - b * (I + h * di3) * (S + h * ds3) / 100), I + h / 6 * (di1 + 2 * di2 + 2 * di3 + b * (I + h * di3) * (S + h * ds3) / 100 - g * (I + h * di3)) FROM (
            SELECT *, -b * (I + h / 2 * di2) * (S + h / 2 * ds2) / 100 AS ds3, b * (I + h / 2 * di2) * (S + h / 2 * ds2) / 100 - g * (I + h / 2 * di2) AS di3 FROM (
                SELECT *, -b * (I + h / 2 * di1) * (S + h / 2 * ds1) / 100 AS ds2, b * (I + h / 2 * di1) * (S + h / 2 * ds1) / 100 - g * (I + h / 2 * di1) AS di2 FROM (
                    SELECT *, -b * I * S / 100 AS ds1, b * I * S / 100 - g * I AS di1, 1.0 / 16 AS h FROM r WHERE n < 1600)))
    )
    SELECT s_suppkey, round(S, 3) AS S, round(I, 3) AS I, round(100 - S - I, 3) AS R FROM s JOIN r ON s.k = r.k AND r.n = 16 * s.t"""


@query(_SIR_SQL)
def model_sir(t: Tables):
    """An epidemic for each nation's parameters, at a time for each supplier; the SQL goes in small fixed steps."""
    rows = t("supplier") >> tm.tf_mutate(t=X.s_suppkey % 100, N=100.0, I0=1 + X.s_nationkey % 10, beta=0.1 + X.s_nationkey / 60, gamma=0.1 + (X.s_nationkey % 5) / 20)
    out = ev.eval_df(lib.make_sir(rtol=1e-9, atol=1e-11), rows)
    return out >> tm.tf_mutate(S=tm.round(X.S, 3), I=tm.round(X.I, 3), R=tm.round(X.R, 3)) >> tm.tf_select("s_suppkey", "S", "I", "R")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, 1 + l_tax AS rho, 0.0001 + l_discount * l_discount AS u, 1.3 + l_quantity / 200 AS d, 1.2e-5 AS mu, 0.05 + l_quantity / 1000 AS eps FROM lineitem),
    r AS (SELECT *, rho * u * d / mu AS re FROM v)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN re < 3000 THEN 64 / re
        ELSE 1 / list_reduce(list_prepend(8.0::DOUBLE, CAST(range(0, 60) AS DOUBLE[])), lambda x, k: -2 * log10(eps / 3.6 / d + 2.51 * x / re)) ** 2 END, 7) AS f FROM r""")
def model_pipe_friction(t: Tables):
    """The root by halving a bracket, against the fixed point of the same equation."""
    rows = t("lineitem") >> tm.tf_mutate(rho=1 + X.l_tax, u=0.0001 + X.l_discount * X.l_discount, d=1.3 + X.l_quantity / 200, mu=1.2e-5, eps=0.05 + X.l_quantity / 1000)
    return ev.eval_df(lib.make_pipe_friction(), rows) >> tm.tf_mutate(f=tm.round(X.f, 7)) >> tm.tf_select("l_orderkey", "l_linenumber", "f")


@query("""WITH v AS (SELECT p_partkey, (p_size - 25) / 20.0 AS a, 0.001 + p_size / 1e6 AS t, 1e6 + p_retailprice AS n FROM part)
    SELECT p_partkey, round(1 - n / t * cos(a) ** 2 / 1.4e9, 6) AS g_11_tension, round(1 - n / t * sin(a) ** 2 / 1.4e6, 4) AS g_22_tension, round(1 + n / t * cos(a) ** 2 / 0.5e9, 6) AS g_11_compression,
    round(1 + n / t * sin(a) ** 2 / 0.5e6, 4) AS g_22_compression, round(1 - abs(n / t * sin(a) * cos(a)) / 62e6, 5) AS g_12_shear FROM v""")
def model_laminate(t: Tables):
    """One ply carries the whole load, so its stresses are the load's, turned."""
    rows = t("part") >> tm.tf_mutate(
        E1_0=114e9, E2_0=7e9, nu12_0=0.45, G12_0=4e9, theta_0=(X.p_size - 25) / 20, t_0=0.001 + X.p_size / 1e6, sigma_11_t_0=1.4e9, sigma_22_t_0=1.4e6, sigma_11_c_0=0.5e9, sigma_22_c_0=0.5e6, sigma_12_s_0=62e6,
        Nx=1e6 + X.p_retailprice,
    )
    out = ev.eval_df(lib.make_composite_plate_tension([0.0]), rows >> tm.tf_select("p_partkey", "Nx", tm.ends_with("_0")))
    digits = dict(zip(lib.LIMITS, (6, 4, 6, 4, 5)))
    return out >> tm.tf_mutate(**{k: tm.round(X[f"{k}_0"], n) for k, n in digits.items()}) >> tm.tf_select("p_partkey", *lib.LIMITS)


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, 30 + l_quantity / 2 AS m, 0.005 + l_discount / 10 AS s, 0.002 + l_tax / 10 AS v_0, 1000 + l_quantity * 50 AS k, 90000 + l_quantity * 100 AS p_0, 290 + l_tax * 50 AS t_a, 340 + l_discount * 100 AS t_0 FROM lineitem),
    a AS (SELECT *, p_0 * s + 19.62 * m - k * v_0 / s AS a FROM v), b AS (SELECT *, s / (2 * k) * (sqrt(a * a + 4 * k * p_0 * v_0 / t_0 * t_a) - a) AS v FROM a)
    SELECT l_orderkey, l_linenumber, round(2 * pi() * sqrt(m / (k + s * s * p_0 * v_0 / t_0 * t_a / (v * v))), 6) AS t_cyc FROM b""")
def model_piston(t: Tables):
    rows = t("lineitem") >> tm.tf_mutate(m=30 + X.l_quantity / 2, s=0.005 + X.l_discount / 10, v_0=0.002 + X.l_tax / 10, k=1000 + X.l_quantity * 50, p_0=90000 + X.l_quantity * 100, t_a=290 + X.l_tax * 50, t_0=340 + X.l_discount * 100)
    return ev.eval_df(lib.make_piston(), rows) >> tm.tf_mutate(t_cyc=tm.round(X.t_cyc, 6)) >> tm.tf_select("l_orderkey", "l_linenumber", "t_cyc")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, (0.01 + l_tax) * (1 + l_discount / 2) AS rr, (1e-6 + l_quantity / 1e6) * (1 - l_tax) AS lr, (0.1 + l_quantity) * (1 + l_discount) AS cr FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(sqrt(1 / lr / cr), 4) AS omega0, round(sqrt(1 / lr / cr) * rr * cr, 4) AS Q FROM v""")
def model_circuit(t: Tables):
    rows = t("lineitem") >> tm.tf_mutate(R=0.01 + X.l_tax, L=1e-6 + X.l_quantity / 1e6, C=0.1 + X.l_quantity, dR=X.l_discount / 2, dL=-X.l_tax, dC=X.l_discount)
    return ev.eval_df(lib.make_prlc_rand(), rows) >> tm.tf_mutate(omega0=tm.round(X.omega0, 4), Q=tm.round(X.Q, 4)) >> tm.tf_select("l_orderkey", "l_linenumber", "omega0", "Q")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS xi, 0.04 AS H, 0.16 AS L, 1 + l_tax * 10 AS U, 1.45e-5 AS nu, 100 + l_quantity * 10 AS cpp, 1000 + l_discount * 1000 AS cpf, 7e-5 AS al, 2e3 AS rp, 1.0 AS rf, 5e-6 AS dp, 1e10 AS n, 5e3 AS hp, 300 AS T0, 0.5 AS qa, 1e7 AS i0 FROM lineitem),
    a AS (SELECT *, U * H / nu AS re, nu / al AS pr, cpp / cpf AS chi, rp * 0.524 * dp ** 3 * n / rf AS pm, L / U AS tf, rp * cpp * 0.318 * dp / hp AS tp, rp * cpp * 0.667 * dp * T0 / (qa * 0.78 * i0) AS tr FROM v),
    b AS (SELECT *, xi * L / H / re / pr AS xst, re * pr * (H / L) * (tf / tr) AS i, re * pr * (H / L) * (tf / tp) * (1 + pm * chi) AS beta FROM a)
    SELECT l_orderkey, l_linenumber, round(pm * chi / (1 + pm * chi) * (i * xst - i / beta * (1 - exp(-beta * xst))), 6) AS T_f, round(1 / (1 + pm * chi) * (pm * chi * i * xst + i / beta * (1 - exp(-beta * xst))), 6) AS T_p FROM b""")
def model_channel(t: Tables):
    rows = t("lineitem") >> tm.tf_mutate(
        xi=X.l_quantity / 50, H=0.04, L=0.16, U=1 + X.l_tax * 10, nu_f=1.45e-5, cp_p=100 + X.l_quantity * 10, cp_f=1000 + X.l_discount * 1000, alpha_f=7e-5, rho_p=2e3, rho_f=1.0, d_p=5e-6, n=1e10, h_p=5e3, T_0=300.0, Q_abs=0.5, I_0=1e7
    )
    return ev.eval_df(lib.make_channel(), rows) >> tm.tf_mutate(T_f=tm.round(X.T_f, 6), T_p=tm.round(X.T_p, 6)) >> tm.tf_select("l_orderkey", "l_linenumber", "T_f", "T_p")


@query("""SELECT l_orderkey, l_linenumber, round(tau * u0 * (1 - exp(-t / tau)), 5) AS x, round(tau * (v0 + 9.8 * tau) * (1 - exp(-t / tau)) - 9.8 * tau * t, 4) AS y
    FROM (SELECT l_orderkey, l_linenumber, 1 + l_quantity AS u0, 5 + l_tax * 100 AS v0, 0.5 + l_discount AS tau, l_quantity / 10 AS t FROM lineitem)""")
def model_trajectory(t: Tables):
    rows = t("lineitem") >> tm.tf_mutate(u0=1 + X.l_quantity, v0=5 + X.l_tax * 100, tau=0.5 + X.l_discount, t=X.l_quantity / 10)
    return ev.eval_df(lib.make_trajectory_linear(), rows) >> tm.tf_mutate(x=tm.round(X.x, 5), y=tm.round(X.y, 4)) >> tm.tf_select("l_orderkey", "l_linenumber", "x", "y")


@query("""SELECT l_orderkey, l_linenumber, round(sin(x1) + 7 * sin(x2) ** 2 + 0.1 * x3 ** 4 * sin(x1), 6) AS y0
    FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 - 3 AS x1, l_discount * 30 AS x2, l_tax * 30 - 1 AS x3 FROM lineitem)""")
def model_ishigami(t: Tables):
    rows = t("lineitem") >> tm.tf_mutate(a=7.0, b=0.1, x1=X.l_quantity / 10 - 3, x2=X.l_discount * 30, x3=X.l_tax * 30 - 1)
    return ev.eval_df(lib.make_ishigami(), rows) >> tm.tf_mutate(y0=tm.round(X.y0, 6)) >> tm.tf_select("l_orderkey", "l_linenumber", "y0")


@query("""WITH d AS (SELECT p_partkey, 10000 + p_retailprice AS E, 0.3 + p_size / 1000.0 AS mu FROM part),
    m AS (SELECT avg(E) AS e FROM d), v AS (SELECT p_partkey, 6 + p_size / 5.0 AS w, 18 - p_size / 5.0 AS h, 1 + p_partkey % 3 AS m, 0.03 + p_size / 1000.0 AS t, E, mu FROM d JOIN part USING (p_partkey))
    SELECT p_partkey, round((m * h / w + w / m / h) ** 2 * pi() ** 2 / 12 * E / (1 - mu * mu) * (t / h) ** 2 - 0.00128 / t / w, 5) AS g_buckle, (SELECT round(e, 4) FROM m) AS mean_E FROM v""")
def model_plate_buckling(t: Tables):
    """The laws of the stiffness are fitted to the whole table first."""
    rows = t("part") >> tm.tf_mutate(w=6 + X.p_size / 5, h=18 - X.p_size / 5, m=1 + X.p_partkey % 3, t=0.03 + X.p_size / 1000, E=10000 + X.p_retailprice, mu=0.3 + X.p_size / 1000, L=0.00128)
    md = lib.make_plate_buckle(rows)
    out = ev.eval_df(md, rows) >> tm.tf_mutate(g_buckle=tm.round(X.g_buckle, 5), mean_E=round(md.density.marginals["E"].d_param["loc"], 4))
    return out >> tm.tf_select("p_partkey", "g_buckle", "mean_E")
