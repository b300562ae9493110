"""Order statistics, weights, fronts and fits over all rows, against plain computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidymesh import verbs as tm
from tidymesh.models import fit as ft
from tidymesh.plans.quantiles import exact_quantiles
from tidymesh.plans.storage import settle
from tidymesh.table import Table, as_table
from tidymesh.transforms import pareto
from tidymesh.transforms import statistics as st
from tidymesh.verbs import X


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", "c"][min(2, i % 5)], float(x), float(y), i) for i, (x, y) in enumerate(zip(rng.normal(size=800).round(2), rng.integers(0, 6, 800)))]
    rows += [("a", None, 1.0, 900), (None, 3.0, 2.0, 901), ("d", None, 5.0, 902), ("e", 7.5, 2.0, 903)]
    return spark.createDataFrame(rows, "g string, x double, y double, i int")


def test_quantiles_of_groups(values):
    want = values.toPandas().groupby("g").x
    got = {r.g: r for r in (as_table(values) >> tm.tf_group_by("g") >> tm.tf_summarize(m=tm.median(X.x), q=tm.quant(X.x, 0.9), r=tm.IQR(X.x), z=tm.median(X.y) - tm.mean(X.x), n=tm.n())).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    for g in got:
        if g == "d":
            assert got[g].m is None and got[g].q is None and got[g].n == 1
            continue
        assert math.isclose(got[g].m, want.median()[g]) and math.isclose(got[g].q, want.quantile(0.9)[g]) and math.isclose(got[g].r, want.quantile(0.75)[g] - want.quantile(0.25)[g], abs_tol=1e-12)
    whole = (as_table(values) >> tm.tf_summarize(m=tm.median(X.x), q=tm.quant(X.x, 0.001))).collect()[0]
    frame = values.toPandas()
    assert math.isclose(whole.m, frame.x.median()) and math.isclose(whole.q, frame.x.quantile(0.001))


def test_quantiles_inside_rows_and_of_nothing(values, spark):
    frame = values.toPandas()
    got = (as_table(values) >> tm.tf_group_by("g") >> tm.tf_filter(X.x > tm.quant(X.x, 0.8))).df.count()
    known = frame.dropna(subset=["g"])
    assert got == sum(len(d[d.x > d.x.quantile(0.8)]) for _, d in known.groupby("g"))
    got = (as_table(values) >> tm.tf_mutate(d=X.x - tm.median(X.x))).df.agg(F.min("d")).first()[0]
    assert math.isclose(got, frame.x.min() - frame.x.median())
    empty = (as_table(values.limit(0)) >> tm.tf_summarize(m=tm.median(X.x), n=tm.n())).collect()
    assert [(r.m, r.n) for r in empty] == [(None, 0)]
    assert (as_table(values.limit(0)) >> tm.tf_group_by("g") >> tm.tf_summarize(m=tm.median(X.x))).df.count() == 0
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert exact_quantiles(nan, [], [(F.col("x"), [0.5])]).first()[0] == 2.0  # NaN is the largest


def test_one_value_that_is_most_of_the_table(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") / 1000).alias("x"))
    frame = df.toPandas()
    got = exact_quantiles(df, [], [(F.col("x"), [0.0, 0.1, 0.5, 0.97, 1.0])]).first()
    assert np.allclose(list(got), frame.x.quantile([0.0, 0.1, 0.5, 0.97, 1.0]))
    for plan in (exact_quantiles(df, [], [(F.col("x"), [0.5])]),):
        assert "percentile" not in plan._jdf.queryExecution().toString()


def test_ranks_places_and_bounds(values):
    frame = values.toPandas().dropna()
    whole = (as_table(values) >> tm.tf_dropna() >> tm.tf_summarize(r=tm.corr(X.x, X.y, method="spearman"), lo=tm.pint_lo(X.x, alpha=0.05), up=tm.pint_up(X.x, alpha=0.05))).collect()[0]
    assert math.isclose(whole.r, frame.x.rank().corr(frame.y.rank()), rel_tol=1e-9)
    s = np.sort(frame.x)
    assert whole.lo == s[tm.pint_lo_index(len(s), 1, 1, 0.05) - 1] and whole.up == s[tm.pint_up_index(len(s), 1, 1, 0.05) - 1]
    by = {r.g: r for r in (as_table(values, ["i"]) >> tm.tf_group_by("g") >> tm.tf_summarize(a=tm.nth(X.i, -2), b=tm.nth(X.i, -1), c=tm.nth(X.i, -500))).collect()}
    for g, d in values.toPandas().dropna(subset=["g"]).groupby("g"):
        i = sorted(d.i)
        assert (by[g].a, by[g].b, by[g].c) == (i[-2] if len(i) > 1 else None, i[-1], i[-500] if len(i) >= 500 else None)
    few = (as_table(values.where("g = 'e'")) >> tm.tf_summarize(lo=tm.pint_lo(X.x))).collect()[0]
    assert few.lo is None


def test_weights_stand_for_copies(values):
    weighed = values.withColumn("w", F.pmod(F.col("i"), F.lit(4)))
    copies = weighed.where("w > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w"))))
    made = dict(
        a=tm.mean(X.x), b=tm.sum(X.x), c=tm.var(X.x), d=tm.sd(X.x), e=tm.skew(X.x), f=tm.kurt(X.x), g_=tm.median(X.x), h=tm.quant(X.x, 0.3), i_=tm.n(), j=tm.n_distinct(X.y), k=tm.min(X.x), l=tm.max(X.x),
        m=tm.corr(X.x, X.y, nan_drop=True), n_=tm.pr(X.x > 0), o=tm.pr_lo(X.x > 0), p=tm.mean_lo(X.x), q=tm.rmse(X.x, X.y), r=tm.rsq(X.x, X.y), s=tm.mean(X.x - tm.mean(X.x)), t=tm.mad(X.x, X.y) / tm.n(),
    )
    for groups in ((), ("g",)):
        got = tm.tran_summarize(Table(weighed, groups=groups, weight="w"), **made).df.toPandas()
        want = tm.tran_summarize(Table(copies, groups=groups), **made).df.toPandas()
        if groups:
            want = got[["g"]].merge(want, on="g", how="left")
            got = got[got.i_ > 0].reset_index(drop=True)
            want = want[want.i_ > 0].reset_index(drop=True)
        pd.testing.assert_frame_equal(got.astype(float, errors="ignore"), want.astype(float, errors="ignore"), check_dtype=False, rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError):
        tm.tran_summarize(Table(weighed, weight="w"), a=tm.first(X.x))


def test_bootstrap(spark):
    data = as_table(spark.range(400).selectExpr("CAST(id % 23 AS DOUBLE) AS x"))
    got = st.tran_bootstrap(data, tran=lambda d: tm.tran_summarize(d, m=tm.mean(X.x), q=tm.median(X.x)), n_boot=80, n_sub=6, con=0.9).collect()[0]
    again = st.tran_bootstrap(data, tran=lambda d: tm.tran_summarize(d, m=tm.mean(X.x), q=tm.median(X.x)), n_boot=80, n_sub=6, con=0.9).collect()[0]
    assert got == again and got.m_lo < got.m < got.m_up and got.q_lo <= got.q <= got.q_up
    sd = np.std(np.arange(400) % 23) / 20
    assert 0.5 < (got.m_up - got.m_lo) / (2 * 1.645 * sd) < 1.8
    # places have no form for weights, so rows are repeated
    other = st.tran_bootstrap(data, tran=lambda d: tm.tran_summarize(d, f=tm.nth(X.x, 200, order_by=X.x)), n_boot=12, n_sub=4).collect()[0]
    assert other.f_lo <= other.f_up


def test_bootstrap_draws_equal_rows_together(spark, monkeypatch):
    """23 values of 40,000 rows: what is drawn from grows with the values; the interval is that of all rows."""
    settled = {}

    def keep(df, name):
        settled[name] = settle(df, name)
        return settled[name]

    monkeypatch.setattr(st, "settle", keep)
    data = as_table(spark.range(40_000).selectExpr("CAST(id % 23 AS DOUBLE) AS x", "CASE WHEN id % 2 = 0 THEN 'a' END AS k"))
    got = st.tran_bootstrap(data, tran=lambda d: tm.tran_summarize(d, m=tm.mean(X.x), n=tm.n()), n_boot=100, n_sub=8).collect()[0]
    base = settled["bootstrap"]
    assert base.count() == 46 and base.agg({"__copies": "sum"}).first()[0] == 40_000
    assert got.n == 40_000 and got.m_lo < got.m < got.m_up and abs(got.m - (np.arange(40_000) % 23).mean()) < 1e-9
    assert 0.6 < (got.m_up - got.m_lo) / (2 * 1.645 * np.std(np.arange(23)) / 200) < 1.6
    assert 0.6 < (got.n_up - got.n_lo) / (2 * 1.645 * 200) < 1.6
    maps = as_table(spark.range(300).selectExpr("CAST(id AS DOUBLE) AS x", "map('a', id) AS m"))
    wide = st.tran_bootstrap(maps, tran=lambda d: tm.tran_summarize(d, m=tm.mean(X.x)), n_boot=40, n_sub=4).collect()[0]
    assert wide.m_lo < wide.m < wide.m_up


def front(x):
    return {tuple(p) for p in x if not any((q <= p).all() and (q < p).any() for q in x)}


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_fronts(spark, d):
    rng = np.random.default_rng(d)
    x = rng.integers(0, 12, size=(700, d)) * 1.0
    x = np.vstack([x, -x.sum(axis=1, keepdims=True) / 3 + np.zeros((700, d)) + rng.normal(size=(700, d)).round(1)]) if d > 2 else x
    names = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [tuple([None] * d)], ", ".join(f"{c} double" for c in names))
    got = pareto.thin(df, names).collect()
    assert {tuple(r[:d]) for r in got} == front(np.unique(x, axis=0)) and len(got) == len({tuple(r[:d]) for r in got})
    assert all(r[d] == (x == np.array(r[:d])).all(axis=1).sum() for r in got)
    assert pareto.thin(df.limit(0), names).count() == 0


def test_a_front_of_many_rows(spark):
    """All rows of an antichain stay, spread over tasks."""
    df = spark.range(40_000).select(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    assert pareto.thin(df, ["x", "y"]).count() == 40_000
    three = spark.range(6000).select(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"), F.lit(1.0).alias("z"))
    assert pareto.thin(three, ["x", "y", "z"]).count() == 6000


def test_process_of_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(math.sin(3 * a) + b * b + 0.01 * e)) for a, b, e in zip(rng.uniform(-1, 1, 3000), rng.uniform(-1, 1, 3000), rng.normal(size=3000))]
    data = spark.createDataFrame(rows, "a double, b double, y double")
    md = ft.fit_gp(data, var=["a", "b"], out=["y"], inducing=60, n_restart=1)
    got = (as_table(data) >> st.tf_md(md)).df.agg(F.sqrt(F.avg((F.col("y") - F.col("y_mean")) ** 2)), F.min("y_sd")).first()
    assert got[0] < 0.03 and got[1] >= 0
    far = md.numbers({"a": np.array([9.0]), "b": np.array([9.0])})
    assert far["y_sd"][0] > 0.5 * np.std([r[2] for r in rows])


def test_ridges_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (2500, 4))
    u, v = np.array([0.6, 0.8, 0, 0]), np.array([0, 0, 0.8, -0.6])
    y = (x @ u) ** 3 - x @ u + 2 * (x @ v) ** 2 + 5
    data = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y)], "a double, b double, c double, d double, y double")
    md = ft.fit_polyridge(data, var=["a", "b", "c", "d"], out="y", n_dim=2, n_degree=3, seed=1)
    assert (as_table(data) >> st.tf_md(md)).df.agg(F.max(F.abs(F.col("y") - F.col("y_mean")))).first()[0] < 1e-3
    one = spark.createDataFrame([tuple(map(float, (*a, (a @ u) ** 2))) for a in x], "a double, b double, c double, d double, y double")
    got = np.array(st.tran_polyridge(as_table(one), var=["a", "b", "c", "d"], out="y", n_dim=1, n_degree=2).collect()[0])
    assert np.abs(np.abs(got / np.linalg.norm(got)) - np.abs(u)).max() < 5e-3


def test_every_row_is_embedded(spark):
    rows = [(float(i % 40), float(i % 3), i) for i in range(500)] + [(None, 1.0, -1)]
    got = st.tran_tsne(as_table(spark.createDataFrame(rows, "a double, b double, i int")), var=["a", "b"], rows=50, n_iter=40, append=True).collect()
    assert len(got) == 501 and all((r.xi0 is None) == (r.a is None) for r in got)
    same = {(r.a, r.b): (r.xi0, r.xi1) for r in got}
    assert all(same[r.a, r.b] == (r.xi0, r.xi1) for r in got)  # equal rows have one place


def test_angles_of_tables(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 2)), rng.normal(size=(300, 3))
    left = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "i int, p double, q double")
    right = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "i int, p double, q double, r double")
    got = [r.angle for r in st.tran_angles(as_table(left, ["i"]) >> tm.tf_drop("i"), as_table(right, ["i"]) >> tm.tf_drop("i")).collect()]
    s = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    assert np.allclose(sorted(got), np.sort(np.arccos(s)))


def test_strata_and_series_in_rows(spark):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip([1, 2, 0, 1, 2, 0, 1, 2], [0, 0, 1, 1, 1, 2, 2, 2]))], "i int, x double, y double")
    got = [r.s for r in (as_table(df, ["i"]) >> tm.tf_mutate(s=tm.stratum_min(X.x, X.y))).collect()]
    assert got == [1, 2, 1, 2, 3, 2, 3, 4]
    with pytest.raises(ValueError):
        as_table(df) >> tm.tf_group_by("i") >> tm.tf_mutate(s=tm.stratum_min(X.x, X.y))
    series = spark.createDataFrame([(i + 1, "AB"[i % 2], 2 - i // 4, i // 4) for i in range(8)], "v int, a string, b int, g int")
    whole = as_table(series, ["v"])
    assert [r.o for r in (whole >> tm.tf_mutate(o=tm.order_series_by(X.v, X.a))).collect()] == [1, 3, 5, 7, 2, 4, 6, 8]
    assert [r.o for r in (whole >> tm.tf_mutate(o=tm.order_series_by(X.v, X.b, X.a))).collect()] == [5, 7, 6, 8, 1, 3, 2, 4]
    assert [r.o for r in (whole >> tm.tf_group_by("g") >> tm.tf_mutate(o=tm.order_series_by(X.v, tm.desc(X.v)))).collect()] == [4, 3, 2, 1, 8, 7, 6, 5]


def test_pivots_of_too_many_levels(spark, monkeypatch):
    from tidymesh.operators import reshape

    monkeypatch.setattr(reshape, "LEVELS", 3)
    df = spark.range(5).selectExpr("id AS k", "1 AS r", "id AS v")
    with pytest.raises(ValueError):
        as_table(df) >> tm.tf_spread("k", "v")
    assert len((as_table(df.where("k < 3")) >> tm.tf_spread("k", "v")).columns) == 4
