"""Statistical transforms: table to table."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.models.core import Model, uniform
from tidymesh.models.evaluate import eval_df
from tidymesh.operators.select import quoted
from tidymesh.plans.rowindex import with_row_index
from tidymesh.plans.storage import settle
from tidymesh.table import Table, add_pipe, as_table, named, verb


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


@verb
def tran_md(df: Table, md: Model, append: bool = True) -> Table:
    """A model at each row."""
    return eval_df(md, df, append=append)


@verb
def tran_kfolds(df: Table, k: int | None = None, ft: Callable | None = None, out: list[str] | None = None, var_fold: Any = None, suffix: str = "_mean", summaries: dict[str, Callable] | None = None, shuffle: bool = True, seed: int = 0) -> Table:
    """Errors of a fit over folds: for each fold, fitted to the others: rows (fold, summary_output).

    ``var_fold``: a column that names folds; else ``k`` folds of equal size, in hashed or in row order.
    """
    from tidymesh.functions import aggregates as A
    from tidymesh.models.fit import fit_lm

    summaries = summaries or {"rsq": A.rsq}
    if var_fold is None:
        key = [F.xxhash64(*quoted(df.columns), F.lit(seed))] if shuffle else list(df.order)
        numbered = with_row_index(df.df, key, "__i")
        size = -(-numbered.count() // (k or 5))
        data = settle(numbered.withColumn("_fold", F.floor(F.col("__i") / size).cast("string")).drop("__i"), "folds")
    else:
        data = settle(df.df.withColumn("_fold", _c(named(var_fold)).cast("string")), "folds")
    folds = sorted(r[0] for r in data.select("_fold").distinct().collect())
    outs, parts = out, []
    for fold in folds:
        md = (ft or (lambda d: fit_lm(d, var=[c for c in _numeric(df.df) if c not in (out or [])], out=out)))(Table(data.where(F.col("_fold") != fold).drop("_fold")))
        outs = outs or [o.removesuffix(suffix) for o in md.out]
        done = md.apply(data.where(F.col("_fold") == fold).drop(*md.out))
        made = {}
        ctx_table = Table(done)
        for o in outs:
            for name, fun in summaries.items():
                from tidymesh.expr import X

                made[f"{name}_{o}"] = fun(X[o + suffix], X[o])
        from tidymesh.operators.group import tran_summarize

        parts.append(tran_summarize(ctx_table, **made).df.withColumn("_kfold", F.lit(fold)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return Table(whole)


#: Draws of a row that a batch holds at once.
DRAWN = 512


def _draws(row: Column, block: Column, copies: Column, boots: int, n_boot: int, n_sub: int, seed: int) -> Column:
    """For each of a block's replicates how often a row of so many copies is in it, then in each of its sub-replicates: Poisson numbers from a
    generator that the row's hash and the block set."""

    @F.pandas_udf("array<bigint>")
    def run(row: pd.Series, block: pd.Series, copies: pd.Series) -> pd.Series:
        out = []
        for r, b, c in zip(row, block, copies):
            rng = np.random.Generator(np.random.Philox(key=np.array([r, seed]).astype(np.uint64), counter=[0, 0, 0, int(b)]))
            times = rng.poisson(c, min(boots, n_boot - b * boots))[:, None]
            out.append(np.hstack([times, rng.poisson(np.broadcast_to(times, (len(times), n_sub)))]).ravel())
        return pd.Series(out)

    return run(row, block, copies)


@verb
def tran_bootstrap(df: Table, tran: Callable[[Table], Table], n_boot: int = 500, n_sub: int = 25, con: float = 0.9, col_sel: list[str] | None = None, seed: int = 0) -> Table:
    """Bootstrap-t intervals of a one-row summary's columns: name_lo and name_up.

    Resampling is by weights: in each replicate a row counts a Poisson number of times, and in a sub-replicate as often as so many draws of its own say. Equal rows
    are counted first and drawn together, as their numbers add up to a Poisson number of their count. Draws come from the row's hash, so that a lost
    task draws the same again. The summary carries the weights into its aggregates, so no row is
    copied: replicates and sub-replicates are groups of one pass whose sums combine before the shuffle. Sub-replicates give
    each replicate's standard error. ``tran``: a verb that summarises a table with groups. Where its functions have no form for
    weights (places, windows), rows are repeated instead. Rows with maps can't be told apart, so each is drawn by itself, by its place.
    """
    from tidymesh.expr import Unweighted
    from tidymesh.operators.group import tran_group_by
    from tidymesh.plans.quantiles import exact_quantiles

    plain = df.df.columns
    if any("map<" in f.dataType.simpleString() for f in df.df.schema.fields):
        base = df.df.withColumns({"__copies": F.lit(1).cast("long"), "__row": F.monotonically_increasing_id()})
    else:
        base = df.df.groupBy(*quoted(plain)).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__row", F.xxhash64(*quoted(plain)))
    base = settle(base, "bootstrap")
    alpha = (1 - con) / 2
    try:
        once = tran(Table(base.drop("__row"), weight="__copies")).df
    except Unweighted:
        once = tran(Table(base.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*quoted(plain)))).df
    names = [c for c in (col_sel or _numeric(once))]
    each, boots = n_sub + 1, max(1, DRAWN // (n_sub + 1))
    blocks = base.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // boots))))
    blocks = blocks.withColumn("__draws", _draws(F.col("__row"), F.col("__block"), F.col("__copies"), boots, n_boot, n_sub, seed))
    blocks = blocks.select(*quoted(plain), "__block", F.posexplode("__draws").alias("__at", "__times")).where("__times > 0")
    # __sub -1 is the replicate itself
    at = F.col("__at")
    drawn = blocks.select(*quoted(plain), (F.col("__block") * boots + F.floor(at / each)).cast("int").alias("__boot"), (at % each - 1).cast("int").alias("__sub"), "__times")
    groups = ("__boot", "__sub")
    try:
        told = tran(Table(drawn, groups=groups, weight="__times")).df
    except Unweighted:
        copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__copy", "__times")
        told = tran(tran_group_by(Table(copies), *groups)).df
    told = settle(told.select(*groups, *(_c(c).cast("double").alias(c) for c in names)), "replicates")
    theta = told.where("__sub < 0")
    inner = told.where("__sub >= 0").groupBy("__boot").agg(*(F.stddev_samp(_c(c)).alias(f"__se{i}") for i, c in enumerate(names)))
    hats = once.select(*(_c(c).cast("double").alias(f"__hat{i}") for i, c in enumerate(names)))
    met = theta.join(inner, "__boot").crossJoin(F.broadcast(hats))  # one row
    t = [F.try_divide(_c(c) - F.col(f"__hat{i}"), F.col(f"__se{i}")) for i, c in enumerate(names)]
    cut = exact_quantiles(met, [], [(x, [1 - alpha, alpha]) for x in t])
    spread = met.agg(*(F.first(f"__hat{i}").alias(f"__hat{i}") for i in range(len(names))), *(F.stddev_samp(_c(c)).alias(f"__sd{i}") for i, c in enumerate(names)))
    made = []
    for i, c in enumerate(names):
        hat, se = F.col(f"__hat{i}"), F.col(f"__sd{i}")
        made += [(hat - F.col(f"q{i}_0") * se).alias(f"{c}_lo"), (hat - F.col(f"q{i}_1") * se).alias(f"{c}_up"), hat.alias(c)]
    return Table(spread.crossJoin(F.broadcast(cut)).select(*made))  # a row each


def _gram(df: DataFrame, names: list[str], centred: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, sums of products, rows) in one pass of aggregates."""
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    f = (lambda a, b: F.covar_samp(a, b)) if centred else (lambda a, b: F.sum(a * b))
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(_c(c)).alias(f"m{i}") for i, c in enumerate(names)), *(f(_c(names[i]), _c(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), x in zip(pairs, row[1 + len(names) :]):
        out[i, j] = out[j, i] = x
    return np.array(row[1 : 1 + len(names)], float), out, int(row[0])


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive, so that results don't hang on a library's choice."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] + 1e-300)


@verb
def tran_pca(df: Table, var: list[str] | None = None, lamvar: str = "lam", standardize: bool = False) -> Table:
    """Principal components: a row for each, with its singular value and loadings; from the covariances."""
    names = list(var or _numeric(df.df))
    _, cov, n = _gram(df.df, names, True)
    if standardize:
        d = np.sqrt(np.diag(cov))
        cov = cov / np.outer(d, d)
    lam, vec = np.linalg.eigh(cov)
    order = np.argsort(-lam)
    vec = _signed(vec[:, order])
    rows = [(float(math.sqrt(max(0.0, lam[k]) * (n - 1))), *(float(x) for x in vec[:, i])) for i, k in enumerate(order)]
    return Table(df.df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [lamvar, *names])))


@verb
def tran_asub(df: Table, prefix: str = "D", outvar: str = "out", lamvar: str = "lam") -> Table:
    """Active subspaces from columns Dout_Dvar: for each output, directions with their singular values."""
    grads = [c for c in df.columns if c.startswith(prefix) and f"_{prefix}" in c]
    outs = list(dict.fromkeys(c[len(prefix) :].split(f"_{prefix}")[0] for c in grads))
    names = list(dict.fromkeys(c.split(f"_{prefix}")[1] for c in grads))
    rows = []
    for o in outs:
        _, gram, n = _gram(df.df, [f"{prefix}{o}_{prefix}{v}" for v in names], False)
        lam, vec = np.linalg.eigh(gram / n)
        order = np.argsort(-lam)
        vec = _signed(vec[:, order])
        rows += [(o, float(math.sqrt(max(0.0, lam[k]))), *(float(x) for x in vec[:, i])) for i, k in enumerate(order)]
    return Table(df.df.sparkSession.createDataFrame(rows, f"`{outvar}` string, " + ", ".join(f"`{c}` double" for c in [lamvar, *names])))


@verb
def tran_inner(df: Table, df_weights: Any, prefix: str = "dot", name: Any = None, append: bool = True) -> Table:
    """Inner products with the rows of a small table of weights, as one projection."""
    weights = as_table(df_weights).df
    names = [c for c in weights.columns if c in df.columns and (name is None or c != named(name))]
    rows = weights.collect()
    labels = [f"{prefix}_{r[named(name)]}" for r in rows] if name is not None else [prefix] if len(rows) == 1 else [f"{prefix}{i}" for i in range(len(rows))]
    made = [sum((_c(c) * float(r[c]) for c in names), F.lit(0.0)).alias(label) for r, label in zip(rows, labels)]
    return df.to(df.df.select(*(quoted(df.columns) if append else []), *made))


@verb
def tran_iocorr(df: Table, var: list[str], out: list[str], method: str = "pearson", nan_drop: bool = False) -> Table:
    """Correlation of each input with each output: rows (var, out, rho), from one pass."""
    from tidymesh.expr import X
    from tidymesh.functions.aggregates import corr
    from tidymesh.operators.group import tran_summarize

    pairs = list(itertools.product(var, out))
    wide = tran_summarize(df, **{f"r{i}": corr(X[v], X[o], method=method, nan_drop=nan_drop) for i, (v, o) in enumerate(pairs)}).df
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("var"), F.lit(o).alias("out"), F.col(f"r{i}").alias("rho")) for i, (v, o) in enumerate(pairs))))
    return Table(wide.select(rows.alias("r")).select("r.var", "r.out", "r.rho"))


@verb
def tran_copula_corr(df: Table, model: Model | None = None, density: Any = None) -> Table:
    """Correlations of normal scores for each pair of random inputs: rows (var1, var2, corr), from one pass."""
    from tidymesh.functions.scalar import qnorm

    marginals = (density or model.density).marginals
    names = [v for v in marginals if v in df.columns]
    scores = df.df.select(*(qnorm(F.least(F.greatest(marginals[v].p(_c(v)), F.lit(1e-15)), F.lit(1 - 1e-15))).alias(v) for v in names))
    pairs = list(itertools.combinations(names, 2))
    wide = scores.agg(*(F.corr(_c(a), _c(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs))))
    return Table(wide.select(rows.alias("r")).select("r.var1", "r.var2", "r.corr"))


@verb
def tran_sobol(df: Table, typename: str = "ind", digits: int = 2, full: bool = False, plan: str | None = None, varname: str = "hybrid_var", out: list[str] | None = None) -> Table:
    """Sobol' indices from a hybrid design: a row for each input with an index for each output (``full``: the variances
    too). Blocks meet by the row's number, so it is one aggregate and a join of equal keys."""
    plan = plan or df.meta.get("plan", "first")
    outs = out or df.meta["out"]
    keys = ["hybrid_ind"]
    base = df.df.where(_c(varname) == "_").select(*quoted(keys), *(_c(o).alias(f"__b{i}") for i, o in enumerate(outs)))
    met = df.df.where(_c(varname) != "_").join(base, keys)
    rows = []
    for i, o in enumerate(outs):
        a, b = _c(o), F.col(f"__b{i}")
        part = F.covar_pop(a, b) if plan == "first" else F.avg((a - b) * (a - b)) / 2
        rows += [part.alias(f"__v{i}"), F.var_pop(b).alias(f"__t{i}")]
    got = met.groupBy(_c(varname).alias("var")).agg(*rows)
    made = [F.round(F.try_divide(F.col(f"__v{i}"), F.col(f"__t{i}")), digits).alias(o) for i, o in enumerate(outs)]
    more = [c for i, o in enumerate(outs) for c in (F.col(f"__v{i}").alias(f"{o}_part"), F.col(f"__t{i}").alias(f"{o}_var"))] if full else []
    return Table(got.select("var", F.lit({"first": "S", "total": "T"}[plan]).alias(typename), *made, *more))


def powerset(items: Any) -> list[tuple]:
    items = list(items)
    return [c for k in range(len(items) + 1) for c in itertools.combinations(items, k)]


@verb
def tran_shapley_cohort(df: Table, var: list[str], out: list[str], bins: int = 20, inds: list[int] | None = None) -> Table:
    """Cohort Shapley values of each row's outputs by input: columns out_var.

    A row's cohort for a set of inputs is the rows in the same bins of them. Rows are added up by cell (a bin of every input); one CUBE over the
    cells has the means of the cohorts of all 2 ** inputs sets, each cell looks up its own, and a value is their sum by the sets' weights;
    then rows get those of their cell. No row meets another, and no set needs a pass of its own. Missing inputs are a bin of
    their own; missing outputs are left out of the means.
    """
    data = with_row_index(df.df, list(df.order), "__i")
    lo_up = data.agg(*(f(_c(v)).alias(f"{n}{i}") for i, v in enumerate(var) for n, f in (("lo", F.min), ("up", F.max)))).first()
    d = len(var)
    keys = [f"__b{i}" for i in range(d)]
    for i, v in enumerate(var):
        lo, up = (0.0 if x is None else float(x) for x in lo_up[2 * i : 2 * i + 2])
        place = F.least(F.floor((_c(v) - lo) / (up - lo if up > lo else 1.0) * bins), F.lit(bins - 1)).cast("int")
        data = data.withColumn(keys[i], F.coalesce(place, F.lit(-2)))
    data = settle(data, "cohorts")
    sums = [f(_c(o)).alias(f"__{n}{k}") for k, o in enumerate(out) for n, f in (("s", F.sum), ("n", F.count))]
    cells = settle(data.groupBy(*keys).agg(*sums), "cells")
    added = [F.sum(f"__{n}{k}").alias(f"__{n}{k}") for k in range(len(out)) for n in "sn"]
    cube = cells.cube(*keys).agg(*added, *(F.grouping(k).alias(f"__g{i}") for i, k in enumerate(keys)))
    mask = sum((F.when(F.col(f"__g{i}") == 0, 1 << i).otherwise(0) for i in range(d)), F.lit(0))
    # -1: an input outside the set
    means = cube.select(mask.alias("__set"), *(F.coalesce(F.col(k), F.lit(-1)).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.try_divide(F.col(f"__s{k}").cast("double"), F.col(f"__n{k}")).alias(f"__m{k}") for k in range(len(out))))
    asked = cells.select(*keys, F.explode(F.sequence(F.lit(0), F.lit((1 << d) - 1))).alias("__of"))
    asked = asked.withColumns({f"__a{i}": F.when(F.col("__of").bitwiseAND(1 << i) != 0, F.col(k)).otherwise(-1) for i, k in enumerate(keys)})
    met = asked.join(means, [F.col("__of") == F.col("__set"), *(F.col(f"__a{i}") == F.col(f"__k{i}") for i in range(d))])
    others = [math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d) for n in range(d)]
    share = F.array(*(F.lit(x) for x in others))
    size = F.bit_count(F.col("__of"))

    def value(i: int, k: int) -> Column:
        """A set with the input counts for it by the weight of the set without it; a set without it, against it by its own."""
        w = F.when(F.col("__of").bitwiseAND(1 << i) != 0, F.get(share, size - 1)).otherwise(-F.get(share, size))
        return F.sum(w * F.col(f"__m{k}")).alias(f"__v{k}_{i}")

    values = met.groupBy(*(F.col(k).alias(f"{k}c") for k in keys)).agg(*(value(i, k) for k in range(len(out)) for i in range(d)))
    rows = data if inds is None else data.join(F.broadcast(data.sparkSession.createDataFrame([(int(i),) for i in inds], "__i bigint")), "__i")
    told = rows.join(values, [F.col(k) == F.col(f"{k}c") for k in keys])
    return Table(told.select(*quoted(df.columns), *(F.col(f"__v{k}_{i}").alias(f"{o}_{v}") for k, o in enumerate(out) for i, v in enumerate(var))))


@verb
def tran_reweight(df: Table, md_base: Model, md_new: Model, var_weight: str = "weight", append: bool = True) -> Table:
    """Importance weights: the new model's density over the old one's."""
    names = md_base.var_rand
    if set(names) != set(md_new.var_rand):
        raise ValueError("the models have other random inputs")
    x = {v: _c(v) for v in names}
    w = F.try_divide(md_new.density.d(x), md_base.density.d(x)).alias(var_weight)
    return df.to(df.df.select(*(quoted(c for c in df.columns if c != var_weight) if append else []), w))


@verb
def tran_angles(df: Table, df2: Any) -> Table:
    """Principal angles between the column spaces of two tables with the same rows in the same order.

    Rows meet by their place, and one pass adds up the products of all columns; angles follow from those sums (so angles under some 1e-7 are told as about that).
    """
    other = as_table(df2)
    left = with_row_index(df.df, list(df.order), "__i").toDF(*(f"a{i}" for i in range(len(df.columns))), "__i")
    right = with_row_index(other.df, list(other.order), "__i").toDF(*(f"b{i}" for i in range(len(other.columns))), "__j")
    n, m = len(df.columns), len(other.columns)
    _, gram, _ = _gram(left.join(right, F.col("__i") == F.col("__j")).select(*left.columns[:-1], *right.columns[:-1]), [f"a{i}" for i in range(n)] + [f"b{i}" for i in range(m)], False)

    def root(g: np.ndarray) -> np.ndarray:
        """g ** -1/2 on its range."""
        lam, vec = np.linalg.eigh(g)
        keep = lam > lam.max() * 1e-12
        return vec[:, keep] / np.sqrt(lam[keep])

    s = np.clip(np.linalg.svd(root(gram[:n, :n]).T @ gram[:n, n:] @ root(gram[n:, n:]), compute_uv=False), -1, 1)
    return Table(df.df.sparkSession.createDataFrame([(float(x),) for x in sorted(np.arccos(s))], "angle double"))


@verb
def tran_sp(df: Table, n: int, var: list[str] | None = None, n_maxiter: int = 200, tol: float = 1e-3, seed: int = 0, standardize: bool = True) -> Table:
    """Support points: ``n`` points that stand for the table's distribution (least energy distance).

    Each round is one pass: tasks add up, for each point, what the rows they hold pull it by; the points (n of them)
    go out with the task and the sums come back.
    """
    names = list(var or _numeric(df.df))
    data = df.df.select(*(_c(c).cast("double").alias(c) for c in names)).dropna()
    stats = data.agg(*(f(_c(c)) for c in names for f in (F.avg, F.stddev_samp))).first()
    mean, sd = np.array(stats[::2], float), np.maximum(np.array(stats[1::2], float), 1e-12)
    if not standardize:
        mean, sd = np.zeros(len(names)), np.ones(len(names))
    data = settle(data, "support")
    points = (np.array(data.orderBy(F.xxhash64(*quoted(names), F.lit(seed))).limit(n).collect(), float) - mean) / sd
    points = points + np.random.default_rng(seed).normal(scale=1e-3, size=points.shape)
    total, k = data.count(), len(names)
    for _ in range(n_maxiter):
        def pull(frames: Iterator[pd.DataFrame], points: np.ndarray = points) -> Iterator[pd.DataFrame]:
            q, s = np.zeros(len(points)), np.zeros(points.shape)
            for f in frames:
                x = (f.to_numpy(float) - mean) / sd
                for i in range(0, len(x), 2048):
                    d = np.maximum(np.linalg.norm(points[:, None] - x[None, i : i + 2048], axis=2), 1e-8)
                    q += (1 / d).sum(axis=1)
                    s += (1 / d) @ x[i : i + 2048]
            yield pd.DataFrame({"i": np.arange(len(points)), "q": q, **{f"s{j}": s[:, j] for j in range(points.shape[1])}})

        got = data.mapInPandas(pull, "i bigint, q double, " + ", ".join(f"s{j} double" for j in range(k))).groupBy("i").agg(F.sum("q"), *(F.sum(f"s{j}") for j in range(k))).orderBy("i").collect()
        q, s = np.array([r[1] for r in got]), np.array([r[2:] for r in got], float)
        apart = points[:, None] - points[None]
        d = np.maximum(np.linalg.norm(apart, axis=2), 1e-8)
        push = (apart / d[..., None] * (1 - np.eye(len(points)))[..., None]).sum(axis=1)
        new = (total / len(points) * push + s) / q[:, None]
        moved, points = np.abs(new - points).max(), new
        if moved < tol:
            break
    rows = [tuple(float(x) for x in p * sd + mean) for p in points]
    return Table(df.df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)))


@verb
def tran_polyridge(df: Table, var: list[str], out: str, n_dim: int = 1, n_degree: int = 2, seed: int = 0, n_iter: int = 50) -> Table:
    """Directions of a polynomial ridge function: a row for each, with a weight for each input; fitted to all rows (models/fit.py)."""
    from tidymesh.models.fit import Ridge

    u = Ridge(df.df, list(var), out, n_dim, n_degree).fit(n_iter, seed)[0]
    return Table(df.df.sparkSession.createDataFrame([tuple(float(x) for x in col) for col in u.T], ", ".join(f"`{c}` double" for c in var)))


def _embedding(df: Table, var: list[str] | None, out: str, keep: bool, append: bool, n_dim: int, rows: int, near: int, fun: Callable[[np.ndarray], np.ndarray]) -> Table:
    """A position for every row with known inputs (missing for the others).

    ``fun`` lays out landmarks: at most ``rows`` distinct rows, those of the least hash. They are few, so they go out with the tasks, and any other row is put among its
    ``near`` nearest landmarks, each weighing by a normal kernel as wide as the distances to them are; a landmark keeps its own position.
    """
    names = list(var or _numeric(df.df))
    known = df.df.select(*(_c(c).cast("double").alias(c) for c in names)).dropna().distinct()
    marks = np.array(known.orderBy(F.xxhash64(*quoted(names)), *quoted(names)).limit(rows).collect(), float).reshape(-1, len(names))
    places = fun(marks) if len(marks) > 1 else np.zeros((len(marks), n_dim))
    stats = known.agg(*(f(_c(c)) for c in names for f in (F.avg, F.stddev_pop))).first()
    mid, width = np.array([0.0 if x is None else float(x) for x in stats[::2]]), np.array([float(x) if x else 1.0 for x in stats[1::2]])
    marks = (marks - mid) / width
    made = [f"{out}{i}" for i in range(n_dim)]
    kept = [f for f in df.df.schema.fields if f.name not in made and (append or keep and f.name in names)]
    schema = T.StructType([*kept, *(T.StructField(m, T.DoubleType()) for m in made)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = (f[names].to_numpy(float) - mid) / width
            at = np.full((len(f), n_dim), np.nan)
            for k in range(0, len(f), 1024):
                part = x[k : k + 1024]
                sure = np.isfinite(part).all(axis=1)
                if not len(marks) or not sure.any():
                    continue
                d = ((part[sure][:, None] - marks[None]) ** 2).sum(axis=2)
                own = np.argsort(d, axis=1, kind="stable")[:, :near]
                far = np.take_along_axis(d, own, axis=1)
                w = np.exp(-far / np.maximum(far.mean(axis=1, keepdims=True), 1e-300))
                w = np.where((far[:, :1] <= 1e-18), far <= 1e-18, w)
                at[k : k + 1024][sure] = np.einsum("ij,ijk->ik", w / w.sum(axis=1, keepdims=True), places[own])
            got = f[[c.name for c in kept]].copy()
            for i, m in enumerate(made):
                got[m] = at[:, i]
            yield got

    done = df.df.mapInPandas(run, schema)
    return Table(done.withColumns({m: F.when(~F.isnan(_c(m)), _c(m)) for m in made}))


@verb
def tran_tsne(
    df: Table, var: list[str] | None = None, out: str = "xi", keep: bool = True, append: bool = False, n_dim: int = 2, seed: int = 0, rows: int = 1000, perplexity: float = 20.0, n_iter: int = 300, near: int = 8
) -> Table:
    """t-SNE map: landmarks (at most ``rows`` distinct rows) are laid out on the driver, every other row finds its place among its nearest landmarks."""

    def fun(x: np.ndarray) -> np.ndarray:
        x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        p = np.zeros_like(d)
        target = math.log(min(perplexity, max(2.0, (len(x) - 1) / 3)))
        for i in range(len(x)):
            lo, up, beta = 0.0, math.inf, 1.0
            for _ in range(50):
                w = np.exp(-(d[i] - np.delete(d[i], i).min() if len(x) > 1 else d[i]) * beta)
                w[i] = 0
                w /= max(w.sum(), 1e-300)
                h = -(w[w > 0] * np.log(w[w > 0])).sum()
                if abs(h - target) < 1e-5:
                    break
                lo, up = (beta, up) if h > target else (lo, beta)
                beta = beta * 2 if up == math.inf else (lo + up) / 2
            p[i] = w
        p = np.maximum((p + p.T) / (2 * len(x)), 1e-12)
        y = np.random.default_rng(seed).normal(scale=1e-2, size=(len(x), n_dim))
        v = np.zeros_like(y)
        for it in range(n_iter):
            q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
            np.fill_diagonal(q, 0)
            w = (p * (4 if it < 100 else 1) - q / q.sum()) * q
            g = 4 * (np.diag(w.sum(axis=1)) - w) @ y
            v = (0.5 if it < 100 else 0.8) * v - max(10.0, len(x) / 12) * g
            y = y + v
        return y - y.mean(axis=0)

    return _embedding(df, var, out, keep, append, n_dim, rows, near, fun)


@verb
def tran_umap(df: Table, var: list[str] | None = None, out: str = "xi", keep: bool = True, append: bool = False, n_dim: int = 2, seed: int = 0, rows: int = 1000, near: int = 8) -> Table:
    """UMAP of landmarks on the driver, all other rows among their nearest ones; needs the umap package."""
    try:
        import umap
    except ImportError as e:
        raise ImportError("tran_umap needs the umap package") from e
    return _embedding(df, var, out, keep, append, n_dim, rows, near, lambda x: umap.UMAP(n_components=n_dim, random_state=seed).fit_transform(x))


@verb
def tran_feat_composition(df: Table, var_formula: str = "FORMULA", append: bool = True) -> Table:
    """Features of chemical formulas that need no tables: the share of each element, as a map, and the number of elements."""
    pairs = F.regexp_extract_all(_c(var_formula), F.lit(r"([A-Z][a-z]?)(\d*\.?\d*)"), F.lit(0))
    name = lambda p: F.regexp_extract(p, r"^([A-Z][a-z]?)", 1)
    amount = lambda p: F.coalesce(F.regexp_extract(p, r"([0-9.]+)$", 1).try_cast("double"), F.lit(1.0))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + amount(p))
    shares = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, name)), lambda e: F.struct(e, F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(name(p) == e, amount(p)).otherwise(0.0)) / total)))
    made = [shares.alias("fraction"), F.size(shares).alias("n_elements")]
    return df.to(df.df.select(*(quoted(df.columns) if append else []), *made))


tf_md, tf_kfolds, tf_bootstrap, tf_pca, tf_asub, tf_inner = map(add_pipe, (tran_md, tran_kfolds, tran_bootstrap, tran_pca, tran_asub, tran_inner))
tf_iocorr, tf_copula_corr, tf_sobol, tf_shapley_cohort, tf_reweight = map(add_pipe, (tran_iocorr, tran_copula_corr, tran_sobol, tran_shapley_cohort, tran_reweight))
tf_angles, tf_sp, tf_polyridge, tf_tsne, tf_umap, tf_feat_composition = map(add_pipe, (tran_angles, tran_sp, tran_polyridge, tran_tsne, tran_umap, tran_feat_composition))
