"""Verbs that fit models: table to model."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.models.core import Density, Domain, FunctionVectorized, Model
from tidymesh.models.evaluate import eval_nls
from tidymesh.plans.storage import settle
from tidymesh.table import add_pipe, as_table


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _names(df: DataFrame, var: Any, out: Any) -> tuple[list[str], list[str]]:
    outs = [out] if isinstance(out, str) else list(out)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return ([var] if isinstance(var, str) else list(var)) if var is not None else [c for c in numeric if c not in outs], outs


def _domain(df: DataFrame, var: list[str], domain: Domain | None) -> Domain:
    if domain is not None:
        return domain
    row = df.agg(*(f(_c(v)) for v in var for f in (F.min, F.max))).first()
    return Domain({v: (float(row[2 * i]), float(row[2 * i + 1])) for i, v in enumerate(var) if row[2 * i] is not None})


def least_squares(df: DataFrame, terms: list[Column], outs: list[str]) -> np.ndarray:
    """Coefficients (terms x outs) from the normal equations, all sums in one pass of aggregates."""
    cols = [t.cast("double") for t in terms] + [_c(o).cast("double") for o in outs]
    known = df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).dropna()
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)] + [(i, k + o) for i in range(k) for o in range(len(outs))]
    row = known.agg(*(F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{n}") for n, (i, j) in enumerate(pairs))).first()
    a, b = np.zeros((k, k)), np.zeros((k, len(outs)))
    for (i, j), x in zip(pairs, row):
        if j < k:
            a[i, j] = a[j, i] = x
        else:
            b[i, j - k] = x
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.lstsq(a / np.outer(scale, scale), b / scale[:, None], rcond=None)[0] / scale[:, None]


def fit_lm(df: Any, md: Model | None = None, var: Any = None, out: Any = None, domain: Domain | None = None, density: Density | None = None) -> Model:
    """Linear least squares with an intercept: out_mean for each output, inside Catalyst."""
    data = as_table(df).df
    if md is not None:
        var, out, domain, density = md.var, md.out, md.domain, md.density
    names, outs = _names(data, var, out)
    beta = least_squares(data, [F.lit(1.0), *map(_c, names)], outs)

    def predict(x: Any) -> dict[str, Any]:
        return {f"{o}_mean": sum((x[v] * float(beta[i + 1, k]) for i, v in enumerate(names)), float(beta[0, k])) for k, o in enumerate(outs)}

    return Model("linear", (FunctionVectorized(predict, tuple(names), tuple(f"{o}_mean" for o in outs), "lm"),), _domain(data, names, domain), density or Density())


def fit_ols(df: Any, formulae: list[str], domain: Domain | None = None, density: Density | None = None) -> Model:
    """Least squares by formulas such as "y ~ x1 + x2 + x1:x2 + I(x1**2)"."""
    data = as_table(df).df
    functions, every = [], []
    for formula in formulae:
        left, right = (s.strip() for s in formula.split("~"))
        terms = [t.strip() for t in right.split("+") if t.strip() not in ("1", "")]
        names = list(dict.fromkeys(v for t in terms for v in re.findall(r"[A-Za-z_]\w*", t) if v != "I"))
        every += [n for n in names if n not in every]

        def column(term: str, x: Any) -> Any:
            term = term[2:-1] if term.startswith("I(") else term
            out: Any = 1.0
            for factor in term.split(":") if ":" in term else term.split("*") if "**" not in term else [term]:
                base, _, power = factor.partition("**")
                value = x[base.strip()]
                for _ in range(int(power or 1)):
                    out = out * value if not isinstance(out, float) else value
            return out

        beta = least_squares(data, [F.lit(1.0), *(column(t, {n: _c(n) for n in names}) for t in terms)], [left])[:, 0]

        def predict(x: Any, terms: list[str] = terms, beta: np.ndarray = beta, left: str = left) -> dict[str, Any]:
            return {f"{left}_mean": sum((column(t, x) * float(b) for t, b in zip(terms, beta[1:])), float(beta[0]))}

        functions.append(FunctionVectorized(predict, tuple(names), (f"{left}_mean",), formula))
    return Model("ols", tuple(functions), _domain(data, every, domain), density or Density())


def fit_nls(df_data: Any, md: Model, out: list[str] | None = None, var_fix: list[str] | None = None, df_init: Any = None, uq_method: str | None = None, **kw: Any) -> Model:
    """The model with its parameters held at their least-squares values; ``uq_method="linpool"``: as random inputs with
    the covariance of the linear part."""
    from tidymesh.models.compose import comp_copula_gaussian, comp_freeze, comp_marginals
    from tidymesh.models.marginals import marg_named

    data = as_table(df_data).df
    best = eval_nls(md, df_data=data, out=out, var_fix=var_fix, df_init=df_init, **kw).df.first().asDict()
    held = {v: x for v, x in best.items() if v in md.var}
    if uq_method is None:
        return comp_freeze(md, **held)
    if uq_method != "linpool":
        raise ValueError("uq_method: None or linpool")
    outs = out or [o for o in md.out if o in data.columns]
    names = [v for v in held if v not in (var_fix or [])]
    known = {v: _c(v) for v in md.var if v in data.columns}

    def at(theta: dict[str, float]) -> dict[str, Column]:
        got = known | {v: F.lit(float(x)) for v, x in theta.items()}
        for f in md.functions:
            got = got | f.columns(got)
        return got

    h = {v: 1e-6 * max(1.0, abs(held[v])) for v in names}
    cols = [((at(held | {v: held[v] + h[v]})[o] - at(held | {v: held[v] - h[v]})[o]) / (2 * h[v])).alias(f"j{k}_{i}") for k, o in enumerate(outs) for i, v in enumerate(names)]
    row = data.select(*cols).agg(F.count(F.lit(1)), *(sum((F.sum(F.col(f"j{k}_{i}") * F.col(f"j{k}_{j}")) for k in range(len(outs))), F.lit(0.0)).alias(f"h{i}_{j}") for i in range(len(names)) for j in range(len(names)))).first()
    n = row[0] * len(outs)
    cov = best["mse"] / len(outs) * n / max(1, n - len(names)) * np.linalg.pinv(np.array(row[1:], float).reshape(len(names), len(names)))
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    out_md = comp_freeze(md, **{v: held[v] for v in held if v not in names}) if len(held) > len(names) else md
    out_md = comp_marginals(out_md, **{v: marg_named("norm", loc=held[v], scale=float(s)) for v, s in zip(names, sd)})
    pairs = [(a, b, float(cov[i, j] / sd[i] / sd[j])) for (i, a), (j, b) in itertools.combinations(list(enumerate(names)), 2)]
    if not pairs:
        from tidymesh.models.compose import comp_copula_independence

        return comp_copula_independence(out_md)
    return comp_copula_gaussian(out_md, df_corr=data.sparkSession.createDataFrame(pairs, "var1 string, var2 string, corr double"))


def _trees(data: DataFrame, names: list[str], out: str, seed: int, **kw: Any) -> list[list[tuple]]:
    """A fitted forest as plain nodes (feature, threshold, left, right, value), so that it runs without the library."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    made = VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="skip").transform(data.select(*map(_c, names), _c(out).cast("double").alias("__y")).dropna())
    model = RandomForestRegressor(featuresCol="__x", labelCol="__y", seed=seed, **kw).fit(made)
    out_trees = []
    for tree in model.trees:
        nodes: list[tuple] = []

        def walk(node: Any) -> int:
            at = len(nodes)  # noqa: B023
            nodes.append(())  # noqa: B023
            if node.numDescendants() == 0:
                nodes[at] = (-1, 0.0, -1, -1, float(node.prediction()))  # noqa: B023
            else:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())  # noqa: B023
                nodes[at] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)  # noqa: B023
            return at

        walk(tree._call_java("rootNode"))
        out_trees.append(nodes)
    return out_trees


def _forest(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Each tree's value for each row."""
    out = np.empty((len(trees), len(x)))
    for t, nodes in enumerate(trees):
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
            at = np.where(inner, go, at)
        out[t] = value[at]
    return out


def _fit_forest(df: Any, md: Model | None, var: Any, out: Any, domain: Any, density: Any, seed: int, sd: bool, **kw: Any) -> Model:
    data = as_table(df).df
    if md is not None:
        var, out, domain, density = md.var, md.out, md.domain, md.density
    names, outs = _names(data, var, out)
    forests = {o: _trees(data, names, o, seed, **kw) for o in outs}
    made = tuple(f"{o}{s}" for o in outs for s in (("_mean", "_sd") if sd else ("_mean",)))

    def predict(x: Any) -> dict[str, Any]:
        m = np.column_stack([np.asarray(x[v], float) for v in names])
        got = {}
        for o in outs:
            each = _forest(forests[o], m)
            got[f"{o}_mean"] = each.mean(axis=0)
            if sd:
                got[f"{o}_sd"] = each.std(axis=0, ddof=1)
        return got

    return Model("forest", (FunctionVectorized(predict, tuple(names), made, "rf"),), _domain(data, names, domain), density or Density())


def fit_rf(df: Any, md: Model | None = None, var: Any = None, out: Any = None, domain: Any = None, density: Any = None, seed: int = 0, n_estimators: int = 20, max_depth: int = 5) -> Model:
    """Random forest: out_mean for each output. Trained by Spark; applied in Arrow batches."""
    return _fit_forest(df, md, var, out, domain, density, seed, False, numTrees=n_estimators, maxDepth=max_depth)


def fit_lolo(df: Any, md: Model | None = None, var: Any = None, out: Any = None, domain: Any = None, density: Any = None, seed: int = 0, n_estimators: int = 40, max_depth: int = 8) -> Model:
    """Random forest with the trees' spread: out_mean and out_sd."""
    return _fit_forest(df, md, var, out, domain, density, seed, True, numTrees=n_estimators, maxDepth=max_depth)


def _kernel(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * (((a[:, None] - b[None]) / length) ** 2).sum(axis=2))


def _spread_rows(x: np.ndarray, n: int) -> np.ndarray:
    """Indices of ``n`` rows, each the farthest from those before it."""
    at, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < min(n, len(x)) and far.max() > 1e-12:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return np.array(at)


def summed(data: DataFrame, fun: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of a table of numbers (any rows x ``width``) that ``fun`` has for a batch: tasks add up their batches, then rows of the table meet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                part = fun(f)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    rows = data.mapInPandas(run, "i bigint, v array<double>").groupBy("i").agg(*(F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(width))).orderBy("i").collect()
    return np.array([r[1:] for r in rows], float)


def fit_gp(
    df: Any, md: Model | None = None, var: Any = None, out: Any = None, domain: Any = None, density: Any = None, seed: int = 0, inducing: int = 100, rows: int = 1000, n_restart: int = 3
) -> Model:
    """Gaussian process with a squared-exponential kernel and noise: out_mean and out_sd, from all rows.

    Every row counts in the normal equations of at most ``inducing`` points (a row or column each), which tasks add up in one pass; the points are spread
    over a sample of ``rows`` rows (those of the least hash of their place), and the lengths, one for each input, and the noise are those of greatest
    likelihood on at most 300 rows of that sample. Where the points are all distinct rows, it is the exact process.
    """
    from tidymesh.models.evaluate import nelder_mead

    data = as_table(df).df
    if md is not None:
        var, out, domain, density = md.var, md.out, md.domain, md.density
    names, outs = _names(data, var, out)
    kept = settle(data.select(*(_c(c).cast("double").alias(c) for c in [*names, *outs])).dropna().withColumn("__row", F.monotonically_increasing_id()), "process")
    stats = kept.agg(*(f(_c(c)) for c in [*names, *outs] for f in (F.avg, F.stddev_pop))).first()
    if stats[0] is None:
        raise ValueError("no rows to fit a process to")
    centre, spread = np.array(stats[::2], float), np.maximum(np.array(stats[1::2], float), 1e-12)
    mid, width = centre[: len(names)], spread[: len(names)]
    frame = kept.orderBy(F.xxhash64("__row", F.lit(seed)), "__row").limit(rows).toPandas()
    x = (frame[names].to_numpy(float) - mid) / width
    sub, z = x[:300], x[_spread_rows(x, inducing)]
    size = len(z)
    parts = {}
    for k, o in enumerate(outs):
        m, s = centre[len(names) + k], spread[len(names) + k]
        t = (frame[o].to_numpy(float)[:300] - m) / s

        def loss(p: np.ndarray) -> float:
            g = _kernel(sub, sub, np.exp(p[:-1])) + (math.exp(p[-1]) + 1e-6) * np.eye(len(sub))
            try:
                low = np.linalg.cholesky(g)
            except np.linalg.LinAlgError:
                return 1e12
            r = np.linalg.solve(low, t)  # noqa: B023
            return float(0.5 * r @ r + np.log(np.diag(low)).sum())

        rng, best = np.random.default_rng(seed), None
        for r in range(n_restart):
            start = np.append(np.zeros(len(names)) if r == 0 else rng.normal(size=len(names)), -4.0)
            got = nelder_mead(loss, start, np.full(len(start), -10.0), np.full(len(start), 5.0), steps=150)
            best = got if best is None or got[1] < best[1] else best
        length, noise = np.exp(best[0][:-1]), math.exp(best[0][-1]) + 1e-5

        def equations(f: pd.DataFrame, length: np.ndarray = length, o: str = o, m: float = m, s: float = s) -> np.ndarray:
            g = _kernel((f[names].to_numpy(float) - mid) / width, z, length)
            return np.column_stack([g.T @ g, g.T @ ((f[o].to_numpy(float) - m) / s)])

        sums = summed(kept.drop("__row"), equations, size + 1)
        # in the points' own directions, those without weight left out, so that points close to each other do no harm
        lam, vec = np.linalg.eigh(_kernel(z, z, length))
        vec = vec[:, lam > lam.max() * 1e-10] / np.sqrt(lam[lam > lam.max() * 1e-10])
        whole = np.linalg.inv(np.eye(vec.shape[1]) + vec.T @ sums[:, :-1] @ vec / noise)
        parts[o] = (m, s, length, vec @ whole @ (vec.T @ sums[:, -1]) / noise, vec @ (np.eye(vec.shape[1]) - whole) @ vec.T)

    def predict(v: Any) -> dict[str, Any]:
        a = (np.column_stack([np.asarray(v[c], float) for c in names]) - mid) / width
        got: dict[str, Any] = {f"{o}{e}": [] for o in outs for e in ("_mean", "_sd")}
        for i in range(0, max(1, len(a)), 2048):
            for o, (m, s, length, alpha, sure) in parts.items():
                k = _kernel(a[i : i + 2048], z, length)
                got[f"{o}_mean"].append(k @ alpha * s + m)
                got[f"{o}_sd"].append(np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k, sure, k), 0)) * s)
        return {k: np.concatenate(p) for k, p in got.items()}

    made = tuple(f"{o}{e}" for o in outs for e in ("_mean", "_sd"))
    return Model("gp", (FunctionVectorized(predict, tuple(names), made, "gp"),), _domain(data, names, domain), density or Density())


def fit_kmeans(df: Any, var: Any = None, colname: str = "cluster_id", seed: int = 0, n_clusters: int = 2, n_iter: int = 20) -> Model:
    """K-means clusters by Spark, as a function that names the nearest centre, inside Catalyst."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = as_table(df).df
    names = _names(data, var, [])[0]
    made = VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="skip").transform(data.select(*map(_c, names)).dropna())
    centres = KMeans(k=n_clusters, seed=seed, maxIter=n_iter, featuresCol="__x").fit(made).clusterCenters()

    def nearest(x: Any) -> dict[str, Any]:
        far = [sum((x[v] - float(c[i])) * (x[v] - float(c[i])) for i, v in enumerate(names)) for c in centres]
        if isinstance(x[names[0]], Column):
            return {colname: F.array_position(F.array(*far), F.least(*far)).cast("double") - 1 if len(far) > 1 else F.lit(0.0)}
        return {colname: np.argmin(np.array(far), axis=0)}

    return Model("kmeans", (FunctionVectorized(nearest, tuple(names), (colname,), "kmeans"),), _domain(data, names, None))


def column_ranges(df: Any, var: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    row = as_table(df).df.agg(*(f(_c(v)) for v in var for f in (F.min, F.max))).first()
    return {v: float(row[2 * i]) for i, v in enumerate(var)}, {v: float(row[2 * i + 1]) for i, v in enumerate(var)}


def standardize_cols(df: Any, ser_min: dict[str, float], ser_max: dict[str, float], var: list[str]) -> DataFrame:
    """Columns from their ranges to 0 and 1."""
    return as_table(df).df.withColumns({v: (_c(v) - ser_min[v]) / (ser_max[v] - ser_min[v]) for v in var})


def restore_cols(df: Any, ser_min: dict[str, float], ser_max: dict[str, float], var: list[str]) -> DataFrame:
    return as_table(df).df.withColumns({v: ser_min[v] + _c(v) * (ser_max[v] - ser_min[v]) for v in var})


def _powers(n_dim: int, degree: int) -> list[tuple[int, ...]]:
    return [p for p in itertools.product(range(degree + 1), repeat=n_dim) if sum(p) <= degree]


def _legendre(t: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, slopes) of Legendre's polynomials up to ``degree``: arrays of t's shape by degree."""
    p, q = [np.ones_like(t), t], [np.zeros_like(t), np.ones_like(t)]
    for k in range(1, degree):
        p.append(((2 * k + 1) * t * p[k] - k * p[k - 1]) / (k + 1))
        q.append(q[k - 1] + (2 * k + 1) * p[k])
    return np.stack(p[: degree + 1]), np.stack(q[: degree + 1])


class Ridge:
    """Polynomial of few projections of a table's inputs, over an orthogonal basis, fitted to all rows.

    Inputs are brought to -1 to 1; projections are divided by the root of their number, so they stay there too. Everything that
    the fit needs of the rows are sums of products of basis functions, their slopes and the output: a pass for each set of directions tried.
    """

    def __init__(self, data: DataFrame, names: list[str], out: str, n_dim: int, degree: int) -> None:
        self.data = settle(data.select(*(_c(c).cast("double").alias(c) for c in [*names, out])).dropna(), "ridge")
        stats = self.data.agg(*(f(_c(c)) for c in names for f in (F.min, F.max)), F.avg(_c(out)), F.count(F.lit(1))).first()
        if not stats[-1]:
            raise ValueError("no rows to fit a ridge to")
        lo, up = np.array(stats[: 2 * len(names) : 2], float), np.array(stats[1 : 2 * len(names) : 2], float)
        self.names, self.out, self.n_dim, self.degree, self.n = names, out, n_dim, degree, stats[-1]
        self.mid, self.width, self.level = (lo + up) / 2, np.maximum((up - lo) / 2, 1e-12), float(stats[-2])
        self.powers, self.root = _powers(n_dim, degree), math.sqrt(len(names))

    def __getstate__(self) -> dict[str, Any]:
        """What goes out with the tasks: all but the table."""
        return {k: v for k, v in self.__dict__.items() if k != "data"}

    def basis(self, z: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x functions, projections x rows x functions): values, and slopes by each projection."""
        p, q = _legendre(z @ u / self.root, self.degree)
        at = [[p[e[k], :, k] for k in range(self.n_dim)] for e in self.powers]
        values = np.column_stack([np.prod(a, axis=0) for a in at])
        slopes = [np.column_stack([np.prod([q[e[j], :, j] if j == k else a[j] for j in range(self.n_dim)], axis=0) for a, e in zip(at, self.powers)]) for k in range(self.n_dim)]
        return values, np.stack(slopes) / self.root

    def _batch(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return (f[self.names].to_numpy(float) - self.mid) / self.width, f[self.out].to_numpy(float) - self.level

    def solve(self, tries: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        """(coefficients, sum of squared errors) for each set of directions, in one pass."""
        k = len(self.powers)

        def sums(f: pd.DataFrame) -> np.ndarray:
            z, y = self._batch(f)
            out = []
            for u in tries:
                b = np.column_stack([self.basis(z, u)[0], y])
                out.append(b.T @ b)
            return np.concatenate(out)

        got = summed(self.data, sums, k + 1)
        out = []
        for i in range(len(tries)):
            g = got[i * (k + 1) : (i + 1) * (k + 1)]
            c = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=1e-12)[0]
            out.append((c, max(float(g[k, k] - 2 * c @ g[:k, k] + c @ g[:k, :k] @ c), 0.0)))
        return out

    def step(self, u: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Gauss and Newton's step of the directions, the coefficients following along (variable projection)."""
        k, d = len(self.powers), len(self.names)

        def sums(f: pd.DataFrame) -> np.ndarray:
            z, y = self._batch(f)
            b, slopes = self.basis(z, u)
            jac = np.column_stack([(s @ c)[:, None] * z for s in slopes])
            r = y - b @ c
            whole = np.column_stack([b, jac, r])
            return whole.T @ whole

        g = summed(self.data, sums, k + d * self.n_dim + 1)
        bb, bj, jj = g[:k, :k], g[:k, k:-1], g[k:-1, k:-1]
        own = np.linalg.lstsq(bb, np.column_stack([bj, g[:k, -1]]), rcond=1e-12)[0]
        left, right = jj - bj.T @ own[:, :-1], g[k:-1, -1] - bj.T @ own[:, -1]
        return np.linalg.lstsq(left, right, rcond=1e-10)[0].reshape(self.n_dim, d).T

    def fit(self, n_iter: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(directions, coefficients): the best of a start along the linear slope and four drawn ones, bettered until no step lowers the error."""
        d = len(self.names)

        def slope(f: pd.DataFrame) -> np.ndarray:
            z, y = self._batch(f)
            b = np.column_stack([z, np.ones(len(z)), y])
            return b.T @ b

        g = summed(self.data, slope, d + 2)
        linear = np.linalg.lstsq(g[: d + 1, : d + 1], g[: d + 1, -1], rcond=1e-12)[0][:d]
        rng, starts = np.random.default_rng(seed), []
        for s in range(5):
            u = rng.normal(size=(d, self.n_dim))
            if s == 0 and np.linalg.norm(linear) > 0:
                u[:, 0] = linear
            starts.append(np.linalg.qr(u)[0])
        found = self.solve(starts)
        order = sorted(range(5), key=lambda i: found[i][1])[:2]
        best = None
        for i in order:
            u, (c, error) = starts[i], found[i]
            for _ in range(n_iter):
                move = self.step(u, c)
                tries = [np.linalg.qr(u + t * move)[0] for t in (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)]
                got = self.solve(tries)
                j = min(range(len(tries)), key=lambda j: got[j][1])
                if not got[j][1] < error * (1 - 1e-9):
                    break
                u, (c, error) = tries[j], got[j]
                if error <= 1e-18 * self.n:
                    break
            if best is None or error < best[0]:
                best = (error, u, c)
        _, u, c = best
        signs = np.sign(u[np.abs(u).argmax(axis=0), np.arange(self.n_dim)])
        signs[signs == 0] = 1
        return u * signs, c * np.array([np.prod([signs[k] ** e[k] for k in range(self.n_dim)]) for e in self.powers])


def fit_polyridge(df: Any, var: Any = None, out: str = "y", n_dim: int = 1, n_degree: int = 2, domain: Any = None, density: Any = None, seed: int = 0, n_iter: int = 50) -> Model:
    """Polynomial of few projections: out_mean, inside Catalyst; fitted to all rows by passes of sums."""
    data = as_table(df).df
    names, outs = _names(data, var, out)
    ridge = Ridge(data, names, outs[0], n_dim, n_degree)
    u, c = ridge.fit(n_iter, seed)

    def predict(x: Any) -> dict[str, Any]:
        t = [sum(((x[v] - float(ridge.mid[i])) * float(u[i, k] / ridge.width[i] / ridge.root) for i, v in enumerate(names)), 0.0) for k in range(n_dim)]
        values = []
        for k in range(n_dim):
            p: list[Any] = [1.0, t[k]]
            for j in range(1, n_degree):
                p.append(((2 * j + 1) * t[k] * p[j] - j * p[j - 1]) / (j + 1))
            values.append(p)
        total: Any = ridge.level
        for e, b in zip(ridge.powers, c):
            term: Any = float(b)
            for k in range(n_dim):
                if e[k]:
                    term = values[k][e[k]] * term
            total = term + total
        return {f"{outs[0]}_mean": total}

    return Model("polyridge", (FunctionVectorized(predict, tuple(names), (f"{outs[0]}_mean",), "ridge"),), _domain(data, names, domain), density or Density())


ft_lm, ft_ols, ft_nls, ft_rf, ft_lolo, ft_gp, ft_kmeans, ft_polyridge = map(add_pipe, (fit_lm, fit_ols, fit_nls, fit_rf, fit_lolo, fit_gp, fit_kmeans, fit_polyridge))
