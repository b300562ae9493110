"""Verbs that evaluate models: model to table."""

from __future__ import annotations

import itertools
import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.models.core import Model, invariants_eval_df, invariants_eval_model, levels, uniform
from tidymesh.table import Table, add_pipe, as_table


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def eval_df(model: Model, df: Any = None, append: bool = True) -> Table:
    """The model at each row of a table; outputs replace columns of their names."""
    invariants_eval_model(model)
    invariants_eval_df(df)
    table = as_table(df)
    if missing := [v for v in model.var if v not in table.columns]:
        raise ValueError(f"the table lacks inputs {missing}")
    out = model.apply(table.df.drop(*model.out))
    return table.to(out.select(*_cols([c for c in table.columns if c not in model.out] + model.out) if append else _cols(model.out)))


def _at_quantiles(model: Model, level: dict[str, float]) -> DataFrame:
    row = {v: float(model.density.marginals[v].q(level[v])) for v in model.var_rand}
    if not row:
        return _session().range(1).select()
    return _session().createDataFrame([tuple(row.values())], ", ".join(f"`{v}` double" for v in row))


def _design(model: Model, base: DataFrame, df_det: Any, append: bool, skip: bool) -> Table:
    design = model.var_outer(base, df_det)
    return Table(design) if skip else eval_df(model, design, append=append)


def eval_nominal(model: Model, df_det: Any = None, append: bool = True, skip: bool = False) -> Table:
    """Random inputs at their medians, with each level of the others."""
    invariants_eval_model(model, skip)
    return _design(model, _at_quantiles(model, dict.fromkeys(model.var_rand, 0.5)), df_det, append, skip)


def eval_conservative(model: Model, quantiles: Any = None, df_det: Any = None, append: bool = True, skip: bool = False) -> Table:
    """Random inputs at the quantile (0.01, or as given by name) on the side that their sign calls for."""
    invariants_eval_model(model, skip)
    given = quantiles if isinstance(quantiles, dict) else dict.fromkeys(model.var_rand, 0.01 if quantiles is None else quantiles)
    level = {v: 0.5 + (0.5 - given.get(v, 0.01)) * model.density.marginals[v].sign for v in model.var_rand}
    return _design(model, _at_quantiles(model, level), df_det, append, skip)


def eval_sample(model: Model, n: int, df_det: Any = None, seed: int = 0, append: bool = True, skip: bool = False, comm: bool = True, ind_comm: str | None = None) -> Table:
    """``n`` draws of the random inputs for each level of the others: the same draws for all levels, or others for each
    (``comm=False``). Draws are hashes of the row's index, so any number of executors makes them, and makes them again."""
    invariants_eval_model(model, skip)
    base = _session().range(int(n)).withColumnRenamed("id", "__i")
    if model.var_det and not comm:
        if df_det is None:
            raise ValueError(f"levels of {model.var_det} are needed: df_det")
        level = levels(model, df_det, base)
        rows = [tuple(map(float, r)) for r in level.collect()]  # the levels are given on the driver, or few
        numbered = _session().createDataFrame([(k, *r) for k, r in enumerate(rows)], "__k bigint, " + ", ".join(f"`{v}` double" for v in model.var_det))
        design = base.crossJoin(F.broadcast(numbered)).withColumn("__i", F.col("__i") + F.col("__k") * int(n)).drop("__k")
        design = model.density.sample(design, "__i", seed) if model.var_rand else design
    else:
        design = model.density.sample(base, "__i", seed) if model.var_rand else base
        design = model.var_outer(design, df_det)
    keep = [*( [F.col("__i").alias(ind_comm)] if ind_comm else []), *_cols(model.var)]
    design = design.select(*keep)
    return Table(design) if skip else eval_df(model, design, append=append)


def eval_lhs(model: Model, n: int, df_det: Any = None, seed: int = 0, append: bool = True, skip: bool = False) -> Table:
    """Latin hypercube sample: each of ``n`` equal slices of each input's law is drawn from once.

    The slices are dealt by a permutation of 0 to n - 1 that needs no sort (a Feistel network walked until it stays
    inside), so the sample is made where it is needed.
    """
    invariants_eval_model(model, skip)
    n = int(n)
    base = _session().range(n).withColumnRenamed("id", "__i")
    level = {f"__u:{v}": (permuted(F.col("__i"), n, seed, v) + uniform(F.col("__i"), seed, v)) / n for v in model.var_rand}
    made = {v: model.density.marginals[v].q(F.col(f"`__u:{v}`")) for v in model.var_rand}
    return _design(model, base.withColumns(level).withColumns(made).select(*_cols(model.var_rand)), df_det, append, skip)


def permuted(i: Column, n: int, seed: int, name: str) -> Column:
    """A permutation of 0 to n - 1."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    size = 1 << half

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(size - 1)
        for r in range(4):
            mix = F.pmod(F.xxhash64(right, F.lit(seed), F.lit(name), F.lit(r)), F.lit(size))
            left, right = right, left.bitwiseXOR(mix)
        return F.shiftleft(left, half).bitwiseOR(right)

    # a walk leaves [0, n) with chance under 3/4 at each step; 200 steps bring all back
    steps = F.sequence(F.lit(1), F.lit(200))
    first = once(i.cast("long"))
    return F.when(first < n, first).otherwise(F.aggregate(steps, first, lambda x, _: F.when(x < n, x).otherwise(once(x))))


def eval_grad_fd(model: Model, h: float = 1e-6, df_base: Any = None, var: Any = None, append: bool = True, skip: bool = False) -> Table:
    """Central differences of each output by each input, as Dout_Dvar; one pass, without a shuffle.

    ``var``: names, or "rand" or "det". ``h``: a step, or steps by name.
    """
    invariants_eval_model(model)
    table = as_table(df_base)
    names = model.var if var is None else model.var_rand if var == "rand" else model.var_det if var == "det" else list(var)
    step = h if isinstance(h, dict) else dict.fromkeys(names, h)
    df = table.df.drop(*model.out)
    # one row becomes 2k rows in an array, is evaluated, and is put together again, so any kind of function will do
    ids = [F.struct(F.lit(j).alias("j"), F.lit(s).alias("s"), *((F.col(f"`{v}`") + (s * step[v] if v == names[j] else 0.0)).alias(v) for v in model.var)) for j in range(len(names)) for s in (-1, 1)]
    made = all(f.columns({v: F.lit(0.0) for v in f.var}) is not None for f in model.functions)
    if made:
        grads = {}
        for v in names:
            sides = []
            for s in (1, -1):
                values = {x: F.col(f"`{x}`") for x in model.var}
                values[v] = values[v] + s * step[v]
                for f in model.functions:
                    values |= f.columns(values)
                sides.append(values)
            grads |= {f"D{o}_D{v}": (sides[0][o] - sides[1][o]) / (2 * step[v]) for o in model.out}
        kept = _cols(model.var) if append else []
        return Table(df.select(*kept, *(c.alias(k) for k, c in grads.items())))
    wide = df.withColumn("__row", F.monotonically_increasing_id()).select("__row", *(F.col(f"`{v}`").alias(f"__0{v}") for v in model.var), F.explode(F.array(*ids)).alias("x"))
    flat = wide.select("__row", *_cols([f"__0{v}" for v in model.var]), F.col("x.j").alias("__j"), F.col("x.s").alias("__s"), *(F.col("x")[v].alias(v) for v in model.var))
    done = model.apply(flat)
    aggs = [F.sum(F.when(F.col("__j") == j, F.col(f"`{o}`") * F.col("__s"))).alias(f"D{o}_D{v}") / (2 * step[v]) for j, v in enumerate(names) for o in model.out]
    keys = ["__row", *(f"__0{v}" for v in model.var)]
    out = done.groupBy(*_cols(keys)).agg(*(a.alias(f"D{o}_D{v}") for a, (v, o) in zip(aggs, itertools.product(names, model.out))))
    out = out.drop("__row").withColumnsRenamed({f"__0{v}": v for v in model.var})
    return Table(out if append else out.drop(*model.var))


def covariance(model: Model, n: int = 10_000, seed: int = 0) -> np.ndarray:
    """Of the random inputs, from a sample, in one pass of aggregates."""
    names = model.var_rand
    df = eval_sample(model, n, df_det="nom" if model.var_det else None, seed=seed, skip=True).df
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = df.agg(*(F.covar_samp(f"`{names[i]}`", f"`{names[j]}`").alias(f"c{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), x in zip(pairs, row):
        out[i, j] = out[j, i] = x
    return out


def eval_linup(model: Model, df_base: Any = None, append: bool = True, decomp: bool = False, decimals: int = 2, n: int = 10_000, seed: int = 0) -> Table:
    """Variance of each output by its linear part: gradient' covariance gradient, at each base point; ``decomp``: the
    share of each pair of inputs."""
    base = df_base if df_base is not None else eval_nominal(model, df_det="nom" if model.var_det else None, skip=True)
    cov, names = covariance(model, n, seed), model.var_rand
    grad = eval_grad_fd(model, df_base=base, var="rand").df
    rows = []
    for o in model.out:
        g = [F.col(f"`D{o}_D{v}`") for v in names]
        total = sum((g[i] * g[j] * float(cov[i, j]) for i in range(len(names)) for j in range(len(names))), F.lit(0.0))
        if not decomp:
            rows.append(F.struct(F.lit(o).alias("out"), total.alias("var")))
            continue
        for i in range(len(names)):
            for j in range(i, len(names)):
                part = g[i] * g[j] * float(cov[i, j]) * (1 if i == j else 2)
                rows.append(F.struct(F.lit(o).alias("out"), total.alias("var"), F.lit(f"{names[i]},{names[j]}").alias("var_in"), F.round(F.try_divide(part, total), decimals).alias("var_frac")))
    kept = _cols(model.var) if append else []
    out = grad.select(*kept, F.explode(F.array(*rows)).alias("__r"))
    fields = [f.name for f in out.schema["__r"].dataType.fields]
    return Table(out.select(*kept, *(F.col("__r")[f].alias(f) for f in fields)))


def eval_sinews(model: Model, n_density: int = 10, n_sweeps: int = 3, seed: int = 0, df_det: Any = None, varname: str = "sweep_var", indname: str = "sweep_ind", append: bool = True, skip: bool = False) -> Table:
    """Sweeps of one input at a time, from random origins; ``df_det="swp"`` sweeps the bounded inputs too."""
    invariants_eval_model(model, skip)
    swept = model.var_rand + (model.var_det if isinstance(df_det, str) and df_det == "swp" else [])
    base = _session().range(n_sweeps).withColumnRenamed("id", "__sweep")
    base = base.withColumn("__v", F.explode(F.array(*(F.lit(v) for v in swept)))).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n_density - 1))))
    along = F.col("__k") / max(1, n_density - 1)
    made = {}
    for v in swept:
        u = F.when(F.col("__v") == v, along).otherwise(uniform(F.col("__sweep"), seed, v))
        if v in model.density.marginals:
            made[v] = model.density.marginals[v].q(F.least(F.greatest(u, F.lit(1e-3)), F.lit(1 - 1e-3)))
        else:
            lo, up = model.domain.get_bound(v)
            made[v] = lo + (up - lo) * u
    index = (F.col("__sweep") * len(swept) + F.array_position(F.array(*(F.lit(v) for v in swept)), F.col("__v")) - 1).cast("long")
    design = base.select(F.col("__v").alias(varname), index.alias(indname), *(c.alias(v) for v, c in made.items()))
    if [v for v in model.var_det if v not in swept]:
        design = model.var_outer(design, df_det)
    return Table(design) if skip else eval_df(model, design, append=append)


def eval_hybrid(model: Model, n: int = 1, plan: str = "first", df_det: Any = None, varname: str = "hybrid_var", seed: int = 0, append: bool = True, skip: bool = False) -> Table:
    """Pick and freeze: a base block of ``n`` rows ("_") and one for each input, in which that input keeps the base's
    values (``plan="first"``) or alone takes others (``"total"``). The inputs must be independent."""
    from tidymesh.models.core import CopulaIndependence

    invariants_eval_model(model, skip)
    if plan not in ("first", "total"):
        raise ValueError("plan: first or total")
    if not isinstance(model.density.copula, CopulaIndependence):
        raise ValueError("the inputs must be independent")
    names = model.var_rand
    i, block = F.col("__i"), F.col("__b")
    base = _session().range(int(n)).withColumnRenamed("id", "__i").withColumn("__b", F.explode(F.array(*(F.lit(b) for b in ["_", *names]))))
    made = {}
    for v in names:
        kept, other = uniform(i, seed, v), uniform(i, seed, f"{v}'")
        same = (block == "_") | (block == v) if plan == "first" else block != v
        made[v] = model.density.marginals[v].q(F.when(same, kept).otherwise(other))
    design = base.select(block.alias(varname), i.alias("hybrid_ind"), *(c.alias(v) for v, c in made.items()))
    out = _design(model, design, df_det, append, skip)
    return out.to(out.df, meta={"plan": plan, "varname": varname, "out": model.out})


def _standard(model: Model, z: np.ndarray) -> dict[str, float]:
    """Inputs at independent standard normal scores."""
    from statistics import NormalDist

    names = model.var_rand
    scores = model.density.copula.root(names) @ z if model.density.copula is not None else z
    return {v: float(model.density.marginals[v].q(NormalDist().cdf(float(s)))) for v, s in zip(names, scores)}


def _limit(model: Model, out: str, det: dict[str, float]):
    def g(z: np.ndarray) -> float:
        return float(np.ravel(model.numbers({**det, **_standard(model, z)})[out])[0])

    return g


def _gradient(g: Any, z: np.ndarray, h: float = 1e-5) -> np.ndarray:
    return np.array([(g(z + h * e) - g(z - h * e)) / (2 * h) for e in np.eye(len(z))])


def _targets(beta: dict[str, float] | None, rel: dict[str, float] | None, pof: dict[str, float] | None) -> dict[str, float]:
    from statistics import NormalDist

    given = [x for x in (beta, rel, pof) if x is not None]
    if len(given) != 1:
        raise ValueError("one of betas, rels and pofs is needed")
    if rel is not None:
        return {o: NormalDist().inv_cdf(r) for o, r in rel.items()}
    return {o: -NormalDist().inv_cdf(p) for o, p in pof.items()} if pof is not None else dict(beta)


def _det_rows(model: Model, df_det: Any) -> list[dict[str, float]]:
    if not model.var_det:
        return [{}]
    return [{k: float(v) for k, v in r.asDict().items()} for r in levels(model, df_det, _session().range(1)).collect()]


def _found(rows: list[dict[str, float]]) -> Table:
    names = list(rows[0])
    return Table(_session().createDataFrame([tuple(float(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` double" for n in names)))


def eval_form_pma(model: Model, betas: Any = None, rels: Any = None, pofs: Any = None, df_det: Any = None, append: bool = True, tol: float = 1e-6, n_maxiter: int = 100, n_restart: int = 1, seed: int = 0) -> Table:
    """Reliability by performance measure: each output's least value on the sphere of its reliability index, by
    steps to the sphere's point against the gradient, damped when they turn round. A few points, so it is done on the
    driver. ``append``: with the most probable points."""
    wanted = _targets(betas, rels, pofs)
    rng, rows = np.random.default_rng(seed), []
    for det in _det_rows(model, df_det):
        row: dict[str, float] = dict(det)
        for out, beta in wanted.items():
            g, best = _limit(model, out, det), None
            for k in range(max(1, n_restart)):
                z = np.zeros(len(model.var_rand)) if k == 0 else rng.normal(size=len(model.var_rand))
                step = 1.0
                for _ in range(n_maxiter):
                    d = _gradient(g, z)
                    size = np.linalg.norm(d)
                    if size == 0:
                        break
                    to = z + step * (-beta * d / size - z)
                    to = beta * to / max(np.linalg.norm(to), 1e-12) if step < 1 or k or np.any(z) else -beta * d / size
                    if np.any(z) and g(to) > g(z) + 1e-12:
                        step /= 2
                        if step < 1e-6:
                            break
                        continue
                    moved, z = np.linalg.norm(to - z), to
                    if moved < tol:
                        break
                if best is None or g(z) < best[0]:
                    best = (g(z), z)
            row[out] = best[0]
            if append:
                row |= {f"{v}_{out}": x for v, x in _standard(model, best[1]).items()} if len(wanted) > 1 else _standard(model, best[1])
        rows.append(row)
    return _found(rows)


def eval_form_ria(model: Model, limits: list[str] | None = None, format: str = "betas", df_det: Any = None, append: bool = True, tol: float = 1e-8, n_maxiter: int = 200, n_restart: int = 1, seed: int = 0) -> Table:
    """Reliability by index: the nearest point to the origin at which each output is 0 (as beta_, rel_ or pof_), by
    Newton steps on the linear part with a merit function. Below 0 in the origin, the index is negative."""
    from statistics import NormalDist

    names = limits or model.out
    rng, rows = np.random.default_rng(seed), []
    for det in _det_rows(model, df_det):
        row: dict[str, float] = dict(det)
        for out in names:
            g, best = _limit(model, out, det), None
            for k in range(max(1, n_restart)):
                z = np.zeros(len(model.var_rand)) if k == 0 else rng.normal(size=len(model.var_rand))
                for _ in range(n_maxiter):
                    d = _gradient(g, z)
                    size = d @ d
                    if size == 0:
                        break
                    direction = (d @ z - g(z)) / size * d - z
                    c = 2 * np.linalg.norm(z) / math.sqrt(size) + 10.0
                    merit = lambda x: 0.5 * x @ x + c * abs(g(x))  # noqa: B023, E731
                    t = 1.0
                    while t > 1e-6 and merit(z + t * direction) > merit(z) + 1e-12:
                        t /= 2
                    z = z + t * direction
                    if np.linalg.norm(t * direction) < tol:
                        break
                if best is None or abs(g(z)) < 1e-4 and np.linalg.norm(z) < np.linalg.norm(best):
                    best = z
            beta = math.copysign(np.linalg.norm(best), g(np.zeros(len(best))))
            row[{"betas": f"beta_{out}", "rels": f"rel_{out}", "pofs": f"pof_{out}"}[format]] = {"betas": beta, "rels": NormalDist().cdf(beta), "pofs": NormalDist().cdf(-beta)}[format]
            if append:
                row |= {f"{v}_{out}": x for v, x in _standard(model, best).items()} if len(names) > 1 else _standard(model, best)
        rows.append(row)
    return _found(rows)


def nelder_mead(f: Any, x0: np.ndarray, lo: np.ndarray, up: np.ndarray, tol: float = 1e-10, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Least value within bounds, without derivatives."""
    clip = lambda x: np.minimum(np.maximum(x, lo), up)
    n = len(x0)
    scale = np.where(np.isfinite(up - lo), (up - lo) * 0.1, np.maximum(0.1 * np.abs(x0), 0.1))
    points = [clip(np.asarray(x0, float))]
    for i in range(n):
        x = points[0].copy()
        x[i] = x[i] + scale[i] if x[i] + scale[i] <= up[i] else x[i] - scale[i]
        points.append(clip(x))
    values = [f(x) for x in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= tol * (abs(values[0]) + tol) and max(np.abs(p - points[0]).max() for p in points) < 1e-9 * (1 + np.abs(points[0]).max()):
            break
        middle = np.mean(points[:-1], axis=0)
        to = clip(middle + (middle - points[-1]))
        v = f(to)
        if v < values[0]:
            far = clip(middle + 2 * (middle - points[-1]))
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (to, v)
        elif v < values[-2]:
            points[-1], values[-1] = to, v
        else:
            near = clip(middle + 0.5 * ((to if v < values[-1] else points[-1]) - middle))
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    i = int(np.argmin(values))
    return points[i], values[i]


def eval_min(model: Model, out_min: str, out_geq: list[str] | None = None, out_leq: list[str] | None = None, out_eq: list[str] | None = None, df_start: Any = None, n_restart: int = 1, seed: int = 0, rounds: int = 12) -> Table:
    """Inputs within their bounds at which an output is least, with others at least, at most or equal to 0: an augmented
    Lagrangian from several starts, on the driver, as each point is one evaluation."""
    names = model.var
    lo, up = (np.array([model.domain.get_bound(v)[k] for v in names]) for k in (0, 1))
    rng = np.random.default_rng(seed)
    starts = [np.array([float(r[v]) for v in names]) for r in as_table(df_start).df.select(*_cols(names)).collect()] if df_start is not None else [np.array([model.domain.get_nominal(v) for v in names])]
    starts = [np.nan_to_num(s) for s in starts]
    for _ in range(n_restart - 1):
        starts.append(np.where(np.isfinite(up - lo), lo + (np.where(np.isfinite(up - lo), up - lo, 0)) * rng.random(len(names)), rng.normal(size=len(names))))
    at = lambda x: {o: float(np.ravel(v)[0]) for o, v in model.numbers(dict(zip(names, x))).items()}
    rows = []
    for s in starts:
        x, mult, rho = s, {}, 10.0
        held = [("g", o) for o in out_geq or []] + [("l", o) for o in out_leq or []] + [("e", o) for o in out_eq or []]

        def part(kind: str, value: float, m: float, rho: float) -> float:
            c = value if kind != "g" else -value
            return m * c + rho / 2 * c * c if kind == "e" else (max(0.0, m + rho * c) ** 2 - m * m) / (2 * rho)

        for _ in range(rounds if held else 1):
            def lagrangian(y: np.ndarray) -> float:
                got = at(y)
                return got[out_min] + sum(part(k, got[o], mult.get(o, 0.0), rho) for k, o in held)  # noqa: B023

            for _ in range(3):
                x, _v = nelder_mead(lagrangian, x, lo, up)
            got = at(x)
            for k, o in held:
                c = got[o] if k != "g" else -got[o]
                mult[o] = mult.get(o, 0.0) + rho * c if k == "e" else max(0.0, mult.get(o, 0.0) + rho * c)
            rho = min(rho * 2, 1e5)
        got = at(x)
        broken = max([0.0, *(abs(got[o]) if k == "e" else max(0.0, -got[o] if k == "g" else got[o]) for k, o in held)])
        rows.append({**dict(zip(names, x)), **{o: got[o] for o in model.out}, "success": float(broken < 1e-4)})
    rows.sort(key=lambda r: (-r["success"], r[out_min]))
    return _found(rows)


def eval_nls(model: Model, df_data: Any = None, out: list[str] | None = None, var_fix: list[str] | None = None, df_init: Any = None, append: bool = False, tol: float = 1e-8, n_maxiter: int = 50, n_restart: int = 1, seed: int = 0) -> Table:
    """Parameters (inputs that the data lack) of least mean squared error, by damped Gauss-Newton steps.

    Each step is one pass over the data: residuals and their differences by each parameter are columns, and the
    normal equations are aggregates, so the data stay where they are.
    """
    from tidymesh.plans.storage import settle

    data = as_table(df_data).df
    outs = out or [o for o in model.out if o in data.columns]
    if not outs:
        raise ValueError("the data have none of the model's outputs")
    fixed = set(var_fix or [])
    names = [v for v in model.var if v not in data.columns and v not in fixed]
    lo, up = (np.array([model.domain.get_bound(v)[k] for v in names]) for k in (0, 1))
    values = {v: model.domain.get_nominal(v) for v in fixed if v not in data.columns}
    seen = settle(data.select(*_cols([v for v in model.var if v in data.columns]), *(F.col(f"`{o}`").cast("double").alias(f"__m{o}") for o in outs)), "nls")
    rng = np.random.default_rng(seed)
    if df_init is not None:
        starts = [np.array([float(r[v]) for v in names]) for r in as_table(df_init).df.select(*_cols(names)).collect()]
    else:
        starts = [np.nan_to_num(np.array([model.domain.get_nominal(v) for v in names]), nan=1.0)]
        starts += [np.where(np.isfinite(up - lo), lo + np.where(np.isfinite(up - lo), up - lo, 0.0) * rng.random(len(names)), rng.normal(size=len(names))) for _ in range(n_restart - 1)]

    def at(theta: np.ndarray) -> dict[str, Column]:
        known = {v: F.col(f"`{v}`") for v in model.var if v in data.columns} | {v: F.lit(float(x)) for v, x in values.items()} | {v: F.lit(float(x)) for v, x in zip(names, theta)}
        for f in model.functions:
            got = f.columns(known)
            if got is None:
                raise ValueError("eval_nls needs functions of columns")
            known |= got
        return known

    def normal(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        h = 1e-6 * np.maximum(1.0, np.abs(theta))
        base = at(theta)
        sides = [(at(theta + h[i] * e), at(theta - h[i] * e)) for i, e in enumerate(np.eye(len(theta)))]
        r = {o: F.col(f"`__m{o}`") - base[o] for o in outs}
        j = {o: [(a[o] - b[o]) / float(2 * h[i]) for i, (a, b) in enumerate(sides)] for o in outs}
        cols = [r[o] for o in outs] + [c for o in outs for c in j[o]]
        step = seen.select(*(c.alias(f"c{k}") for k, c in enumerate(cols)))
        k, m = len(outs), len(theta)
        jc = lambda o, i: F.col(f"c{k + o * m + i}")
        aggs = [sum((F.avg(F.col(f"c{o}") * F.col(f"c{o}")) for o in range(k)), F.lit(0.0))]
        aggs += [sum((F.avg(jc(o, i) * F.col(f"c{o}")) for o in range(k)), F.lit(0.0)) for i in range(m)]
        aggs += [sum((F.avg(jc(o, i) * jc(o, l)) for o in range(k)), F.lit(0.0)) for i in range(m) for l in range(m)]
        row = step.agg(*(a.alias(f"a{x}") for x, a in enumerate(aggs))).first()
        return float(row[0]), np.array(row[1 : 1 + m], float), np.array(row[1 + m :], float).reshape(m, m)

    rows = []
    for theta in starts:
        theta = np.minimum(np.maximum(theta, lo), up)
        damp, (err, g, hess) = 1e-3, normal(theta)
        for _ in range(n_maxiter):
            delta = np.linalg.lstsq(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-12)), g, rcond=None)[0]
            to = np.minimum(np.maximum(theta + delta, lo), up)
            new = normal(to)
            if new[0] <= err:
                done = err - new[0] <= tol * max(err, 1e-30) or np.abs(to - theta).max() < 1e-12
                theta, (err, g, hess), damp = to, new, damp / 5
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e8:
                    break
        rows.append({**dict(zip(names, theta)), **values, "mse": err})
    rows.sort(key=lambda r: r["mse"])
    return _found(rows if append or len(rows) > 1 else rows[:1])


def pareto_min_rel(X_test: Any, X_base: Any = None) -> DataFrame:
    """``X_test`` plus ``optimal``: no row of the base (or no other row of its own) is as good in all columns.

    The base is thinned to its own best rows first, slice by slice, so the comparison is with few rows.
    """
    from tidymesh.transforms.pareto import thin

    test = as_table(X_test).df
    names = test.columns
    base = test if X_base is None else as_table(X_base).df.select(*_cols(names))
    best = thin(base, names)
    marked = test.withColumn("__row", F.monotonically_increasing_id())
    on = None
    for c in names:
        cond = F.col(f"b.`{c}`") <= F.col(f"t.`{c}`")
        on = cond if on is None else on & cond
    if X_base is None:
        strictly = None
        for c in names:
            cond = F.col(f"b.`{c}`") < F.col(f"t.`{c}`")
            strictly = cond if strictly is None else strictly | cond
        # a row of several copies is matched by its copy
        on = on & (strictly | (F.col("b.__n") > 1))
    beaten = marked.alias("t").join(best.alias("b"), on, "left_semi").select("__row", F.lit(True).alias("__beaten"))
    return marked.join(beaten, "__row", "left").select(*_cols(names), F.col("__beaten").isNull().alias("optimal"))


def floor_sig(sig: np.ndarray, sig_min: float = 1e-8) -> np.ndarray:
    return np.maximum(sig, sig_min)


def make_proposal_sigma(X: np.ndarray, idx_pareto: np.ndarray, X_cov: np.ndarray) -> np.ndarray:
    """Covariance of the proposal: the spread of the best points, or their own errors where these are larger."""
    best = np.asarray(X)[np.asarray(idx_pareto, bool)]
    spread = np.cov(best.T) if len(best) > 1 else np.zeros((X.shape[1], X.shape[1]))
    u, s, _ = np.linalg.svd(np.atleast_2d(spread))
    return u @ np.diag(floor_sig(s, max(1e-8, float(np.mean([np.trace(c) for c in X_cov])) / X.shape[1]))) @ u.T


def rprop(n: int, Sigma: np.ndarray, X_means: np.ndarray, seed: int = 0) -> np.ndarray:
    """Draws from an even mixture of normal laws at the means."""
    rng = np.random.default_rng(seed)
    return X_means[rng.integers(0, len(X_means), n)] + rng.normal(size=(n, X_means.shape[1])) @ np.linalg.cholesky(Sigma).T


#: Points whose densities at all draws are held at once.
HELD = 64


def dprop(X: np.ndarray, Sigma: np.ndarray, X_means: np.ndarray) -> np.ndarray:
    """Density of an even mixture of normal laws of one covariance; lengths are taken by the covariance's root, equal means once."""
    X, root = np.atleast_2d(X), np.linalg.inv(np.linalg.cholesky(Sigma)).T
    means, copies = np.unique(np.atleast_2d(X_means), axis=0, return_counts=True)
    x, means = X @ root, means @ root
    total = np.zeros(len(x))
    for k in range(0, len(means), HELD):
        far = sum((x[:, i, None] - means[None, k : k + HELD, i]) ** 2 for i in range(x.shape[1]))
        total += np.exp(-0.5 * far) @ copies[k : k + HELD]
    return total / len(np.atleast_2d(X_means)) / math.sqrt((2 * math.pi) ** X.shape[1] * np.linalg.det(Sigma))


def approx_pnd(X_pred: np.ndarray, X_cov: np.ndarray, X_train: np.ndarray, signs: np.ndarray, n: int = 10_000, seed: int = 0) -> np.ndarray:
    """Chance that each predicted point is dominated by no training point, by importance sampling.

    ``signs``: +1 for costs to lower, -1 for gains to raise."""
    pred, train = np.asarray(X_pred) * signs, np.asarray(X_train) * signs
    best = np.array([not ((train <= t).all(axis=1) & (train < t).any(axis=1)).any() for t in train])
    sigma = make_proposal_sigma(train, best, X_cov)
    draws = np.concatenate([rprop(n // 2, sigma, train[best], seed), rprop(n - n // 2, np.mean(X_cov, axis=0) * 4 + 1e-12 * np.eye(train.shape[1]), pred, seed + 1)])
    free = ~(train[best][None] <= draws[:, None]).all(axis=2).any(axis=1)
    q = 0.5 * dprop(draws, sigma, train[best]) + 0.5 * dprop(draws, np.mean(X_cov, axis=0) * 4 + 1e-12 * np.eye(train.shape[1]), pred)
    q, cov, out = np.maximum(q, 1e-300), np.asarray(X_cov, float), []
    for k in range(0, len(pred), HELD):
        at, c = pred[k : k + HELD], cov[k : k + HELD]
        # draws x points: a point's density at each draw, by its own errors
        far, inverse = draws[:, None] - at[None], np.linalg.inv(c)
        pairs = [(i, j) for i in range(at.shape[1]) for j in range(at.shape[1]) if inverse[:, i, j].any()]
        w = np.exp(-0.5 * sum(far[..., i] * inverse[:, i, j] * far[..., j] for i, j in pairs))
        w /= q[:, None] * np.sqrt((2 * math.pi) ** at.shape[1] * np.linalg.det(c))
        out.append(free @ w / np.maximum(w.sum(axis=0), 1e-300))
    return np.concatenate(out) if out else np.array([])


def eval_pnd(model: Model, df_train: Any, df_test: Any, signs: dict[str, int], n: int = 10_000, seed: int = 0, append: bool = True, mean_prefix: str = "_mean", sd_prefix: str = "_sd") -> Table:
    """Each test row's chance to be dominated by no training row, by the model's predicted means and deviations.

    The training rows are thinned to the best ones in Spark; these go to the executors. Test rows are dealt evenly to tasks, as each costs ``n`` densities,
    and done in Arrow batches, equal predictions of a batch once."""
    from tidymesh.transforms.pareto import thin

    outs = list(signs)
    sign = np.array([signs[o] for o in outs], float)
    train = as_table(df_train).df.select(*((F.col(f"`{o}`") * float(signs[o])).alias(o) for o in outs))
    best = thin(train, outs).select(*_cols(outs)).toPandas().to_numpy(float) * sign
    pred = eval_df(model, df_test).df
    schema = T.StructType([*pred.schema.fields, T.StructField("pr_scores", T.DoubleType())])

    def run(frames):
        for f in frames:
            x = f[[o + mean_prefix for o in outs]].to_numpy(float)
            sd = floor_sig(f[[o + sd_prefix for o in outs]].to_numpy(float))
            told, at = np.unique(np.hstack([x, sd]), axis=0, return_inverse=True)
            cov = np.array([np.diag(s * s) for s in told[:, len(outs) :]])
            yield f.assign(pr_scores=approx_pnd(told[:, : len(outs)], cov, best, sign, n, seed)[at.ravel()] if len(f) else [])

    pred = pred.repartition(int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = pred.mapInPandas(run, schema)
    return Table(out if append else out.select("pr_scores"))


#: Marching squares: for each of 16 cases (1: lower left is above, 2: lower right, 4: upper right, 8: upper left), the
#: pairs of sides that a segment joins (0 bottom, 1 right, 2 top, 3 left).
SQUARE = {0: [], 1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 5: [(3, 2), (0, 1)], 6: [(0, 2)], 7: [(3, 2)], 8: [(2, 3)], 9: [(0, 2)], 10: [(3, 0), (1, 2)], 11: [(1, 2)], 12: [(1, 3)], 13: [(0, 1)], 14: [(3, 0)], 15: []}


def marching_square(df: DataFrame, x: str, y: str, z: str, level: Column, keys: list[str]) -> DataFrame:
    """Segments (x_start, y_start, x_end, y_end) of the contour of ``z`` at ``level`` on a grid with places __i, __j.

    Each cell's four corners meet by windows along the two axes; the case picks the sides, and crossings are
    interpolated, all inside Catalyst."""
    part = [F.col(f"`{k}`") for k in keys]
    along = Window.partitionBy(*part, "__j").orderBy("__i")
    up = Window.partitionBy(*part, "__i").orderBy("__j")
    here = df.withColumn("__z", F.col(f"`{z}`")).withColumn("__x1", F.lead(f"`{x}`").over(along)).withColumn("__b", F.lead("__z").over(along)).withColumn("__y1", F.lead(f"`{y}`").over(up))
    here = here.withColumn("__d", F.lead("__z").over(up)).withColumn("__c", F.lead("__b").over(up)).where(F.col("__c").isNotNull() & F.col("__b").isNotNull() & F.col("__d").isNotNull())
    a, b, c, d = F.col("__z"), F.col("__b"), F.col("__c"), F.col("__d")
    x0, x1, y0, y1 = F.col(f"`{x}`"), F.col("__x1"), F.col(f"`{y}`"), F.col("__y1")
    t = lambda p, q: F.coalesce(F.try_divide(level - p, q - p), F.lit(0.5))
    sides = [(x0 + (x1 - x0) * t(a, b), y0), (x1, y0 + (y1 - y0) * t(b, c)), (x0 + (x1 - x0) * t(d, c), y1), (x0, y0 + (y1 - y0) * t(a, d))]
    case = sum(((v >= level).cast("int") * w for v, w in ((a, 1), (b, 2), (c, 4), (d, 8))), F.lit(0))
    none = F.array().cast("array<struct<x_start:double,y_start:double,x_end:double,y_end:double>>")
    found = none
    for k, pairs in SQUARE.items():
        if pairs:
            segs = F.array(*(F.struct(sides[p][0].alias("x_start"), sides[p][1].alias("y_start"), sides[q][0].alias("x_end"), sides[q][1].alias("y_end")) for p, q in pairs))
            found = F.when(F.col("__case") == k, segs).otherwise(found)
    out = here.withColumn("__case", case).withColumn("__s", F.explode(found))
    return out.select(*part, *(F.col("__s")[f].alias(f) for f in ("x_start", "y_start", "x_end", "y_end")))


def eval_contour(model: Model, var: tuple[str, str], out: Any = None, df: Any = None, levels: Any = None, n_side: int = 20, n_levels: int = 5) -> Table:
    """Contours of outputs over two bounded inputs, at each row of ``df`` for the others: out, level and segments."""
    x, y = var
    outs = [out] if isinstance(out, str) else list(out or model.out)
    rest = [v for v in model.var if v not in var]
    if any(not all(map(math.isfinite, model.domain.get_bound(v))) for v in var):
        raise ValueError("the two inputs need finite bounds")
    (xl, xu), (yl, yu) = (model.domain.get_bound(v) for v in var)
    grid = _session().range(n_side * n_side).select(F.floor(F.col("id") / n_side).cast("int").alias("__j"), (F.col("id") % n_side).cast("int").alias("__i"))
    grid = grid.select("*", (F.lit(xl) + (xu - xl) * F.col("__i") / (n_side - 1)).alias(x), (F.lit(yl) + (yu - yl) * F.col("__j") / (n_side - 1)).alias(y))
    if rest:
        if df is None:
            raise ValueError(f"values of {rest} are needed: df")
        grid = grid.crossJoin(F.broadcast(as_table(df).df.select(*_cols(rest))))
    done = model.apply(grid)
    parts = []
    for o in outs:
        if levels is not None:
            wanted = list(levels[o] if isinstance(levels, dict) else levels)
        else:
            lo, hi = done.agg(F.min(f"`{o}`"), F.max(f"`{o}`")).first()
            wanted = [lo + (hi - lo) * (k + 1) / (n_levels + 1) for k in range(n_levels)]
        each = done.withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in wanted))))
        parts.append(marching_square(each, x, y, o, F.col("level"), ["level", *rest]).withColumn("out", F.lit(o)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return Table(whole)


ev_df, ev_nominal, ev_conservative, ev_sample, ev_lhs, ev_grad_fd = map(add_pipe, (eval_df, eval_nominal, eval_conservative, eval_sample, eval_lhs, eval_grad_fd))
ev_linup, ev_sinews, ev_hybrid, ev_form_pma, ev_form_ria = map(add_pipe, (eval_linup, eval_sinews, eval_hybrid, eval_form_pma, eval_form_ria))
ev_min, ev_nls, ev_pnd, ev_contour = map(add_pipe, (eval_min, eval_nls, eval_pnd, eval_contour))
