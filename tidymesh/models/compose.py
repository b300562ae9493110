"""Verbs that build models. ``model >> cp_function(...)`` gives a new model; the old one stays as it was."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from tidymesh.models.core import Copula, CopulaGaussian, CopulaIndependence, Density, Domain, Function, FunctionModel, FunctionVectorized, Model, getvars, uniform
from tidymesh.models.marginals import Marginal, MarginalNamed
from tidymesh.table import add_pipe, as_table


def _names(x: Any, prefix: str, start: int) -> tuple[str, ...]:
    if isinstance(x, int):
        return tuple(f"{prefix}{start + i}" for i in range(x))
    return (x,) if isinstance(x, str) else tuple(x)


def _add(model: Model, kind: type[Function], fun: Callable | None, var: Any, out: Any, name: str | None, runtime: float) -> Model:
    if fun is None or out is None:
        raise ValueError("a function and its outputs are needed")
    var = _names(getvars(fun) if var is None else var, "x", len(model.var))
    out = _names(out, "y", len(model.out))
    if clash := set(out) & set(model.out):
        raise ValueError(f"outputs {sorted(clash)} are made already")
    if clash := set(out) & (set(var) | set(model.var)):
        raise ValueError(f"{sorted(clash)} would be inputs and outputs")
    return model.with_(functions=(*model.functions, kind(fun, var, out, name or f"f{len(model.functions)}", runtime)))


def comp_function(model: Model, fun: Callable | None = None, var: Any = None, out: Any = None, name: str | None = None, runtime: float = 0.0) -> Model:
    """Add a function of a row's values. A number for ``var`` or ``out`` makes names x0, x1, ... or y0, y1, ..."""
    return _add(model, Function, fun, var, out, name, runtime)


def comp_vec_function(model: Model, fun: Callable | None = None, var: Any = None, out: Any = None, name: str | None = None, runtime: float = 0.0) -> Model:
    """Add a function of whole columns."""
    if var is None:
        raise ValueError("var is needed")
    return _add(model, FunctionVectorized, fun, var, out, name, runtime)


def comp_freeze(model: Model, df: Any = None, **var: float) -> Model:
    """Hold inputs at values, given by name or as a table of one row."""
    if df is not None:
        var = as_table(df).df.first().asDict() | var
    if unknown := set(var) - set(model.var):
        raise ValueError(f"no inputs {sorted(unknown)}")
    held = {v: float(x) for v, x in var.items()}
    fixed = FunctionVectorized(lambda x: dict(held), (), tuple(held), "(frozen)", 0.0)
    marginals = {v: m for v, m in model.density.marginals.items() if v not in held}
    copula = CopulaIndependence(tuple(marginals)) if model.density.copula and marginals else None
    bounds = {v: b for v, b in model.domain.bounds.items() if v not in held}
    return model.with_(functions=(fixed, *model.functions), domain=Domain(bounds), density=Density(marginals, copula))


def comp_md_det(model: Model, md: Model) -> Model:
    """Use another model as a function."""
    if clash := set(md.out) & set(model.out):
        raise ValueError(f"outputs {sorted(clash)} are made already")
    inner = FunctionModel(lambda x: x, tuple(md.var), tuple(md.out), md.name or "md", md.runtime(), md=md)
    return model.with_(functions=(*model.functions, inner))


def comp_md_sample(model: Model, md: Model, param: dict[str, list[str]] | None = None, rand2out: bool = False, seed: int = 0) -> Model:
    """Use another model with one random draw for each row; ``param`` names parameters of its laws that become inputs,
    called var_parameter. ``rand2out``: the draws are outputs too."""
    param = param or {}
    inputs = [f"{v}_{p}" for v, ps in param.items() for p in ps]
    var = tuple([v for v in md.var if v not in md.density.marginals] + inputs)
    out = tuple(([*md.var_rand] if rand2out else []) + md.out)

    def ev(inner: Model, df: Any) -> Any:
        index = F.xxhash64(*(F.col(f"`{v}`") for v in var), F.monotonically_increasing_id()) if var else F.monotonically_increasing_id()
        drawn = {}
        for v in inner.var_rand:
            marg = inner.density.marginals[v]
            u = uniform(index, seed, v)
            if v in param:
                if not isinstance(marg, MarginalNamed):
                    raise ValueError("only parameters of named laws can be inputs")
                from tidymesh.models.marginals import LAWS, Columns

                law = LAWS[marg.d_name]
                value = {p: F.col(f"`{v}_{p}`") if p in param[v] else float(marg.d_param.get(p, {"scale": 1.0}.get(p, 0.0))) for p in ("loc", "scale", *law.shapes)}
                drawn[v] = law.q(Columns, u, *(value[s] for s in law.shapes)) * value["scale"] + value["loc"]
            else:
                drawn[v] = marg.q(u)
        done = inner.apply(df.withColumns(drawn))
        return done if rand2out else done.drop(*drawn)

    return model.with_(functions=(*model.functions, FunctionModel(lambda x: x, var, out, md.name or "md", md.runtime(), md=md, ev=ev)))


def comp_bounds(model: Model, **bounds: Any) -> Model:
    """Bounds of inputs: name=(lower, upper)."""
    return model.with_(domain=Domain(model.domain.bounds | {v: (float(b[0]), float(b[1])) for v, b in bounds.items()}))


def comp_marginals(model: Model, **marginals: Any) -> Model:
    """Laws of inputs: marginals, or dicts with the law's name as "dist", its parameters and a sign."""
    made = {}
    for v, m in marginals.items():
        if isinstance(m, dict):
            rest = {k: x for k, x in m.items() if k not in ("dist", "sign")}
            m = MarginalNamed(m["dist"], rest, m.get("sign", 0))
        if not isinstance(m, Marginal):
            raise TypeError(f"{v}: a marginal or a dict")
        made[v] = m
    return model.with_(density=Density(model.density.marginals | made, model.density.copula))


def _copula(model: Model, copula: Copula) -> Model:
    return model.with_(density=Density(model.density.marginals, copula))


def comp_copula_independence(model: Model) -> Model:
    return _copula(model, CopulaIndependence(tuple(model.density.marginals)))


def comp_copula_gaussian(model: Model, df_corr: Any = None, df_data: Any = None) -> Model:
    """Normal-score correlations, given as (var1, var2, corr) or found in data."""
    if df_corr is None and df_data is None:
        raise ValueError("df_corr or df_data is needed")
    if df_corr is None:
        from tidymesh.transforms.statistics import tran_copula_corr

        df_corr = tran_copula_corr(df_data, model=model)
    pairs = tuple((r["var1"], r["var2"], float(r["corr"])) for r in as_table(df_corr).df.collect())
    copula = CopulaGaussian(tuple(model.density.marginals), pairs)
    if np_min(copula) <= 0:
        import warnings

        warnings.warn("the correlations are no positive definite matrix", stacklevel=2)
    return _copula(model, copula)


def np_min(copula: CopulaGaussian) -> float:
    import numpy as np

    return float(np.linalg.eigvalsh(copula.matrix()).min())


def comp_metamodel(model: Model, n: int = 100, ev: Callable | None = None, ft: Callable | None = None, seed: int = 0) -> Model:
    """A fit to a sample of the model: a Latin hypercube sample and linear fits, unless others are given."""
    from tidymesh.models.evaluate import eval_lhs
    from tidymesh.models.fit import fit_lm

    data = (ev or eval_lhs)(model, n=n, df_det="nom", seed=seed)
    return (ft or fit_lm)(data, var=model.var, out=model.out)


cp_function, cp_vec_function, cp_freeze, cp_md_det, cp_md_sample = map(add_pipe, (comp_function, comp_vec_function, comp_freeze, comp_md_det, comp_md_sample))
cp_bounds, cp_marginals, cp_copula_independence, cp_copula_gaussian, cp_metamodel = map(add_pipe, (comp_bounds, comp_marginals, comp_copula_independence, comp_copula_gaussian, comp_metamodel))
