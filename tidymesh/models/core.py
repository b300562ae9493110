"""Models: functions in order, bounds of inputs, and the joint law of the random ones."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.models.marginals import Marginal
from tidymesh.table import Table, as_table

Values = dict[str, Any]


def getvars(f: Callable[..., Any]) -> list[str]:
    """Names of a function's arguments."""
    return list(inspect.signature(f).parameters)


@dataclass(frozen=True)
class Function:
    """A map from ``var`` to ``out`` of one row's values, in the order of ``var``.

    It is first called with Spark columns; if it builds columns from them, it runs inside Catalyst. Else it runs
    row by row in Python over Arrow batches.
    """

    func: Callable[..., Any]
    var: tuple[str, ...]
    out: tuple[str, ...]
    name: str = "f"
    runtime: float = 0.0

    def spread(self, n: int) -> bool:
        """Whether the function takes its ``n`` values one by one, not as a list."""
        return n != 1 and len(getvars(self.func)) == n

    def call(self, x: list[Any]) -> Any:
        return self.func(*x) if self.spread(len(x)) else self.func(x)

    def _outs(self, got: Any) -> list[Any]:
        if isinstance(got, dict):
            return [got[o] for o in self.out]
        return list(got) if isinstance(got, (list, tuple)) or isinstance(got, np.ndarray) and len(self.out) > 1 else [got]

    def columns(self, values: Values) -> dict[str, Column] | None:
        try:
            outs = self._outs(self.call([values[v] for v in self.var]))
        except Exception:  # noqa: BLE001  it is no function of columns, so it runs in Python
            return None
        if len(outs) != len(self.out) or not all(isinstance(o, (Column, int, float)) for o in outs):
            return None
        return {o: (c if isinstance(c, Column) else F.lit(c)).cast("double") for o, c in zip(self.out, outs)}

    def numbers(self, values: Values) -> Values:
        rows = np.broadcast_arrays(*(np.atleast_1d(np.asarray(values[v], float)) for v in self.var))
        call = self.func if self.spread(len(rows)) else lambda *x: self.func(list(x))
        got = [self._outs(call(*x)) for x in zip(*(x.tolist() for x in rows))]
        return {o: np.array([g[k] for g in got], float) for k, o in enumerate(self.out)}

    def apply(self, df: DataFrame) -> DataFrame:
        made = self.columns({v: F.col(f"`{v}`") for v in self.var})
        if made is not None:
            return df.withColumns(made)
        kept = [f for f in df.schema.fields if f.name not in self.out]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{o}` double" for o in self.out)])
        names, this = [f.name for f in kept], self

        def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for frame in frames:
                yield frame[names].assign(**this.numbers({v: frame[v] for v in this.var})) if len(frame) else frame[names].assign(**{o: pd.Series(dtype=float) for o in this.out})

        return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class FunctionVectorized(Function):
    """A map of whole columns: ``func`` takes an object with the inputs as attributes and items, and gives the outputs
    as a dict, a table-like object or in order."""

    def call(self, x: list[Any]) -> Any:
        return self.func(Inputs(dict(zip(self.var, x))))

    def numbers(self, values: Values) -> Values:
        outs = self._outs(self.call([np.asarray(values[v], float) for v in self.var]))
        n = np.broadcast(*(np.asarray(values[v]) for v in self.var)).shape if self.var else ()
        return {o: np.broadcast_to(np.asarray(x, float), n) for o, x in zip(self.out, outs)}

    def _outs(self, got: Any) -> list[Any]:
        return [got[o] for o in self.out] if isinstance(got, (dict, pd.DataFrame)) else super()._outs(got)


class Inputs(dict):
    __getattr__ = dict.__getitem__


@dataclass(frozen=True)
class FunctionModel(Function):
    """A model as one function of another; ``ev``: an evaluator of its own, table to table."""

    md: Model | None = None
    ev: Callable[[Model, DataFrame], DataFrame] | None = None

    def columns(self, values: Values) -> dict[str, Column] | None:
        got = dict(values)
        for f in self.md.functions:
            made = f.columns(got)
            if made is None:
                return None
            got |= made
        return {o: got[o] for o in self.out}

    def numbers(self, values: Values) -> Values:
        got = self.md.numbers(values)
        return {o: got[o] for o in self.out}

    def apply(self, df: DataFrame) -> DataFrame:
        return self.ev(self.md, df) if self.ev else self.md.apply(df)


@dataclass(frozen=True)
class Domain:
    """Bounds by variable; infinite ends are allowed."""

    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def get_bound(self, var: str) -> tuple[float, float]:
        return self.bounds.get(var, (-math.inf, math.inf))

    def get_width(self, var: str) -> float:
        lo, up = self.get_bound(var)
        return up - lo

    def get_nominal(self, var: str) -> float:
        """The middle, or the finite end; without any, nothing is known."""
        lo, up = self.get_bound(var)
        if math.isfinite(lo) and math.isfinite(up):
            return (lo + up) / 2
        return lo if math.isfinite(lo) else up if math.isfinite(up) else math.nan


def uniform(index: Column, seed: int, name: str) -> Column:
    """A number in (0, 1) for each row index: 48 bits of a hash of (index, seed, name), so that lost tasks, other
    partitions and other engines draw the same numbers."""
    digits = F.substring(F.md5(F.concat_ws("/", index.cast("string"), F.lit(str(seed)), F.lit(name))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


class Copula:
    """How uniform numbers become the joint law of quantile levels."""

    def sample(self, df: DataFrame, seed: int, var: list[str]) -> DataFrame:
        """Uniform columns __u:name become levels of that name; each step is a projection of its own, so that what it
        needs several times is there as a column."""
        raise NotImplementedError

    def d(self, u: dict[str, Any]) -> Any:
        raise NotImplementedError


@dataclass(frozen=True)
class CopulaIndependence(Copula):
    var_rand: tuple[str, ...] = ()

    def sample(self, df: DataFrame, seed: int, var: list[str]) -> DataFrame:
        return df

    def d(self, u: dict[str, Any]) -> Any:
        return 1.0

    def root(self, var: list[str]) -> np.ndarray:
        return np.eye(len(var))


@dataclass(frozen=True)
class CopulaGaussian(Copula):
    """Normal scores with the correlations given as (var1, var2, corr)."""

    var_rand: tuple[str, ...]
    pairs: tuple[tuple[str, str, float], ...]

    def matrix(self, var: list[str] | None = None) -> np.ndarray:
        names = list(var or self.var_rand)
        out = np.eye(len(names))
        for a, b, r in self.pairs:
            if a in names and b in names:
                i, j = names.index(a), names.index(b)
                out[i, j] = out[j, i] = r
        return out

    def root(self, var: list[str]) -> np.ndarray:
        return np.linalg.cholesky(self.matrix(var))

    def sample(self, df: DataFrame, seed: int, var: list[str]) -> DataFrame:
        from tidymesh.functions.scalar import pnorm, qnorm

        low = self.root(var)
        df = df.withColumns({f"__z:{v}": qnorm(F.col(f"`__u:{v}`")) for v in var})
        mixed = {f"__z:{v}'": sum((F.col(f"`__z:{var[j]}`") * float(low[i, j]) for j in range(i + 1) if low[i, j]), F.lit(0.0)) for i, v in enumerate(var)}
        df = df.withColumns(mixed).drop(*(f"__z:{v}" for v in var))
        return df.withColumns({f"__u:{v}": pnorm(F.col(f"`__z:{v}'`")) for v in var}).drop(*mixed)

    def d(self, u: dict[str, Any]) -> Any:
        from tidymesh.models.marginals import _of

        names = list(u)
        m = _of(next(iter(u.values())))
        z = [m.qnorm(u[v]) for v in names]
        r = self.matrix(names)
        a = np.linalg.inv(r) - np.eye(len(names))
        quad = sum(z[i] * z[j] * float(a[i, j]) for i in range(len(names)) for j in range(len(names)))
        return m.exp(quad * -0.5) / math.sqrt(np.linalg.det(r))


@dataclass(frozen=True)
class Density:
    marginals: dict[str, Marginal] = field(default_factory=dict)
    copula: Copula | None = None

    def pr2sample(self, u: dict[str, Any]) -> dict[str, Any]:
        return {v: self.marginals[v].q(x) for v, x in u.items()}

    def sample2pr(self, x: dict[str, Any]) -> dict[str, Any]:
        return {v: self.marginals[v].p(y) for v, y in x.items()}

    def d(self, x: dict[str, Any]) -> Any:
        """Joint density."""
        out = self.copula.d(self.sample2pr(x)) if self.copula and not isinstance(self.copula, CopulaIndependence) else 1.0
        for v, m in self.marginals.items():
            out = m.d(x[v]) * out
        return out

    def sample(self, df: DataFrame, index: str, seed: int) -> DataFrame:
        """``df`` plus a draw of each random input, by the row's ``index``."""
        if self.copula is None:
            raise ValueError("a density without a copula can't be sampled; comp_copula_independence sets one")
        names = list(self.marginals)
        df = self.copula.sample(df.withColumns({f"__u:{v}": uniform(F.col(index), seed, v) for v in names}), seed, names)
        return df.withColumns({v: self.marginals[v].q(F.col(f"`__u:{v}`")) for v in names}).drop(*(f"__u:{v}" for v in names))


@dataclass(frozen=True)
class Model:
    """Functions are run in order; the names keep the order in which they came."""

    name: str | None = None
    functions: tuple[Function, ...] = ()
    domain: Domain = field(default_factory=Domain)
    density: Density = field(default_factory=Density)

    def with_(self, **changes: Any) -> Model:
        return replace(self, **changes)

    @property
    def out(self) -> list[str]:
        return list(dict.fromkeys(o for f in self.functions for o in f.out))

    @property
    def var(self) -> list[str]:
        seen: dict[str, None] = dict.fromkeys([*self.domain.bounds, *self.density.marginals])
        made: set[str] = set()
        for f in self.functions:
            seen |= dict.fromkeys(v for v in f.var if v not in made)
            made |= set(f.out)
        return [v for v in seen if v not in made]

    @property
    def var_rand(self) -> list[str]:
        return [v for v in self.var if v in self.density.marginals]

    @property
    def var_det(self) -> list[str]:
        return [v for v in self.var if v not in self.density.marginals]

    def runtime(self, n: int = 1) -> float:
        """Stated seconds for ``n`` evaluations."""
        return n * sum(f.runtime for f in self.functions)

    def det_nom(self) -> dict[str, float]:
        return {v: self.domain.get_nominal(v) for v in self.var_det}

    def apply(self, df: DataFrame) -> DataFrame:
        for f in self.functions:
            df = f.apply(df)
        return df

    def evaluate_df(self, df: DataFrame) -> DataFrame:
        """The outputs only."""
        if missing := [v for v in self.var if v not in df.columns]:
            raise ValueError(f"the table lacks inputs {missing}")
        return self.apply(df).select(*(F.col(f"`{o}`") for o in self.out))

    def numbers(self, values: Values) -> Values:
        """The same on the driver, for searches over a few points."""
        got = dict(values)
        for f in self.functions:
            got |= f.numbers(got)
        return got

    def var_outer(self, df: DataFrame, df_det: Any = None) -> DataFrame:
        """Each row with each row of levels of the deterministic inputs (a small table, or "nom")."""
        if not self.var_det:
            return df
        if df_det is None:
            raise ValueError(f"levels of {self.var_det} are needed: df_det")
        return df.crossJoin(F.broadcast(levels(self, df_det, df)))

    def dag(self, spark: Any) -> DataFrame:
        """Edges (source, target, variable) between functions, "(var)" and "(out)"."""
        made: dict[str, str] = {}
        rows = []
        for f in self.functions:
            rows += [(made.get(v, "(var)"), f.name, v) for v in f.var]
            made |= dict.fromkeys(f.out, f.name)
        rows += [(src, "(out)", o) for o, src in made.items()]
        return spark.createDataFrame(rows, "source string, target string, variable string")


def levels(model: Model, df_det: Any, like: DataFrame) -> DataFrame:
    """A table of levels, "nom" for the nominal ones; the model's deterministic inputs only."""
    if isinstance(df_det, str):
        if df_det != "nom":
            raise ValueError('df_det: a table of levels or "nom"')
        row = model.det_nom()
        return like.sparkSession.createDataFrame([tuple(float(row[v]) for v in model.var_det)], ", ".join(f"`{v}` double" for v in model.var_det))
    given = as_table(df_det).df
    if missing := [v for v in model.var_det if v not in given.columns]:
        raise ValueError(f"the levels lack {missing}")
    return given.select(*(F.col(f"`{v}`") for v in model.var_det))


def invariants_eval_model(model: Any, skip: bool = False) -> None:
    if not isinstance(model, Model):
        raise TypeError(f"a model, not {type(model).__name__}")
    if not model.functions and not skip:
        raise ValueError("the model has no functions")


def invariants_eval_df(df: Any, arg_name: str = "df", valid_str: Iterable[str] = (), acc_none: bool = False) -> None:
    if df is None:
        if not acc_none:
            raise ValueError(f"{arg_name} is needed")
    elif isinstance(df, str):
        if df not in valid_str:
            raise ValueError(f"{arg_name}: a table or one of {list(valid_str)}")
    elif not isinstance(df, (Table, DataFrame)):
        raise TypeError(f"{arg_name}: a table, not {type(df).__name__}")
