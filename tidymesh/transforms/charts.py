"""The tables behind charts: what would be drawn, ready for any plotting library."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tidymesh.operators.reshape import unpivoted
from tidymesh.operators.select import quoted
from tidymesh.table import Table, add_pipe, verb
from tidymesh.transforms.spc import tran_xbs


@verb
def plot_contour(df: Table, out: str = "out", level: str = "level") -> Table:
    """Segments by output and level, as they come from eval_contour."""
    return df.to(df.df.select("x_start", "y_start", "x_end", "y_end", out, level))


@verb
def plot_corrtile(df: Table, var: str = "var", out: str = "out", corr: str = "rho") -> Table:
    """Tiles with their label."""
    return df.to(df.df.select(F.col(f"`{var}`").alias("x"), F.col(f"`{out}`").alias("y"), F.col(f"`{corr}`").alias("fill"), F.format_number(f"`{corr}`", 2).alias("label")))


@verb
def plot_sobol_outputs(df: Table, idx: str = "ind") -> Table:
    """Indices as tiles: a row for each input and output."""
    outs = [c for c in df.columns if c not in ("var", idx)]
    return df.to(unpivoted(df.df, ["var", idx], outs, "out", "value"))


@verb
def plot_scattermat(df: Table, var: list[str], rows: int | None = None) -> Table:
    """Pairs of columns for a scatter matrix, of all rows, or of a random sample of ``rows`` rows where that is given."""
    kept = df.df.select(*quoted(var))
    if rows is not None:
        kept = kept.orderBy(F.rand(1)).limit(rows)
    pairs = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a in var for b in var if a != b]
    return df.to(kept.select(F.explode(F.array(*pairs)).alias("p")).select("p.*"))


@verb
def plot_hists(df: Table, out: list[str], bins: int = 30) -> Table:
    """Bins of each column: out, bin, lower end and count; ranges in one pass, counts in another."""
    lo = {c: f"lo{i}" for i, c in enumerate(out)}
    ends = df.df.agg(*(f(F.col(f"`{c}`")).cast("double").alias(f"{n}{i}") for i, c in enumerate(out) for n, f in (("lo", F.min), ("up", F.max))))
    both = df.df.select(*quoted(out)).crossJoin(F.broadcast(ends))  # one row
    cells = []
    for i, c in enumerate(out):
        width = F.greatest((F.col(f"up{i}") - F.col(lo[c])) / bins, F.lit(1e-300))
        k = F.least(F.floor((F.col(f"`{c}`") - F.col(lo[c])) / width), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("out"), k.alias("bin"), (F.col(lo[c]) + k * width).alias("lower")))
    long = both.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bin IS NOT NULL")
    return Table(long.groupBy("out", "bin").agg(F.min("lower").alias("lower"), F.count(F.lit(1)).alias("n")))


@verb
def plot_sinew_inputs(df: Table, var: list[str], sweep_ind: str = "sweep_ind", rows: int | None = None) -> Table:
    """The design of sweeps as pairs of inputs."""
    return plot_scattermat(df, var, rows=rows)


@verb
def plot_sinew_outputs(df: Table, var: list[str], out: list[str], sweep_ind: str = "sweep_ind", sweep_var: str = "sweep_var") -> Table:
    """Each output along the input that was swept: two melts, of which the rows of the swept input stay."""
    long = unpivoted(df.df, [sweep_ind, sweep_var, *out], var, "_var", "_x").where(F.col("_var") == F.col(f"`{sweep_var}`"))
    return df.to(unpivoted(long, [sweep_ind, sweep_var, "_x"], out, "_out", "_y"))


def plot_xbs(df: Any, group: Any, var: Any, n_side: int = 9, n_delta: int = 6) -> Table:
    return tran_xbs(df, group, var, n_side, n_delta)


plot_list = {"contour": plot_contour, "corrtile": plot_corrtile, "sobol_outputs": plot_sobol_outputs, "scattermat": plot_scattermat, "hists": plot_hists, "sinew_inputs": plot_sinew_inputs, "sinew_outputs": plot_sinew_outputs}


@verb
def plot_auto(df: Table, kind: str | None = None, **kw: Any) -> Table:
    """The chart that the table's notes, or ``kind``, call for."""
    kind = kind or df.meta.get("plot")
    if kind not in plot_list:
        raise ValueError(f"kind: one of {sorted(plot_list)}")
    return plot_list[kind](df, **kw)


pt_contour, pt_corrtile, pt_sobol_outputs, pt_scattermat, pt_hists = map(add_pipe, (plot_contour, plot_corrtile, plot_sobol_outputs, plot_scattermat, plot_hists))
pt_sinew_inputs, pt_sinew_outputs, pt_xbs, pt_auto = map(add_pipe, (plot_sinew_inputs, plot_sinew_outputs, plot_xbs, plot_auto))
