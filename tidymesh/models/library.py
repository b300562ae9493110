"""Ready models: textbook test cases of reliability, physics and epidemics.

Formulas are written over columns where they can be; the epidemic is integrated once for each set of parameters, and the laminate is
solved in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.functions.special import let, of
from tidymesh.models.compose import comp_bounds, comp_copula_gaussian, comp_copula_independence, comp_function, comp_marginals, comp_vec_function
from tidymesh.models.core import FunctionVectorized, Inputs, Model, Values
from tidymesh.models.marginals import marg_fit, marg_mom, marg_named
from tidymesh.table import as_table, named

INF = math.inf


def _stage(md: Model, name: str, var: str, **formulas: Callable[[Any], Any]) -> Model:
    """A function of columns: ``var`` names its inputs, each formula takes them all."""
    return comp_vec_function(md, lambda x: {k: f(x) for k, f in formulas.items()}, var=var.split(), out=list(formulas), name=name)


def _uniform(lo: float, width: float) -> Any:
    return marg_named("uniform", loc=lo, scale=width)


def make_test() -> Model:
    """The sum of three inputs, two of them random."""
    md = comp_function(Model(), lambda x1, x2, x3: x1 + x2 + x3, var=3, out=1)
    md = comp_bounds(md, x0=(-1, 1), x1=(-1, 1), x2=(-1, 1))
    return comp_copula_independence(comp_marginals(md, x0=_uniform(-1, 2), x1=_uniform(-1, 2)))


def make_linear_normal() -> Model:
    """A linear limit state of two standard normal inputs: its reliability index is 1 / sqrt(2)."""
    md = comp_function(Model("Linear-Normal Reliability Problem"), lambda x0, x1: 1 - x0 - x1, var=2, out=["g_linear"], name="limit state")
    return comp_copula_independence(comp_marginals(md, x0=marg_named("norm", sign=1), x1=marg_named("norm", sign=1)))


def make_poly() -> Model:
    """x, its square and its cube, of three inputs."""
    md = Model("Polynomials")
    for k, name in enumerate(("linear", "quadratic", "cubic")):
        md = comp_vec_function(md, lambda x, k=k: {f"y{k}": x[f"x{k}"] ** (k + 1) if k else x["x0"] * 1.0}, var=[f"x{k}"], out=[f"y{k}"], name=name)
    return comp_copula_independence(comp_marginals(md, **{f"x{k}": _uniform(-1, 2) for k in range(3)}))


def make_ishigami() -> Model:
    """Ishigami's function, whose Sobol indices are known in closed form."""

    def value(x: Any) -> Any:
        m = of(x.x1)
        return m.sin(x.x1) + x.a * m.sin(x.x2) ** 2 + x.b * x.x3**4 * m.sin(x.x1)

    md = comp_bounds(_stage(Model("Ishigami Function"), "f", "a b x1 x2 x3", y0=value), a=(6.0, 8.0), b=(0, 0.2))
    return comp_copula_independence(comp_marginals(md, **{f"x{k}": _uniform(-math.pi, 2 * math.pi) for k in (1, 2, 3)}))


def make_cantilever_beam() -> Model:
    """A beam held at one end: its area is to be small, and neither stress nor tip displacement may pass its limit."""
    # fixed values: length, largest displacement, and the means and spreads of loads and material
    length, most = 100.0, 2.2535
    mean = {"H": 500.0, "V": 1000.0, "E": 2.9e7, "Y": 40000.0}
    spread = {"H": 100.0, "V": 100.0, "E": 1.45e6, "Y": 2000.0}
    sign = {"H": 1, "V": 1, "E": 0, "Y": -1}
    md = _stage(Model("Cantilever Beam"), "cross-sectional area", "w t", c_area=lambda x: x.w * x.t)
    md = _stage(md, "limit state: stress", "w t H V E Y", g_stress=lambda x: (x.Y - 600 * x.V / x.w / x.t**2 - 600 * x.H / x.w**2 / x.t) / mean["Y"])
    md = _stage(md, "limit state: displacement", "w t H V E Y", g_disp=lambda x: most - 4 * length**3 / x.E / x.w / x.t * of(x.V).sqrt(x.V**2 / x.t**4 + x.H**2 / x.w**4))
    md = comp_bounds(md, w=(2, 4), t=(2, 4))
    return comp_copula_independence(comp_marginals(md, **{k: marg_named("norm", sign=sign[k], loc=mean[k], scale=spread[k]) for k in mean}))


_RLC = {"R": (1e-3, 1.0), "L": (1e-9, 1e-3), "C": (1e-3, 100.0)}


def make_prlc() -> Model:
    """A parallel circuit: natural frequency and quality factor."""
    md = _stage(Model("RLC Circuit"), "frequency", "L C", omega0=lambda x: of(x.L).sqrt(1 / x.L / x.C))
    md = _stage(md, "parallel RLC", "omega0 R C", Q=lambda x: x.omega0 * x.R * x.C)
    return comp_bounds(md, **_RLC)


def make_prlc_rand() -> Model:
    """The same with components off their nominal values by random shares."""
    # fixed values: the tolerances of the components
    off = {"R": (-0.05, 0.05), "L": (-0.10, 0.10), "C": (-0.20, 0.80)}
    md = _stage(Model("RLC with component tolerances"), "tolerances", "R dR L dL C dC", **{f"{k}r": lambda x, k=k: x[k] * (1 + x[f"d{k}"]) for k in off})
    md = _stage(md, "frequency", "Lr Cr", omega0=lambda x: of(x.Lr).sqrt(1 / x.Lr / x.Cr))
    md = _stage(md, "parallel RLC", "omega0 Rr Cr", Q=lambda x: x.omega0 * x.Rr * x.Cr)
    md = comp_marginals(comp_bounds(md, **_RLC), **{f"d{k}": _uniform(lo, up - lo) for k, (lo, up) in off.items()})
    return comp_copula_independence(md)


_PISTON = {"m": (30, 60), "s": (0.005, 0.020), "v_0": (0.002, 0.010), "k": (1000, 5000), "p_0": (90000, 110000), "t_a": (290, 296), "t_0": (340, 360)}


def _piston(md: Model, p: str, k: str, ta: str, t0: str) -> Model:
    md = _stage(md, "Intermediate calculation 1", f"{p} s m {k} v_0", a=lambda x: x[p] * x.s + 19.62 * x.m - x[k] * x.v_0 / x.s)
    md = _stage(md, "Intermediate calculation 2", f"s a {k} {p} v_0 {t0} {ta}", v=lambda x: 0.5 * x.s / x[k] * (of(x.a).sqrt(x.a**2 + 4 * x[k] * x[p] * x.v_0 / x[t0] * x[ta]) - x.a))
    return _stage(md, "Cycle time", f"m {k} s {p} v_0 {t0} {ta} v", t_cyc=lambda x: 2 * math.pi * of(x.m).sqrt(x.m / (x[k] + x.s**2 * x[p] * x.v_0 / x[t0] * x[ta] / x.v**2)))


def make_piston() -> Model:
    """Cycle time of a piston in a cylinder."""
    return comp_bounds(_piston(Model("Piston cycle time"), "p_0", "k", "t_a", "t_0"), **_PISTON)


def make_piston_rand() -> Model:
    """The same with random shares on the operating conditions."""
    names = ("k", "p_0", "t_a", "t_0")
    md = _stage(Model("Piston cycle time, with variability"), "Random operating disturbances", " ".join([*names, *(f"d{n}" for n in names)]), **{f"r{n}": lambda x, n=n: x[n] * (1 + x[f"d{n}"]) for n in names})
    md = comp_bounds(_piston(md, "rp_0", "rk", "rt_a", "rt_0"), **_PISTON)
    return comp_copula_independence(comp_marginals(md, **{f"d{n}": marg_mom("uniform", mean=0, sd=0.40) for n in names}))


def make_plate_buckle(data: Any, E: Any = "E", mu: Any = "mu") -> Model:
    """Buckling of a plate. ``data``: a table of measured stiffness and Poisson's ratio, to which the laws and their correlation are fitted."""
    # fixed values: reference thickness and load
    thick, load = 0.06, 0.00128
    md = _stage(Model("Plate Buckling"), "factor", "w h m", k_cr=lambda x: (x.m * x.h / x.w + x.w / x.m / x.h) ** 2)
    md = _stage(md, "limit state", "k_cr t h w E mu L", g_buckle=lambda x: x.k_cr * math.pi**2 / 12 * x.E / (1 - x.mu**2) * (x.t / x.h) ** 2 - x.L / x.t / x.w)
    md = comp_bounds(md, t=(0.5 * thick, 2 * thick), h=(6, 18), w=(6, 18), m=(1, 5), L=(load / 2, load * 2))
    md = comp_marginals(md, E=marg_fit("norm", data, E), mu=marg_fit("beta", data, mu))
    own = as_table(data).df.select(F.col(f"`{named(E)}`").alias("E"), F.col(f"`{named(mu)}`").alias("mu"))
    return comp_copula_gaussian(md, df_data=own)


def make_trajectory_linear() -> Model:
    """A projectile with linear drag, from the origin."""
    g = -9.8  # fixed value (m/s^2)
    md = _stage(Model("Trajectory Model"), "x_trajectory", "u0 v0 tau t", x=lambda x: x.tau * x.u0 * (1 - of(x.t).exp(-x.t / x.tau)))
    md = _stage(md, "y_trajectory", "u0 v0 tau t", y=lambda x: x.tau * (x.v0 - g * x.tau) * (1 - of(x.t).exp(-x.t / x.tau)) + g * x.tau * x.t)
    return comp_bounds(md, u0=(0.1, INF), v0=(0.1, INF), tau=(0.05, INF), t=(0, 600))


def _channel(md: Model, heat: str) -> Model:
    """Fluid and particle temperature along a channel in which particles are heated."""

    def rise(x: Any) -> Any:
        return x[heat] / x.beta * (1 - of(x.beta).exp(-x.beta * x.xst))

    return _stage(
        md, "temperatures", f"xst Phi_M chi {heat} beta", T_f=lambda x: (x.Phi_M * x.chi) / (1 + x.Phi_M * x.chi) * (x[heat] * x.xst - rise(x)), T_p=lambda x: 1 / (1 + x.Phi_M * x.chi) * (x.Phi_M * x.chi * x[heat] * x.xst + rise(x))
    )


def make_channel_nondim() -> Model:
    md = _stage(Model("1d Particle-laden Channel with Radiation; Dimensionless Form"), "development", "Phi_M chi", beta=lambda x: 120 * (1 + x.Phi_M * x.chi))
    md = comp_bounds(_channel(md, "I"), xst=(0, 5))
    return comp_copula_independence(comp_marginals(md, Phi_M=_uniform(0, 1), chi=_uniform(0.1, 0.9), I=_uniform(0.1, 0.9)))


def make_channel() -> Model:
    """The same from quantities with dimensions."""
    md = _stage(
        Model("1d Particle-laden Channel with Radiation; Dimensional Form"), "Dimensionless Numbers", "U H L nu_f cp_p cp_f alpha_f rho_p rho_f d_p n h_p T_0 Q_abs I_0", Re=lambda x: x.U * x.H / x.nu_f, Pr=lambda x: x.nu_f / x.alpha_f, chi=lambda x: x.cp_p / x.cp_f,
        Phi_M=lambda x: x.rho_p * 0.524 * x.d_p**3 * x.n / x.rho_f, tau_flow=lambda x: x.L / x.U, tau_pt=lambda x: x.rho_p * x.cp_p * 0.318 * x.d_p / x.h_p, tau_rad=lambda x: x.rho_p * x.cp_p * 0.667 * x.d_p * x.T_0 / (x.Q_abs * 0.78 * x.I_0),
    )
    md = _stage(
        md, "Intermediate Dimensionless Numbers", "xi chi H L Re Pr Phi_M tau_flow tau_rad tau_pt", xst=lambda x: x.xi * x.L / x.H / x.Re / x.Pr, Is=lambda x: x.Re * x.Pr * (x.H / x.L) * (x.tau_flow / x.tau_rad),
        beta=lambda x: x.Re * x.Pr * (x.H / x.L) * (x.tau_flow / x.tau_pt) * (1 + x.Phi_M * x.chi),
    )
    md = comp_bounds(_channel(md, "Is"), xi=(0, 1))
    # fixed values: lower ends and widths of the inputs' ranges
    ranges = {
        "H": (0.038, 0.004), "L": (0.152, 0.016), "U": (1, 2.5), "nu_f": (1.4e-5, 0.1e-5), "cp_p": (100, 900), "cp_f": (1000, 1000), "alpha_f": (50e-6, 50e-6), "rho_p": (1e3, 9e3),
        "rho_f": (0.5, 1.0), "d_p": (1e-6, 9e-6), "n": (9.5e9, 1.0e9), "h_p": (1e3, 9e3), "T_0": (285, 30), "Q_abs": (0.25, 0.50), "I_0": (9.5e6, 1.0e6),
    }
    return comp_copula_independence(comp_marginals(md, **{k: _uniform(*v) for k, v in ranges.items()}))


def make_pareto_random(two_dim: bool = True) -> Model:
    """Points in a quarter disc (and their tangent, for three outputs), to try Pareto fronts on."""
    formulas = {"y1": lambda x: x.x1 * of(x.x1).cos(x.x2), "y2": lambda x: x.x1 * of(x.x1).sin(x.x2)}
    laws = {"x1": _uniform(0, 1), "x2": _uniform(0, math.pi / 2)}
    if not two_dim:
        formulas["y3"], laws["x3"] = lambda x: x.x1 * of(x.x1).tan(x.x2), _uniform(0, math.pi / 4)
    return comp_copula_independence(comp_marginals(_stage(Model(), "f", " ".join(laws), **formulas), **laws))


HALVINGS, TURBULENT = 70, 3e3


def friction(x: Any) -> Any:
    """Pipe friction: 64 / Re in laminar flow; else the root of Colebrook's equation between 1e-5 and 10, by halving the bracket."""
    m = of(x.u)
    re = x.rho * x.u * x.d / x.mu

    def above(f: Any, re: Any) -> Any:
        """Positive below the root: the equation falls as f rises."""
        root = m.sqrt(f)
        return 1 + 2 * root * m.log(x.eps / 3.6 / x.d + 2.51 / re / root) / math.log(10)

    if isinstance(re, Column):

        def halve(ends: Column, _: Column) -> Column:
            return let((ends["lo"] + ends["hi"]) / 2, lambda f: F.when(above(f, re) > 0, F.struct(f.alias("lo"), ends["hi"].alias("hi"))).otherwise(F.struct(ends["lo"].alias("lo"), f.alias("hi"))))

        start = F.struct(F.lit(1e-5).alias("lo"), F.lit(10.0).alias("hi"))
        return F.when(re < TURBULENT, 64 / re).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda e: (e["lo"] + e["hi"]) / 2))
    lo, hi = np.full(np.shape(re), 1e-5), np.full(np.shape(re), 10.0)
    with np.errstate(all="ignore"):
        for _ in range(HALVINGS):
            f = (lo + hi) / 2
            low = above(f, re) > 0
            lo, hi = np.where(low, f, lo), np.where(low, hi, f)
        return np.where(re < TURBULENT, 64 / re, (lo + hi) / 2)


def make_pipe_friction() -> Model:
    """Friction factor of a pipe, laminar or turbulent."""
    md = _stage(Model("Pipe Friction Factor"), "friction", "rho u d mu eps", f=friction)
    return comp_bounds(md, rho=(1.0, 1.4), u=(1e-4, 1e1), d=(1.3, 1.7), mu=(1.0e-5, 1.5e-5), eps=(0.5e-1, 2.0e-1))


# fixed values: Dormand and Prince's pair of orders 5 and 4, and its interpolant (powers of the share of a step, from the first)
STAGES = np.array([
    [0, 0, 0, 0, 0, 0], [1 / 5, 0, 0, 0, 0, 0], [3 / 40, 9 / 40, 0, 0, 0, 0], [44 / 45, -56 / 15, 32 / 9, 0, 0, 0], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729, 0, 0],
    [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656, 0], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84],
])
MISS = np.array([-71 / 57600, 0, 71 / 16695, -71 / 1920, 17253 / 339200, -22 / 525, 1 / 40])
BETWEEN = np.array([
    [1, -8048581381 / 2820520608, 8663915743 / 2820520608, -12715105075 / 11282082432], [0, 0, 0, 0], [0, 131558114200 / 32700410799, -68118460800 / 10900136933, 87487479700 / 32700410799],
    [0, -1754552775 / 470086768, 14199869525 / 1410260304, -10690763975 / 1880347072], [0, 127303824393 / 49829197408, -318862633887 / 49829197408, 701980252875 / 199316789632],
    [0, -282668133 / 205662961, 2019193451 / 616988883, -1453857185 / 822651844], [0, 40617522 / 29380423, -110615467 / 29380423, 69997945 / 29380423],
])


def integrate(slopes: Callable[[np.ndarray], np.ndarray], start: np.ndarray, end: np.ndarray, rtol: float, atol: float) -> list[list[tuple[float, float, np.ndarray]]]:
    """For each row of ``start`` (sets x states), its steps from 0 to ``end``: (from, width, coefficients: states x 5 powers of the share of the step).

    All sets go together, each with steps of its own; a step whose error passes the tolerance is tried again, smaller. ``slopes``
    takes (indices of sets, states).
    """
    n, width = start.shape
    y, t = start.astype(float).copy(), np.zeros(n)
    out: list[list[tuple[float, float, np.ndarray]]] = [[] for _ in range(n)]
    k0 = slopes(np.arange(n), y)
    size = np.linalg.norm(y, axis=1) / np.maximum(np.linalg.norm(k0, axis=1), 1e-12)
    h = np.minimum(np.maximum(end, 0), np.maximum(0.01 * size, 1e-6))
    live = np.flatnonzero((end > 0) & np.isfinite(y).all(axis=1))
    while len(live):
        h[live] = np.minimum(h[live], end[live] - t[live])
        step = h[live][:, None]
        ks = np.zeros((7, len(live), width))
        ks[0] = k0[live]
        for s in range(1, 7):
            ks[s] = slopes(live, y[live] + step * np.tensordot(STAGES[s], ks[:6], axes=1))
        after = y[live] + step * np.tensordot(STAGES[6], ks[:6], axes=1)
        scale = atol + rtol * np.maximum(np.abs(y[live]), np.abs(after))
        error = np.sqrt(np.mean((step * np.tensordot(MISS, ks, axes=1) / scale) ** 2, axis=1))
        good = (error <= 1) | (step[:, 0] <= 1e-12 * np.maximum(1, np.abs(t[live])))
        parts = np.einsum("ksw,kp->swp", ks, BETWEEN) * step[:, :, None]
        for j in np.flatnonzero(good):
            i = live[j]
            out[i].append((float(t[i]), float(h[i]), np.hstack([y[i][:, None], parts[j]])))
        grow = np.clip(0.9 * np.maximum(error, 1e-10) ** -0.2, 0.2, 10)
        done = live[good]
        t[done], y[done], k0[done] = t[done] + h[done], after[good], ks[6][good]
        h[live] = h[live] * np.where(good, grow, np.minimum(grow, 1))
        live = live[(end[live] - t[live]) > 1e-12 * np.maximum(1, end[live])]
    return out


def _sir_slopes(beta: np.ndarray, gamma: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def slopes(which: np.ndarray, y: np.ndarray) -> np.ndarray:
        caught = beta[which] * y[:, 1] * y[:, 0] / np.maximum(y.sum(axis=1), 1e-300)
        gone = gamma[which] * y[:, 1]
        return np.stack([-caught, caught - gone, gone], axis=1)

    return slopes


class SirFunction(FunctionVectorized):
    """Susceptible, infected and removed at time t, for each row.

    Rows share a solution if they share S0, I0, R0, beta and gamma: sets are told apart first, each is integrated once to its last time
    in Arrow batches of sets, and its steps (a few tens, as arrays) meet the rows by an ordinary join; a row then finds its step and reads the
    interpolant there, as columns. So neither many times of one set nor many sets come to one task. Times below 0 count as 0; rows with a missing input get missing values.
    """

    PARAM = ("S0", "I0", "R0", "beta", "gamma")

    def __init__(self, rtol: float, atol: float) -> None:
        super().__init__(lambda x: None, ("t", *self.PARAM), ("S", "I", "R"), "ODE solver & interpolation", 0.0)
        object.__setattr__(self, "rtol", rtol)
        object.__setattr__(self, "atol", atol)

    def columns(self, values: Values) -> None:
        return None

    def steps(self, param: np.ndarray, end: np.ndarray) -> list[list[tuple[float, float, np.ndarray]]]:
        return integrate(_sir_slopes(param[:, 3], param[:, 4]), param[:, :3], end, self.rtol, self.atol)

    def numbers(self, values: Values) -> Values:
        x = np.stack(np.broadcast_arrays(*(np.atleast_1d(np.asarray(values[v], float)) for v in self.var)), axis=1)
        sets, which = np.unique(x[:, 1:], axis=0, return_inverse=True)
        which = which.ravel()
        last = np.zeros(len(sets))
        np.maximum.at(last, which, np.nan_to_num(x[:, 0]))
        out = np.full((len(x), 3), np.nan)
        for i, own in enumerate(self.steps(sets, last)):
            rows = np.flatnonzero(which == i)
            t = np.maximum(x[rows, 0], 0)
            if not own:
                out[rows] = sets[i, :3]
                continue
            at = np.clip(np.searchsorted([s[0] for s in own], t, side="right") - 1, 0, len(own) - 1)
            for r, k, time in zip(rows, at, t):
                share = min((time - own[k][0]) / own[k][1], 1.0)
                out[r] = own[k][2] @ share ** np.arange(5)
        return {o: out[:, k] for k, o in enumerate(self.out)}

    def apply(self, df: DataFrame) -> DataFrame:
        names = [f"__p{i}" for i in range(5)]
        keyed = df.withColumns({n: F.col(f"`{v}`").cast("double") for n, v in zip(names, self.PARAM)} | {"__t": F.greatest(F.col("`t`").cast("double"), F.lit(0.0))})
        sets = keyed.where(" AND ".join(f"{n} IS NOT NULL" for n in [*names, "__t"])).groupBy(*names).agg(F.max("__t").alias("__end"))
        this = self

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                own = this.steps(frame[names].to_numpy(float), frame["__end"].to_numpy(float))
                frame = frame[names].rename(columns={n: n + "k" for n in names})
                frame["__from"] = [[s[0] for s in x] for x in own]
                frame["__wide"] = [[s[1] for s in x] for x in own]
                frame["__at"] = [[s[2].ravel().tolist() for s in x] for x in own]
                yield frame

        solved = sets.mapInPandas(run, ", ".join([*(f"{n}k double" for n in names), "__from array<double>", "__wide array<double>", "__at array<array<double>>"]))
        met = keyed.join(solved, [F.col(n) == F.col(n + "k") for n in names], "left")
        # the place of the last step that begins by t
        place = F.greatest(F.lit(1), F.aggregate("__from", F.lit(0), lambda n, x: n + F.when(x <= F.col("__t"), 1).otherwise(0)))
        step = F.struct(F.try_element_at("__from", F.col("__k")).alias("a"), F.try_element_at("__wide", F.col("__k")).alias("w"), F.try_element_at("__at", F.col("__k")).alias("c"))
        met = met.withColumn("__k", place).withColumn("__s", step).withColumn("__x", F.least(F.try_divide(F.col("__t") - F.col("__s.a"), F.col("__s.w")), F.lit(1.0)))

        def state(i: int) -> Column:
            value = F.get("__s.c", F.lit(5 * i + 4))
            for p in (3, 2, 1, 0):
                value = value * F.col("__x") + F.get("__s.c", F.lit(5 * i + p))
            # a set whose last time is 0 has no step
            return F.when(F.size("__from") == 0, F.col(names[i])).otherwise(value)

        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.out]
        return met.select(*kept, *(state(i).alias(o) for i, o in enumerate(self.out)))


def make_sir(rtol: float = 1e-4, atol: float = 1e-6) -> Model:
    """An epidemic of susceptible, infected and removed in a population of N, none of them removed at first."""
    md = _stage(Model("SIR Model"), "Population setup", "I0 N", S0=lambda x: x.N - x.I0, R0=lambda x: x.N * 0.0)
    md = md.with_(functions=(*md.functions, SirFunction(rtol, atol)))
    return comp_bounds(md, N=(100, 100), I0=(1, 10), beta=(0.1, 0.5), gamma=(0.1, 0.5), t=(0, 100))


PLY = ("E1", "E2", "nu12", "G12", "theta", "t", "sigma_11_t", "sigma_22_t", "sigma_11_c", "sigma_22_c", "sigma_12_s")
LIMITS = ("g_11_tension", "g_22_tension", "g_11_compression", "g_22_compression", "g_12_shear")


def _turn(theta: np.ndarray, strain: bool = False) -> np.ndarray:
    """(rows x 3 x 3): stresses (strains) in axes turned by theta."""
    c, s = np.cos(theta), np.sin(theta)
    a, b = (1, 2) if strain else (2, 1)
    return np.moveaxis(np.array([[c * c, s * s, a * c * s], [s * s, c * c, -a * c * s], [-b * c * s, b * c * s, c * c - s * s]]), -1, 0)


def laminate_limits(x: Inputs, plies: int) -> dict[str, np.ndarray]:
    """What is left of each ply's strengths, as a share, under a load in one direction: stiffness of the plies is added up, solved for the
    strains, and each ply's stresses are turned to its own axes. All rows of a batch at once."""
    load = np.asarray(x["Nx"], float)
    stiff, total = [], 0.0
    for i in range(plies):
        e1, e2, nu, g, theta, t = (np.asarray(x[f"{k}_{i}"], float) for k in PLY[:6])
        whole = 1 - nu * nu * e2 / e1
        zero = np.zeros_like(e1)
        own = np.moveaxis(np.array([[e1 / whole, nu * e2 / whole, zero], [nu * e2 / whole, e2 / whole, zero], [zero, zero, g]]), -1, 0)
        stiff.append(_turn(-theta) @ own @ _turn(theta, True))
        total = total + stiff[-1] * t[:, None, None]
    force = np.zeros((len(load), 3, 1))
    force[:, 0, 0] = load
    known = np.isfinite(total).all(axis=(1, 2))
    strain = np.full(force.shape, np.nan)
    strain[known] = np.linalg.solve(total[known], force[known])
    out = {}
    for i in range(plies):
        stress = (_turn(np.asarray(x[f"theta_{i}"], float)) @ stiff[i] @ strain)[:, :, 0]
        most = [np.asarray(x[f"{k}_{i}"], float) for k in PLY[6:]]
        own = (1 - stress[:, 0] / most[0], 1 - stress[:, 1] / most[1], 1 + stress[:, 0] / most[2], 1 + stress[:, 1] / most[3], 1 - np.abs(stress[:, 2]) / most[4])
        out |= {f"{name}_{i}": v for name, v in zip(LIMITS, own)}
    return out


def make_composite_plate_tension(angles: list[float], thickness: float | list[float] = 1e-3) -> Model:
    """A laminate of plies at the given ``angles`` (radians) in tension: five limit states for each ply."""
    # fixed values: means and spreads of the material, of the make and of the load
    material = {"E1": (114e9, 0.02), "E2": (7e9, 0.08), "G12": (4e9, 0.1)}
    strength = {"sigma_11_t": (1.4e9, 0.06), "sigma_22_t": (1.4e6, 0.06), "sigma_11_c": (0.5e9, 0.06), "sigma_22_c": (0.5e6, 0.06), "sigma_12_s": (62e6, 0.07)}
    nu, off_angle, off_thick, load = 0.45, 3 * math.pi / 180, 1e-3 * 0.01, 1.2e6
    k = len(angles)
    thick = thickness if isinstance(thickness, list) else [thickness] * k
    degrees = [int(a / math.pi * 180) for a in angles]
    name = "Composite Plate in Tension " + "-".join(f"p{d}" if d > 0 else f"m{-d}" if d < 0 else "0" for d in degrees)
    var = [f"{n}_{i}" for i in range(k) for n in PLY] + ["Nx"]
    md = comp_vec_function(Model(name), lambda x: laminate_limits(x, k), var=var, out=[f"{n}_{i}" for i in range(k) for n in LIMITS], name="limit states")
    bounds, laws = {"Nx": (-INF, INF)}, {}
    for i in range(k):
        for n in PLY:
            bounds[f"{n}_{i}"] = (-math.pi / 2, math.pi / 2) if n == "theta" else (-INF, INF) if n in ("nu12", "t") else (0, INF)
        own = {n: marg_named("lognorm", loc=1, s=s, scale=m) for n, (m, s) in material.items()}
        own |= {n: marg_named("lognorm", sign=-1, loc=1, s=s, scale=m) for n, (m, s) in strength.items()}
        own |= {"nu12": marg_named("norm", loc=nu, scale=nu * 0.08), "theta": _uniform(angles[i] - off_angle, 2 * off_angle), "t": _uniform(thick[i] - off_thick, 2 * off_thick)}
        laws |= {f"{n}_{i}": own[n] for n in PLY}
    laws["Nx"] = marg_named("norm", sign=1, loc=load, scale=load * 0.1)
    return comp_copula_independence(comp_marginals(comp_bounds(md, **bounds), **laws))
