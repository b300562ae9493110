"""Laws of greatest likelihood by scoring: each round is one pass of aggregates, so no row leaves its task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.plans.storage import settle

#: Shapes that may have any sign, and shapes between 0 and 1; all others are above 0, as scales are.
ANY_SIGN = {("genextreme", "c"), ("genpareto", "c"), ("johnsonsu", "a"), ("johnsonsb", "a"), ("kappa4", "h"), ("kappa4", "k"), ("pearson3", "skew"), ("truncnorm", "a"), ("truncnorm", "b")}
SHARES = {("triang", "c"), ("trapz", "c"), ("trapz", "d"), ("wrapcauchy", "c")}
DIFFERENCE, ROUNDS = 1e-4, 60


def first_guess(dist: str, shapes: tuple[str, ...], mean: float, sd: float) -> dict[str, float]:
    """Shapes and scale by moments where there is a rule, else shapes of 1."""
    ratio = mean / sd if sd > 0 else 1.0
    if dist in ("gamma", "erlang") and mean > 0:
        return {"a": ratio**2, "scale": sd * sd / mean}
    if dist == "chi2" and mean > 0:
        return {"df": 2 * ratio**2, "scale": sd * sd / mean / 2}
    if dist == "beta" and 0 < mean < 1:
        n = max(mean * (1 - mean) / (sd * sd) - 1, 0.1)
        return {"a": mean * n, "b": (1 - mean) * n, "scale": 1.0}
    if dist in ("weibull_min", "weibull_max", "exponweib") and mean:
        c = min(max(abs(ratio), 0.2), 20.0) ** 1.086
        return {s: c if s == "c" else 1.0 for s in shapes} | {"scale": abs(mean) / math.gamma(1 + 1 / c)}
    if dist == "t":
        return {"df": 5.0, "scale": sd * math.sqrt(0.6)}
    if dist == "f" and mean > 0:
        return {"dfn": 5.0, "dfd": 10.0, "scale": mean * 0.8}
    if dist == "lognorm" and mean > 0:
        s = math.sqrt(math.log1p((sd / mean) ** 2))
        return {"s": s, "scale": mean * math.exp(-s * s / 2)}
    if dist == "invgamma" and mean > 0:
        return {"a": 2 + ratio**2, "scale": mean * (1 + ratio**2)}
    return {s: 0.1 if (dist, s) in ANY_SIGN else 0.5 if (dist, s) in SHARES else 1.0 for s in shapes} | {"scale": sd or 1.0}


def _free(dist: str, name: str, value: float) -> float:
    if name == "loc" or (dist, name) in ANY_SIGN:
        return value
    return math.log(value / (1 - value)) if (dist, name) in SHARES else math.log(value)


def _held(dist: str, name: str, value: float) -> float:
    if name == "loc" or (dist, name) in ANY_SIGN:
        return value
    return 1 / (1 + math.exp(-value)) if (dist, name) in SHARES else math.exp(min(max(value, -700.0), 700.0))


def scoring(dist: str, df: DataFrame, x: Column, density: Callable[[dict[str, float], Column], Column], start: dict[str, float], fixed: dict[str, float], tolerance: float = 1e-9) -> dict[str, float]:
    """The parameters of greatest likelihood from ``start``, those of ``fixed`` kept.

    A round sums the log density over all rows, its slopes by each parameter (as differences), its curvature, and the products of slopes, which stand in for the
    curvature where that isn't a maximum's. The step they give is taken if the likelihood rises, else the best of smaller ones, which the same
    pass has tried. Scales and positive shapes go by their logarithms. Rows of no density weigh as 1e-300, which turns a step back.
    Null values are left out; equal values are counted and settled once, so that rounds read each value once, with its count.
    """
    known = settle(df.select(x.cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("n")), "values")
    names = list(start)

    def log_density(theta: np.ndarray) -> Column:
        param = {n: _held(dist, n, float(v)) for n, v in zip(names, theta)} | fixed
        return F.ln(F.greatest(density(param, F.col("x")), F.lit(1e-300)))

    def sums(theta: np.ndarray, others: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
        """The mean log density, its slopes, what stands for the information, and the mean at other places."""
        k = len(names)
        steps = np.eye(k) * DIFFERENCE * np.maximum(1.0, np.abs(theta))
        wide = {"l": log_density(theta)} | {f"u{i}": log_density(theta + h) for i, h in enumerate(steps)} | {f"d{i}": log_density(theta - h) for i, h in enumerate(steps)}
        pairs = [(i, j) for i in range(k) for j in range(i)]
        wide |= {f"{s}{i}_{j}": log_density(theta + sign * (steps[i] + steps[j])) for i, j in pairs for s, sign in (("p", 1), ("m", -1))}
        wide |= {f"o{j}": log_density(o) for j, o in enumerate(others)}
        score = [(F.col(f"u{i}") - F.col(f"d{i}")) / float(2 * steps[i, i]) for i in range(k)]

        def mean(c: Column) -> Column:
            return F.try_divide(F.sum(c * F.col("n")), F.sum(F.when(c.isNotNull(), F.col("n"))))

        made = [mean(F.col(c)).alias(c) for c in wide] + [mean(score[i] * score[j]).alias(f"v{i}_{j}") for i in range(k) for j in range(i + 1)]
        row = {c: float("nan") if v is None else float(v) for c, v in known.select("n", *(x.alias(c) for c, x in wide.items())).agg(*made).first().asDict().items()}
        slope = np.array([(row[f"u{i}"] - row[f"d{i}"]) / (2 * steps[i, i]) for i in range(k)])
        seen, products = np.zeros((k, k)), np.zeros((k, k))
        for i in range(k):
            seen[i, i] = -(row[f"u{i}"] + row[f"d{i}"] - 2 * row["l"]) / steps[i, i] ** 2
            for j in range(i):
                seen[i, j] = seen[j, i] = -(row[f"p{i}_{j}"] + row[f"m{i}_{j}"] + 2 * row["l"] - row[f"u{i}"] - row[f"d{i}"] - row[f"u{j}"] - row[f"d{j}"]) / (2 * steps[i, i] * steps[j, j])
            for j in range(i + 1):
                products[i, j] = products[j, i] = row[f"v{i}_{j}"]
        rising = np.isfinite(seen).all() and np.linalg.eigvalsh(seen).min() > 1e-6 * np.abs(seen).max()
        return row["l"], slope, seen if rising else products, [row[f"o{j}"] for j in range(len(others))]

    theta = np.array([_free(dist, n, v) for n, v in start.items()])
    if not names:
        return dict(fixed)
    value, slope, info, _ = sums(theta, [])
    if math.isnan(value):
        raise ValueError("no values to fit a law to")
    for _ in range(ROUNDS):
        step = np.linalg.lstsq(info + 1e-12 * np.trace(info) * np.eye(len(names)), slope, rcond=None)[0]
        step = step * min(1.0, 2.0 / max(np.abs(step / np.maximum(1.0, np.abs(theta))).max(), 1e-300))
        gain = float(step @ slope)
        if gain < tolerance * tolerance * 100 or np.abs(step).max() < tolerance:
            break
        shorter = [theta + step * t for t in (0.5, 0.2, 0.05, 0.01, 0.001)]
        found, new_slope, new_info, tried = sums(theta + step, shorter)
        if found >= value:
            theta, value, slope, info = theta + step, found, new_slope, new_info
            continue
        best = int(np.nanargmax(tried))
        if not tried[best] > value:
            break
        theta = shorter[best]
        value, slope, info, _ = sums(theta, [])
    return {n: _held(dist, n, float(v)) for n, v in zip(names, theta)} | fixed
