"""Two-component mixtures with one shared variance per guide, thresholds drawn from them, and calls."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FITS = "guide long, weights array<double>, means array<double>, sigma double, log_likelihood double, n_points long, status int"
OK, TOO_FEW, CONSTANT = 0, 1, 2


def _em(v: np.ndarray, c: np.ndarray, starts: int, rounds: int, tol: float, floor: float):
    """Best of several quantile starts on values ``v`` with counts ``c``."""
    n, best = c.sum(), None
    order = np.argsort(v)
    v, c = v[order], c[order]
    share = (np.cumsum(c) - c / 2) / n
    for s in range(starts):
        q = 0.05 + 0.4 * s / max(starts - 1, 1)
        mu, w = np.interp([q, 1 - q], share, v), np.array([0.5, 0.5])
        var, last = max(np.average((v - np.average(v, weights=c)) ** 2, weights=c) / 4, floor), -np.inf
        for _ in range(rounds):
            logs = np.log(w) - (v[:, None] - mu) ** 2 / (2 * var) - 0.5 * np.log(2 * np.pi * var)
            top = logs.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
            r = np.exp(logs - total[:, None]) * c[:, None]
            like, mass = float((total * c).sum()), np.maximum(r.sum(0), 1e-12)
            w, mu = mass / mass.sum(), (r * v[:, None]).sum(0) / mass
            var = max(float((r * (v[:, None] - mu) ** 2).sum() / n), floor)
            if abs(like - last) <= tol * abs(like):
                break
            last = like
        if best is None or like > best[0]:
            best = like, w, mu, var
    return best


def fit_guides(x: DataFrame, min_points: int = 5, min_counts: float = 10.0, starts: int = 8, rounds: int = 200, tol: float = 1e-6, floor: float = 1e-3) -> DataFrame:
    """Fits of log10(1 + value) by guide of (cell, guide, value), on stored values over ``min_counts``.

    Equal values are counted before they are dealt to guides, so a task holds a guide's distinct counts and
    not its cells. Means rise; status is 0, 1 (too few points) or 2 (all points equal), then with NaN parameters.
    """
    counts = x.where(F.col("value") >= min_counts).groupBy("guide", F.log10(F.col("value") + 1).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    every = x.select("guide").distinct().join(counts, "guide", "left")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t, guide = t.dropna(subset=["v"]), t["guide"].iloc[0]
        n = int(t["c"].sum())
        if n < min_points or len(t) < 2:
            nan = [float("nan")] * 2
            return pd.DataFrame([(guide, nan, nan, nan[0], nan[0], n, TOO_FEW if n < min_points else CONSTANT)], columns=["guide", "weights", "means", "sigma", "log_likelihood", "n_points", "status"])
        like, w, mu, var = _em(t["v"].to_numpy(float), t["c"].to_numpy(float), starts, rounds, tol, floor)
        o = np.argsort(mu)
        return pd.DataFrame([(guide, w[o].tolist(), mu[o].tolist(), var**0.5, like, n, OK)], columns=["guide", "weights", "means", "sigma", "log_likelihood", "n_points", "status"])

    return every.groupBy("guide").applyInPandas(one, FITS)


def _raw(v: Column, scale: str) -> Column:
    return F.pow(F.lit(10.0), v) - 1 if scale == "raw" else v


def thresholds(fits: DataFrame, method: str = "quantile", background: float = 0.99, foreground: float = 0.01, grid: int = 256, scale: str = "raw") -> DataFrame:
    """(guide, neg, pos) from fits without fitting again; NaN where the status is not 0.

    quantile: of either component; equal_density: where both weighted densities meet; valley: the first lowest
    mixture density on a grid between the means.
    """
    w0, w1, m0, m1, s = F.col("weights")[0], F.col("weights")[1], F.col("means")[0], F.col("means")[1], F.col("sigma")
    if method == "quantile":
        neg, pos = m0 + s * NormalDist().inv_cdf(background), m1 + s * NormalDist().inv_cdf(foreground)
    elif method == "equal_density":
        neg = pos = (m0 + m1) / 2 + s * s * F.log(w0 / w1) / (m1 - m0)
    elif method == "valley":
        at = lambda i: m0 + (m1 - m0) * i / (grid - 1)
        low = lambda v: w0 * F.exp(-(v - m0) * (v - m0) / (2 * s * s)) + w1 * F.exp(-(v - m1) * (v - m1) / (2 * s * s))
        neg = pos = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.struct(low(at(i)).alias("d"), at(i).alias("v"))))["v"]
    else:
        raise ValueError(f"unknown method {method!r}")
    ok, nan = F.col("status") == OK, F.lit(float("nan"))
    return fits.select("guide", F.when(ok, _raw(neg, scale)).otherwise(nan).alias("neg"), F.when(ok, _raw(pos, scale)).otherwise(nan).alias("pos"))


def sweep(fits: DataFrame, background: list[float], foreground: list[float], scale: str = "raw") -> DataFrame:
    """(guide, side, quantile, threshold) for the given quantiles of both components."""
    nd = NormalDist()
    rows = [F.struct(F.lit(side).alias("side"), F.lit(q).alias("quantile"), (F.col("means")[i] + F.col("sigma") * nd.inv_cdf(q)).alias("t")) for side, i, qs in (("neg", 0, background), ("pos", 1, foreground)) for q in qs]
    t = fits.select("guide", "status", F.explode(F.array(*rows)).alias("r"))
    return t.select("guide", "r.side", "r.quantile", F.when(F.col("status") == OK, _raw(F.col("r.t"), scale)).otherwise(float("nan")).alias("threshold"))


def apply_thresholds(x: DataFrame, t: DataFrame) -> DataFrame:
    """(cell, guide, background, foreground) of stored values: 1 over the threshold; a NaN threshold calls nothing."""
    over = lambda c: F.when(F.isnan(c), 0).otherwise((F.col("value") > F.col(c)).cast("int"))
    return x.join(t, "guide").select("cell", "guide", over("neg").alias("background"), over("pos").alias("foreground"))


def call_guides(x: DataFrame, background: DataFrame | None = None, foreground: DataFrame | None = None, **fit) -> DataFrame:
    """Calls by given thresholds (guide, threshold), where one side fills in for the other, else by fitted ones."""
    if background is None and foreground is None:
        return apply_thresholds(x, thresholds(fit_guides(x, **fit)))
    neg, pos = background if background is not None else foreground, foreground if foreground is not None else background
    t = neg.withColumnRenamed("threshold", "neg").join(pos.withColumnRenamed("threshold", "pos"), "guide")
    return apply_thresholds(x, t)
