"""Fuzzy rules, hard-coded models and model fits by sufficient statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.fuzzy import clamp, fuzzy_and, fuzzy_mean, fuzzy_not, fuzzy_or, is_about, is_high, is_low  # noqa: F401
from gridloom.grid import Grid, jround


def market(pop: Column, light: Column, sparse=(5.0, 10.0), crowded=(30.0, 80.0), bright=(30.0, 70.0)) -> Column:
    """0..10: not sparse, not crowded, well lit."""
    return jround(10 * fuzzy_and(fuzzy_not(is_low(pop, *sparse)), fuzzy_not(is_high(pop, *crowded)), is_high(light, *bright)))


def linear_model(pop: Column, light: Column) -> Column:
    """The published coefficients of the regression of development on light and population (fixed values)."""
    return jround(0.003494 + 0.034444 * light - 0.005992 * pop)


def nearest_centre(values: list[Column], mean: list[float], std: list[float], centres: list[list[float]]) -> Column:
    """Number of the nearest of some centres in standardised space; the first on ties."""
    z = [(v - m) / s for v, m, s in zip(values, mean, std, strict=True)]
    d = [sum((a - (c - m) / s) * (a - (c - m) / s) for a, c, m, s in zip(z, centre, mean, std, strict=True)) for centre in centres]
    out = F.lit(len(d) - 1)
    for i in reversed(range(len(d) - 1)):
        rest = F.least(*d[i + 1 :]) if len(d) > i + 2 else d[i + 1]
        out = F.when(d[i] <= rest, i).otherwise(out)
    return out


def correlations(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return df.agg(*(F.corr(x, y).alias(f"r_{x}") for x in xs))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> np.ndarray:
    """Intercept and coefficients; one pass gathers the sums of products, whatever the number of rows."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    k = len(cols)
    row = df.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return np.linalg.solve(m[:-1, :-1], m[:-1, -1])


def cross_validated(df: DataFrame, y: str, xs: list[str], fold: Column, folds: int = 5) -> list[tuple[int, int, float]]:
    """(fold, rows, mean squared error) of a linear model fitted on the other folds; one pass gathers the sums of products by fold."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    k = len(cols)
    rows = df.groupBy(F.pmod(fold, F.lit(folds)).cast("int").alias("fold")).agg(F.count("*").alias("n"), *(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).collect()
    own = {r.fold: (r.n, np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])) for r in rows}
    total, out = sum(m for _, m in own.values()), []
    for f, (n, m) in sorted(own.items()):
        b = np.linalg.lstsq((total - m)[:-1, :-1], (total - m)[:-1, -1], rcond=None)[0]
        out.append((f, n, float(m[-1, -1] - 2 * b @ m[:-1, -1] + b @ m[:-1, :-1] @ b) / n))
    return out


def rbf_fit(g: Grid, centres: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Least-squares amplitudes of kernels exp(-(dx/sx)**2 - (dy/sy)**2) at (row, col, sx, sy), over all cells, missing ones included."""
    h = [F.exp(-F.pow((F.col("row") - a) / F.lit(float(s)), 2) - F.pow((F.col("col") - b) / F.lit(float(u)), 2)) for a, b, s, u in centres]
    k = len(h)
    row = g.df.agg(*(F.sum(h[i] * h[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(h[i] * F.col("value")).alias(f"y{i}") for i in range(k))).first()
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(m, [row[f"y{i}"] for i in range(k)])


def gmm(points: DataFrame, centres: list[tuple[float, float]], rounds: int = 10) -> list[tuple]:
    """Means and covariances of Gaussian components over points (x, y), by EM whose responsibilities leave component weights out.

    Each round is one aggregation of six sums a component. Stops when the log likelihood gains less than 1 %.
    """
    comp = [(a, b, 100.0, 0.0, 100.0) for a, b in centres]
    last = None
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    for _ in range(rounds):
        dens = []
        for mx, my, sxx, sxy, syy in comp:
            det = sxx * syy - sxy * sxy
            if det <= 1e-9:
                dens.append(F.lit(0.0))
                continue
            q = (syy * (x - mx) * (x - mx) - 2 * sxy * (x - mx) * (y - my) + sxx * (y - my) * (y - my)) / det
            dens.append(F.exp(-q / 2) / (2 * float(np.pi) * det**0.5))
        total = sum(dens)
        aggs = [F.sum(F.log(F.greatest(total, F.lit(1e-300)))).alias("ll")]
        for i, p in enumerate(dens):
            r = F.coalesce(F.try_divide(p, total), F.lit(0.0))
            aggs += [F.sum(r * v).alias(f"{n}{i}") for n, v in (("w", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))]
        s = points.agg(*aggs).first()
        comp = [(s[f"x{i}"] / w, s[f"y{i}"] / w, s[f"xx{i}"] / w - (s[f"x{i}"] / w) ** 2, s[f"xy{i}"] / w - s[f"x{i}"] * s[f"y{i}"] / w**2, s[f"yy{i}"] / w - (s[f"y{i}"] / w) ** 2) if (w := s[f"w{i}"]) > 1e-9 else comp[i] for i in range(len(comp))]
        if last is not None and abs(s["ll"] - last) < 0.01 * abs(last):
            break
        last = s["ll"]
    return comp
