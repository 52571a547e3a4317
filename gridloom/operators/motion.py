"""Motion between frames, object tracking and a Kalman filter."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.cells import difference as frame_difference  # noqa: F401
from gridloom.operators.tiles import by_tiles, shifted


def cross_correlation(before: Grid, now: Grid, est: int, max_u: int, max_v: int) -> DataFrame:
    """row, col, u, v: for each cell the shift of up to max_u, max_v whose window of half size est differs least.

    A shift counts if its squared differences come to less than 0.75 of the window's squares and half the window is filled.
    Ties go to the first shift in order; (0, 0) where none counts. Both frames use now's mark for missing.
    """
    miss = now.meta.missing
    most = (2 * est + 1) ** 2

    def run(b: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
        have = a != miss
        best, u_best, v_best = np.full(b.shape, np.inf), np.zeros(b.shape, np.int32), np.zeros(b.shape, np.int32)
        for u in range(-max_u, max_u + 1):
            for v in range(-max_v, max_v + 1):
                both = (b != miss) & shifted(have, -u, -v, False)
                d = np.where(both, b - shifted(a, -u, -v, 0), 0).astype(float) ** 2
                d, q, n = (_window(x, est) for x in (d, np.where(both, b, 0).astype(float) ** 2, both.astype(float)))
                e = np.divide(d, q, out=np.full(b.shape, np.inf), where=(q > 0) & (d < 0.75 * q) & (2 * n >= most))
                less = e < best
                best, u_best, v_best = np.where(less, e, best), np.where(less, u, u_best), np.where(less, v, v_best)
        return {"u": u_best, "v": v_best}

    return by_tiles([now, Grid(before.df, replace(before.meta, missing=miss))], (est + max_u, est + max_v), run, "u int, v int")


def _window(x: np.ndarray, h: int) -> np.ndarray:
    """Sums over windows of half size h, term by term, so that doubles don't lose what running sums would."""
    for axis in (0, 1):
        p = np.pad(x, [(h, h) if k == axis else (0, 0) for k in (0, 1)])
        x = sum(np.take(p, range(i, i + x.shape[axis]), axis) for i in range(2 * h + 1))
    return x


def cost_matrix(a: DataFrame, b: DataFrame, most: float = 10000.0) -> DataFrame:
    """i, j, cost: squared distance of the centres of two region tables (label, cx, cy), where it is below most.

    Regions meet in squares of the largest distance that counts, each of b in the nine around its own.
    """
    side = float(np.sqrt(most))
    step = F.sequence(F.lit(-1), F.lit(1))
    near = b.withColumn("p", F.explode(step)).withColumn("q", F.explode(step)).select(F.col("label").alias("j"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), (F.floor(F.col("cx") / side) + F.col("p")).alias("sx"), (F.floor(F.col("cy") / side) + F.col("q")).alias("sy"))
    own = a.select(F.col("label").alias("i"), "cx", "cy", F.floor(F.col("cx") / side).alias("sx"), F.floor(F.col("cy") / side).alias("sy"))
    d = F.pow(F.col("cx") - F.col("x2"), 2) + F.pow(F.col("cy") - F.col("y2"), 2)
    return own.join(near, ["sx", "sy"]).select("i", "j", d.alias("cost")).where(F.col("cost") < most)


def greedy(cost: DataFrame) -> DataFrame:
    """The cheapest j of each i, the smallest on ties."""
    return cost.groupBy("i").agg(F.min(F.struct("cost", "j")).alias("b")).select("i", "b.j", "b.cost")


def horn_schunck(before: np.ndarray, now: np.ndarray, rounds: int = 50, alpha2: float = 100.0, size: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """u (rows) and v (columns), tenfold and rounded half up; the neighbourhood mean is a boxcar, 0 at the border."""
    a, b = before.astype(float), now.astype(float)
    it, ix, iy = b - a, np.zeros_like(a), np.zeros_like(a)
    ix[:-1], iy[:, :-1] = b[1:] - b[:-1], b[:, 1:] - b[:, :-1]
    u, v, h = np.zeros_like(a), np.zeros_like(a), size // 2

    def mean(x):
        s = np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
        out = np.zeros_like(x)
        if min(x.shape) >= size:
            out[h : x.shape[0] - h, h : x.shape[1] - h] = (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2
        return out

    for _ in range(rounds):
        mu, mv = mean(u), mean(v)
        k = (ix * mu + iy * mv + it) / (alpha2 + ix**2 + iy**2)
        u, v = mu - ix * k, mv - iy * k
    return np.floor(10 * u + 0.5).astype(int), np.floor(10 * v + 0.5).astype(int)


class Kalman:
    """Position and rate by a constant-velocity filter; noise is estimated from up to 10 past residuals."""

    def __init__(self, x0: float, dx0: float):
        self.x, self.p, self.q, self.past = np.array([x0, dx0], float), np.eye(2), np.eye(2) * 0.01, []

    def update(self, z: float) -> float:
        f = np.array([[1.0, 1.0], [0.0, 1.0]])
        x, p = f @ self.x, f @ self.p @ f.T + self.q
        res = z - x[0]
        self.past = [*self.past, res][-10:]
        r = max(1e-6, float(np.mean(np.square(self.past))))
        k = p[:, 0] / (p[0, 0] + r)
        x, p = x + k * res, p - np.outer(k, p[0])
        if not np.isfinite(x).all():
            x, p = np.array([z, 0.0]), np.eye(2)
        self.x, self.p = x, p
        return float(x[0])


def kalman(series: DataFrame) -> DataFrame:
    """key, t, z, x of series (key, t, z): filtered in the order of t, one task a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        z = pdf["z"].to_numpy(float)
        k = Kalman(z[0], 0.0)
        return pdf.assign(x=[z[0], *(k.update(v) for v in z[1:])])

    return series.select(F.col("key").cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.col("z").cast("double").alias("z")).groupBy("key").applyInPandas(run, "key string, t long, z double, x double")
