"""Neighbourhood filters. Extrema and local statistics are separable windows; kernels and medians go by tiles with a rim.

Filters leave a border of half a kernel missing. A kernel of any size is one exchange of tiles, which carries each border once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround
from gridloom.operators.tiles import by_tiles, weighted

Kernel = list[list[float]]
#: Above every value of a grid.
MOST = 1 << 40


def boxcar(n: int) -> Kernel:
    return [[1.0] * n for _ in range(n)]


def gauss(n: int) -> Kernel:
    """exp(-(x*x + y*y)) with x = (i - n / 2) / (n / 6); the centre lies half a cell off."""
    s = n / 6
    return [[math.exp(-(((i - n / 2) / s) ** 2) - ((j - n / 2) / s) ** 2) for j in range(n)] for i in range(n)]


def _inner(g: Grid, hr: int, hc: int):
    return F.col("row").between(hr, g.meta.nrows - 1 - hr) & F.col("col").between(hc, g.meta.ncols - 1 - hc)


def _windowed(g: Grid, k: Kernel, f, none: int) -> Grid:
    """A grid from f(values, valid) of each tile: results and where there are any; other cells, and the border, become none."""
    if len(k) % 2 == 0 or len(k[0]) % 2 == 0:
        raise ValueError("a kernel needs odd sizes")
    hr, hc, miss = len(k) // 2, len(k[0]) // 2, g.meta.missing

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        valid = a != miss
        got, ok = f(np.where(valid, a, 0), valid)
        return {"value": np.where(ok, got, none).astype(np.int32)}

    cells = by_tiles([g], (hr, hc), run, "value int")
    return Grid(cells.select("row", "col", F.when(_inner(g, hr, hc), F.col("value")).otherwise(none).alias("value")), replace(g.meta, missing=none))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def smooth(g: Grid, k: Kernel) -> Grid:
    """Weighted mean of valid values; missing where the weights sum to nothing."""

    def mean(a, valid):
        s, w = weighted(a, k), weighted(valid.astype(np.int64), k)
        return _rounded(np.divide(s, w, out=np.zeros_like(s), where=w > 0)), w > 0

    return _windowed(g, k, mean, g.meta.missing)


def convolve(g: Grid, k: Kernel) -> Grid:
    """Weighted sum of valid values; inner cells without any are 0."""
    return _windowed(g, k, lambda a, valid: (_rounded(weighted(a, k)), True), g.meta.missing)


def matched(g: Grid, k: Kernel) -> Grid:
    """10000 * correlation share with the kernel at sum 1; missing is -1."""
    total = sum(map(sum, k))
    unit, under = [[w / total for w in line] for line in k], [[float(w != 0) for w in line] for line in k]

    def share(a, valid):
        s, v = weighted(a, unit), weighted(a, under)
        return _rounded(np.round(np.divide(10000.0 * s, v, out=np.zeros_like(s), where=v != 0), 6)), v != 0

    return _windowed(g, k, share, -1)


def _extreme(g: Grid, h: int, agg: Callable) -> Grid:
    v = F.when(F.col("value") != g.meta.missing, F.col("value"))
    one = g.df.select("row", "col", agg(v).over(Window.partitionBy("row").orderBy("col").rowsBetween(-h, h)).alias("v"))
    two = one.select("row", "col", agg("v").over(Window.partitionBy("col").orderBy("row").rowsBetween(-h, h)).alias("v"))
    return Grid(two.select("row", "col", F.when(_inner(g, h, h), F.coalesce("v", F.lit(g.meta.missing))).otherwise(g.meta.missing).alias("value")), g.meta)


def dilate(g: Grid, h: int) -> Grid:
    return _extreme(g, h, F.max)


def erode(g: Grid, h: int) -> Grid:
    return _extreme(g, h, F.min)


def multi(g: Grid, filters: list[Callable[[Grid], Grid]], times: int = 1) -> Grid:
    for f in filters * times:
        g = f(g)
    return g


def close(g: Grid, h: int, times: int = 1) -> Grid:
    return multi(g, [lambda x: dilate(x, h)] * times + [lambda x: erode(x, h)] * times)


def open_(g: Grid, h: int, times: int = 1) -> Grid:
    return multi(g, [lambda x: erode(x, h)] * times + [lambda x: dilate(x, h)] * times)


def median(g: Grid, h: int) -> Grid:
    """The upper median of valid values. A tile sorts the windows of some rows at a time, so its memory doesn't follow the window."""

    def upper(a, valid):
        n = 2 * h + 1
        out = np.zeros(a.shape, np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(np.where(valid, a, MOST), (n, n))
        full = np.lib.stride_tricks.sliding_window_view(valid, (n, n)).sum((2, 3))
        step = max(1, (1 << 21) // (n * n * windows.shape[1]))
        for r in range(0, windows.shape[0], step):
            w = np.sort(windows[r : r + step].reshape(-1, n * n), axis=1)
            c = full[r : r + step].ravel()
            out[h + r : h + min(r + step, windows.shape[0]), h : a.shape[1] - h] = w[np.arange(len(w)), np.minimum(c // 2, n * n - 1)].reshape(-1, windows.shape[1])
        ok = np.zeros(a.shape, bool)
        ok[h : a.shape[0] - h, h : a.shape[1] - h] = full > 0
        return out, ok

    return _windowed(g, boxcar(2 * h + 1), upper, g.meta.missing)


def speckle(g: Grid, h: int, change: int) -> Grid:
    """The median where a value differs from it by more than change."""
    m = median(g, h).df.withColumnRenamed("value", "m")
    use = (F.col("m") != g.meta.missing) & (F.abs(F.col("value") - F.col("m")) > change)
    return Grid(g.df.join(m, ["row", "col"]).select("row", "col", F.when(use, F.col("m")).otherwise(F.col("value")).alias("value")), g.meta)


def separable_smooth(g: Grid, kr: list[float], kc: list[float]) -> Grid:
    """Along columns' axis first with rounding, then along rows; cells that the first pass leaves out are 0 for the second, edges included."""
    def one(df, k, by, along, n, none):
        h, w = len(k) // 2, Window.partitionBy(by).orderBy(along)
        v = F.when(F.col("value") != g.meta.missing, F.col("value"))
        at = df.select("row", "col", *((F.lag(v, h - i).over(w) if i < h else F.lead(v, i - h).over(w) if i > h else v).alias(f"v{i}") for i in range(len(k))))
        top = sum(F.coalesce(F.col(f"v{i}") * F.lit(x), F.lit(0.0)) for i, x in enumerate(k))
        low = sum(F.when(F.col(f"v{i}").isNotNull(), x).otherwise(0.0) for i, x in enumerate(k))
        inner = F.col(along).between(h, n - 1 - h) & (low > 0)
        return at.select("row", "col", F.when(inner, jround(top / F.nullif(low, F.lit(0.0)))).otherwise(none).alias("value"))

    first = one(g.df, kr, "col", "row", g.meta.nrows, 0)
    return Grid(one(first, kc, "row", "col", g.meta.ncols, g.meta.missing), g.meta)


def neighbours(g: Grid) -> DataFrame:
    """Each cell with its eight neighbours n_i_j (null outside), by windows along columns and then rows."""
    c, r = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    side = g.df.select("row", "col", "value", F.lag("value").over(c).alias("w"), F.lead("value").over(c).alias("e"))
    return side.select("row", "col", "value", F.col("w").alias("n_0_m"), F.col("e").alias("n_0_p"), *(f(x).over(r).alias(f"n_{i}_{j}") for i, f in (("m", F.lag), ("p", F.lead)) for j, x in (("m", "w"), ("0", "value"), ("p", "e"))))


def sobel(g: Grid) -> Grid:
    """|gx| + |gy| of inner cells whose neighbours are all valid."""
    n = neighbours(g)
    every = [c for c in n.columns if c.startswith("n_")]
    ok = F.lit(True)
    for c in every:
        ok = ok & F.col(c).isNotNull() & (F.col(c) != g.meta.missing)
    gx = F.expr("n_m_p + 2 * n_0_p + n_p_p - n_m_m - 2 * n_0_m - n_p_m")
    gy = F.expr("n_p_m + 2 * n_p_0 + n_p_p - n_m_m - 2 * n_m_0 - n_m_p")
    return Grid(n.select("row", "col", F.when(ok, F.abs(gx) + F.abs(gy)).otherwise(g.meta.missing).alias("value")), g.meta)


def local_stats(g: Grid, nx: int, ny: int) -> DataFrame:
    """row, col, mean, stdev, min, max of the window, which is clipped at the edges; missing centres get values too."""
    hx, hy = nx // 2, ny // 2
    v = F.when(F.col("value") != g.meta.missing, F.col("value")).cast("double")
    w1 = Window.partitionBy("row").orderBy("col").rowsBetween(-hy, hy)
    one = g.df.select("row", "col", F.sum(v).over(w1).alias("s"), F.sum(v * v).over(w1).alias("q"), F.count(v).over(w1).alias("n"), F.min(v).over(w1).alias("lo"), F.max(v).over(w1).alias("hi"))
    w2 = Window.partitionBy("col").orderBy("row").rowsBetween(-hx, hx)
    two = one.select("row", "col", F.sum("s").over(w2).alias("s"), F.sum("q").over(w2).alias("q"), F.sum("n").over(w2).alias("n"), F.min("lo").over(w2).alias("lo"), F.max("hi").over(w2).alias("hi"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    var = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))
    miss = F.lit(g.meta.missing)
    return two.select("row", "col", F.coalesce(jround(mean), miss).alias("mean"), F.coalesce(jround(F.sqrt(var)), miss).alias("stdev"), F.coalesce(F.col("lo").cast("int"), miss).alias("min"), F.coalesce(F.col("hi").cast("int"), miss).alias("max"))
