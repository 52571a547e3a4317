"""Grids dealt as square tiles, each with a rim of its neighbours' cells, so that a window operator is one shuffle and numpy.

A cell goes to its own tile, and a cell near a border to the tiles beside it as well: the exchange carries (side + 2 rim)**2 / side**2 rows a
cell, whatever the window. Side grows with the rim.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid

SIDE = 256


def by_tiles(grids: list[Grid], rim: tuple[int, int], f: Callable[..., dict[str, np.ndarray]], schema: str, side: int | None = None) -> DataFrame:
    """row, col and the columns of schema for every cell of the first grid.

    f gets each grid's tile with its rim (missing beyond the edges, and where a grid has no cell), and returns an array of the same
    shape for each column; or one of shape (tile, k) for a column of k-element arrays.
    """
    first = grids[0]
    nrows, ncols = first.meta.nrows, first.meta.ncols
    rr, rc = rim
    side = max(side or SIDE, rr, rc)
    df = first.df.select("row", "col", F.col("value").alias("v0"))
    for k, g in enumerate(grids[1:], 1):
        df = df.join(g.df.select("row", "col", F.col("value").alias(f"v{k}")), ["row", "col"], "left")

    def near(c: str, reach: int, n: int):
        t = lambda x: F.floor(x / side).cast("int")
        return F.explode(F.sequence(F.greatest(F.lit(0), t(F.col(c) - reach)), F.least(F.lit((n - 1) // side), t(F.col(c) + reach))))

    dealt = df.withColumn("tr", near("row", rr, nrows)).withColumn("tc", near("col", rc, ncols))
    names = [x.split()[0] for x in schema.split(",")]
    missing = [g.meta.missing for g in grids]

    def run(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        r0, c0 = tr * side - rr, tc * side - rc
        shape = min(side, nrows - tr * side) + 2 * rr, min(side, ncols - tc * side) + 2 * rc
        tiles = []
        for k, miss in enumerate(missing):
            a = np.full(shape, miss, np.int64)
            v = table.column(f"v{k}")
            a[row - r0, col - c0] = (v.fill_null(miss) if v.null_count else v).to_numpy()
            tiles.append(a)
        out = f(*tiles)
        own = (row >= tr * side) & (row < (tr + 1) * side) & (col >= tc * side) & (col < (tc + 1) * side)
        at = row[own] - r0, col[own] - c0
        cols = [out[c][at] for c in names]
        return pa.table({"row": row[own].astype(np.int32), "col": col[own].astype(np.int32)} | {c: (pa.array(x) if x.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))) for c, x in zip(names, cols, strict=True)})

    return dealt.groupBy("tr", "tc").applyInArrow(run, f"row int, col int, {schema}")


def shifted(a: np.ndarray, i: int, j: int, fill) -> np.ndarray:
    """b with b[r, c] = a[r + i, c + j], fill beyond the tile."""
    out = np.full_like(a, fill)
    n, m = a.shape
    out[max(0, -i) : n - max(0, i), max(0, -j) : m - max(0, j)] = a[max(0, i) : n - max(0, -i), max(0, j) : m - max(0, -j)]
    return out


def box_sum(a: np.ndarray, hr: int, hc: int) -> np.ndarray:
    """Sums over windows of (2 hr + 1) x (2 hc + 1), clipped at the tile's edges, by running sums; exact for integers."""
    for axis, h in ((0, hr), (1, hc)):
        n = a.shape[axis]
        s = np.concatenate((np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)), axis)
        at = np.arange(n)
        a = np.take(s, np.minimum(at + h + 1, n), axis) - np.take(s, np.maximum(at - h, 0), axis)
    return a


def weighted(a: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    """Sum of kernel[i][j] * a[r + i - h, c + j - k] over the kernel, nothing beyond the tile; one weight for all goes by running sums."""
    k = np.asarray(kernel, float)
    hr, hc = k.shape[0] // 2, k.shape[1] // 2
    if (k == k[0, 0]).all() and np.issubdtype(a.dtype, np.integer):
        return box_sum(a, hr, hc) * k[0, 0]
    p = np.pad(a.astype(float), ((hr, hr), (hc, hc)))
    out = np.zeros(a.shape)
    for i in range(k.shape[0]):
        for j in range(k.shape[1]):
            if k[i, j]:
                out += k[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]]
    return out
