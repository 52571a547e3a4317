"""Euclidean distance, medial axis and thinning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.stencil import neighbours
from gridloom.plans.tables import forget, keep

CAP = 250 * 250


#: Columns of a strip, and the most cells it may hold.
WIDTH, STRIP = 64, 1 << 22


def _envelope(g: np.ndarray) -> np.ndarray:
    """For each row r and column the least of g[k] + (r - k)**2 over k, by the lower envelope of these parabolas; inf in g is no parabola.

    All columns go down together: each has a stack of the parabolas that its envelope holds so far and of the rows where they take over.
    """
    n, m = g.shape
    at, start = np.zeros((n, m), np.int64), np.full((n, m), np.inf)
    top = np.full(m, -1)
    for k in range(n):
        new = np.flatnonzero(np.isfinite(g[k]))
        x = np.full(len(new), -np.inf)
        live = np.flatnonzero(top[new] >= 0)
        while len(live):
            c = new[live]
            was = at[top[c], c]
            x[live] = (g[k, c] + k * k - g[was, c] - was * was) / (2.0 * (k - was))
            gone = x[live] <= start[top[c], c]
            start[top[c[gone]], c[gone]] = np.inf
            top[c[gone]] -= 1
            live = live[gone]
            empty = top[new[live]] < 0
            x[live[empty]] = -np.inf
            live = live[~empty]
        top[new] += 1
        at[top[new], new], start[top[new], new] = k, x
    out = np.full((n, m), np.inf)
    cols = np.flatnonzero(top >= 0)
    if len(cols):
        now, deep = np.zeros(len(cols), np.int64), top[cols]
        for r in range(n):
            while True:
                on = np.flatnonzero((now < deep) & (start[np.minimum(now + 1, n - 1), cols] <= r))
                if not len(on):
                    break
                now[on] += 1
            k = at[now, cols]
            out[r, cols] = g[k, cols] + (r - k) ** 2
    return out


def edt(g: Grid, t: int) -> Grid:
    """Squared distance to the nearest value above t; nrows**2 + ncols**2 where there is none.

    The distance along the row comes from two windows; the second pass takes a strip of columns at once, in linear time.
    """
    top, nrows, ncols = g.meta.nrows**2 + g.meta.ncols**2, g.meta.nrows, g.meta.ncols
    w = Window.partitionBy("row").orderBy("col")
    seed = F.when(F.col("value") > t, F.col("col"))
    left = F.last(seed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(seed, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = F.least(F.col("col") - left, right - F.col("col"))
    width = max(1, min(WIDTH, STRIP // nrows))

    def strip(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        first = int(col.min()) // width * width
        a = np.full((nrows, min(width, ncols - first)), np.inf)
        along = table.column("d")
        known = along.is_valid().to_numpy()
        a[row[known], col[known] - first] = along.drop_null().to_numpy().astype(float) ** 2
        best = _envelope(a)
        r, c = np.indices(best.shape, np.int32)
        return pa.table({"row": r.ravel(), "col": c.ravel() + np.int32(first), "value": np.where(np.isfinite(best), best, top).astype(np.int32).ravel()})

    one = g.df.select("row", "col", d.alias("d"), F.floor(F.col("col") / width).alias("strip"))
    return Grid(one.groupBy("strip").applyInArrow(strip, "row int, col int, value int"), g.meta)


def edt_clamped(g: Grid, t: int, cap: int = CAP) -> Grid:
    """edt(), missing beyond the cap."""
    d = edt(g, t)
    return Grid(d.df.select("row", "col", F.when(F.col("value") > cap, g.meta.missing).otherwise(F.col("value")).alias("value")), g.meta)


def medial_axis(g: Grid, t: int) -> Grid:
    """1 where the distance to the background is a maximum among the four neighbours and not 0."""
    back = g.map(lambda v: (v <= t).cast("int"))
    n = neighbours(edt(back, 0))
    ok = F.col("value") != 0
    for c in ("n_m_0", "n_p_0", "n_0_m", "n_0_p"):
        ok = ok & (F.col("value") >= F.coalesce(c, F.lit(0)))
    return Grid(n.select("row", "col", ok.cast("int").alias("value")), g.meta)


#: Tiles of thinning: their side, and rounds of one pass; a round sees two cells far.
TILE, ROUNDS = 256, 16


def _peel(x: np.ndarray, inner: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of parallel peeling; x is padded with 0 beyond its edges."""
    for _ in range(rounds):
        p = np.pad(x, 1)
        ring = [p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i, j in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
        a = sum(((ring[i] == 0) & (ring[(i + 1) % 8] == 1)).astype(np.int8) for i in range(8))
        b = sum(ring)
        q = np.pad(a, 1)
        north, east = q[:-2, 1:-1], q[1:-1, 2:]
        go = inner & (x == 1) & (b >= 2) & (b <= 6) & (a == 1) & ((ring[0] * ring[2] * ring[6] == 0) | (north != 1)) & ((ring[0] * ring[2] * ring[4] == 0) | (east != 1))
        if not go.any():
            break
        x = np.where(go, 0, x).astype(np.int8)
    return x


def skeleton(g: Grid, t: int, tile: int = TILE, rounds: int = ROUNDS) -> Grid:
    """Thin what is above t to lines by parallel peeling: a cell goes if it has 2 to 6 neighbours, one change from 0 to 1 around it, and
    the tests on its north and east neighbours hold. Inner cells only; stops when nothing changes.

    A pass peels each tile some rounds at once, with as much of its surroundings as those can see; passes go on until no cell changes.
    """
    halo, nrows, ncols = 2 * rounds, g.meta.nrows, g.meta.ncols

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r0, c0 = tr * tile - halo, tc * tile - halo
        x = np.zeros((tile + 2 * halo, tile + 2 * halo), np.int8)
        x[pdf["row"] - r0, pdf["col"] - c0] = pdf["value"]
        r, c = np.ogrid[r0 : r0 + x.shape[0], c0 : c0 + x.shape[1]]
        out = _peel(x, (r >= 1) & (r <= nrows - 2) & (c >= 1) & (c <= ncols - 2), rounds)
        own = (pdf["row"] // tile == tr) & (pdf["col"] // tile == tc)
        pdf = pdf[own]
        new = out[pdf["row"] - r0, pdf["col"] - c0].astype(int)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "value": new, "gone": new != pdf["value"]})

    cur = g.df.select("row", "col", (F.col("value") > t).cast("int").alias("value"))
    while True:
        near = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile)), F.least(F.lit((n - 1) // tile), F.floor((F.col(c) + halo) / tile))))
        new = keep(cur.withColumn("tr", near("row", nrows)).withColumn("tc", near("col", ncols)).groupBy("tr", "tc").applyInPandas(run, "row int, col int, value int, gone boolean"), "thin")
        if hasattr(cur, "old"):
            forget(cur.old)
        if not new.where("gone").limit(1).count():
            return Grid(new.select("row", "col", "value"), g.meta)
        cur = new.select("row", "col", "value")
        cur.old = new
