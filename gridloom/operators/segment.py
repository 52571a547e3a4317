"""Segmentation: connected components, hysteresis, watershed, and k-means with contiguity."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.graph import connected
from gridloom.operators.ranks import ranked
from gridloom.plans.tables import forget, keep


#: Side of the tiles that are labelled one by one.
TILE = 512


def _tile_roots(row: np.ndarray, col: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For cells of a tile the smallest of own among their 8-connected cells."""
    order = np.argsort(own)
    row, col, own = row[order] - row.min() + 1, col[order] - col.min() + 1, own[order]
    at = np.full((row.max() + 2, col.max() + 2), -1)
    at[row, col] = np.arange(len(row))
    ends = [(np.flatnonzero(at[row + i, col + j] >= 0), i, j) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a = np.concatenate([k for k, _, _ in ends])
    b = np.concatenate([at[row[k] + i, col[k] + j] for k, i, j in ends])
    root = np.arange(len(row))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # hook the larger root to the smaller
        while (root[root] != root).any():
            root = root[root]
    out = np.empty_like(own)
    out[order] = own[root]
    return out


def components(cells: DataFrame, ncols: int, tile: int = TILE) -> DataFrame:
    """cells (row, col, value) with root: the smallest row * ncols + col of their 8-connected component.

    Tiles are labelled one by one; pairs of labels that touch across a border of tiles then go through connected(), whose rounds are
    logarithmic in the number of tiles that a component crosses.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["row"].to_numpy(np.int64) * ncols + pdf["col"].to_numpy(np.int64)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "value": pdf["value"], "root": _tile_roots(pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), own)})

    t = lambda c: F.floor(F.col(c) / tile)
    one = keep(cells.select("row", "col", "value").groupBy(t("row").alias("tr"), t("col").alias("tc")).applyInPandas(run, "row int, col int, value int, root long"), "tiles")
    edge = one.where(F.expr(f"row % {tile} in (0, {tile - 1}) or col % {tile} in (0, {tile - 1})")).select("row", "col", "root")
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    near = edge.select(step.alias("o"), "row", "col", F.col("root").alias("a")).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "a")
    pairs = keep(near.join(edge, ["row", "col"]).where("a <> root").select("a", F.col("root").alias("b")).distinct(), "borders")
    if not pairs.limit(1).count():
        return one
    joined = connected(pairs)
    return one.join(joined, F.col("root") == F.col("node"), "left").select("row", "col", "value", F.coalesce("component", "root").alias("root"))


def label(g: Grid, t: int) -> DataFrame:
    """(row, col, value, label): components of values above t, numbered from 1 in raster order; 0 elsewhere."""
    found = components(g.df.where(F.col("value") > t), g.meta.ncols)
    return _numbered(g, found, found.groupBy("root").agg(F.min("root").alias("first")))


def hysteresis(g: Grid, t1: int, t2: int) -> DataFrame:
    """Components above the lower threshold that hold a cell above the higher one, numbered by their first such cell."""
    low, high = min(t1, t2), max(t1, t2)
    found = components(g.df.where(F.col("value") > low), g.meta.ncols)
    strong = found.where(F.col("value") > high).groupBy("root").agg(F.min(F.col("row").cast("long") * g.meta.ncols + F.col("col")).alias("first"))
    return _numbered(g, found, strong)


def _numbered(g: Grid, found: DataFrame, order: DataFrame) -> DataFrame:
    ids = ranked(order.select("root", "first"), "first", "label").drop("first")
    got = found.join(ids, "root").select("row", "col", "label")
    return g.df.join(got, ["row", "col"], "left").select("row", "col", "value", F.coalesce("label", F.lit(0)).alias("label"))


def _kernel(g: Grid, f) -> DataFrame:
    """(row, col, value) from a numpy function of the whole grid: for algorithms that depend on the order of cells. Grids run in parallel."""
    n, m, missing = g.meta.nrows, g.meta.ncols, g.meta.missing

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((n, m), missing, np.int64)
        a[pdf["row"], pdf["col"]] = pdf["value"]
        out = f(a)
        r, c = np.indices(out.shape)
        return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "row": r.ravel(), "col": c.ravel(), "value": out.ravel()})

    df = g.df if "grid_id" in g.df.columns else g.df.withColumn("grid_id", F.lit("grid"))
    out = df.groupBy("grid_id").applyInPandas(run, "grid_id string, row int, col int, value int")
    return out if "grid_id" in g.df.columns else out.drop("grid_id")


def watershed_array(a: np.ndarray, t: int) -> np.ndarray:
    """Flooding from the highest value down to t: a cell joins the basin it touches, 0 where two meet, a new basin where none is near."""
    out, seen = np.zeros(a.shape, int), np.zeros(a.shape, bool)
    order = sorted(((-int(a[r, c]), r, c) for r, c in zip(*np.nonzero(a > t), strict=True)))
    n, k = 0, 0
    heap: list = []
    while k < len(order) or heap:
        if not heap:
            level, r, c = order[k]
            k += 1
            if seen[r, c]:
                continue
            heap = [(level, 0, r, c)]
            seen[r, c] = True
        level, _, r, c = heapq.heappop(heap)
        near = [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= r + i < a.shape[0] and 0 <= c + j < a.shape[1]]
        basins = {out[p] for p in near} - {0}
        if not basins:
            n += 1
            out[r, c] = n
        elif len(basins) == 1:
            out[r, c] = basins.pop()
        tick = len(heap) + 1
        for p in near:
            if a[p] > t and not seen[p]:
                seen[p] = True
                heapq.heappush(heap, (-int(a[p]), tick, *p))
        # cells of a higher level that no basin has reached start basins of their own first
        while k < len(order) and heap and order[k][0] < heap[0][0]:
            level, r, c = order[k]
            k += 1
            if not seen[r, c]:
                seen[r, c] = True
                heapq.heappush(heap, (level, 0, r, c))
    return out


def watershed(g: Grid, t: int) -> DataFrame:
    return _kernel(g, lambda a: watershed_array(a, t))


def kmeans_contiguity(g: Grid, t: int, seed: int, max_diff: float, max_size: float, rounds: int = 9) -> DataFrame:
    """Label cells above t by the nearest cluster: 0.1 * share of unlike neighbours + 0.8 * |v - mean| / max_diff + 0.1 * distance**2 / max_size**2, if below 1.

    Clusters begin as components above seed, and rounds end when no label changes. A cluster can only win cells whose value and place lie
    within the reach of a distance below 1; it goes to the buckets of value, row and column around its own, and cells meet it there by equality.
    """
    value_side, side = 1.25 * max_diff, math.sqrt(10) * max_size
    cells = keep(label(g, seed), "kmeans")
    live = g.df.where(F.col("value") > t).select("row", "col", "value", F.floor(F.col("value") / value_side).alias("bv"), F.floor(F.col("row") / side).alias("br"), F.floor(F.col("col") / side).alias("bc"))
    for _ in range(rounds):
        v = F.col("value").cast("double")
        means = cells.where("label > 0").groupBy("label").agg((F.sum(F.col("row") * v) / F.sum(v)).alias("cx"), (F.sum(F.col("col") * v) / F.sum(v)).alias("cy"), F.avg(v).alias("cval"))
        around = lambda c, s: F.explode(F.sequence(F.floor(F.col(c) / s) - 1, F.floor(F.col(c) / s) + 1))
        means = means.withColumn("bv", around("cval", value_side)).withColumn("br", around("cx", side)).withColumn("bc", around("cy", side))
        pairs = live.join(means, ["bv", "br", "bc"])
        step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
        near = cells.where("label > 0").select(step.alias("o"), "row", "col", "label").select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "label").groupBy("row", "col", "label").agg(F.count("*").alias("like"))
        d = 0.1 * (1 - F.coalesce("like", F.lit(0)) / 8) + 0.8 * F.abs(F.col("value") - F.col("cval")) / max_diff + 0.1 * (F.pow(F.col("row") - F.col("cx"), 2) + F.pow(F.col("col") - F.col("cy"), 2)) / max_size**2
        best = pairs.join(near, ["row", "col", "label"], "left").withColumn("d", d).where("d < 1").groupBy("row", "col").agg(F.min(F.struct("d", "label")).alias("b"))
        new = g.df.join(best, ["row", "col"], "left").select("row", "col", "value", F.coalesce("b.label", F.lit(0)).alias("label"))
        new = keep(new.join(cells.select("row", "col", F.col("label").alias("was")), ["row", "col"]), "kmeans")
        same = new.where("label <> was").isEmpty()
        forget(cells)
        new_cells = new.select("row", "col", "value", "label")
        new_cells.kept_at = new.kept_at
        cells = new_cells
        if same:
            break
    return cells


def hungarian(cost: np.ndarray, mode: str = "reference", top: float = 10000) -> np.ndarray:
    """Column of each row, or -1. reference: row reduction and the first free zero; optimal: least total cost. Costs of top or more are never chosen."""
    cost = np.minimum(np.asarray(cost, float), top)
    if cost.shape[1] < cost.shape[0]:
        out = np.full(cost.shape[0], -1)
        for j, i in enumerate(hungarian(cost.T, mode, top)):
            if i >= 0:
                out[i] = j
        return out
    if mode == "reference":
        out, free = np.full(len(cost), -1), np.ones(cost.shape[1], bool)
        for i, row in enumerate(cost):
            zero = np.flatnonzero((row == row.min()) & free & (row < top))
            if len(zero):
                out[i], free[zero[0]] = zero[0], False
        return out
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0, low, used = i, 0, np.full(m + 1, math.inf), np.zeros(m + 1, bool)
        while p[j0]:
            used[j0] = True
            free = np.flatnonzero(~used)
            cur = cost[p[j0] - 1][free - 1] - u[p[j0]] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = int(free[np.argmin(low[free])])
            delta = low[j1]
            u[p[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if p[j] and cost[p[j] - 1, j - 1] < top:
            out[p[j] - 1] = j - 1
    return out
