"""Objects around peaks, levels by k-means, active contours, and texture around each cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import segment, stats
from gridloom.operators.stats import DIRECTIONS
from gridloom.operators.tiles import box_sum, by_tiles, shifted
from gridloom.plans.tables import keep

FREE, FOOT = -1, -2
#: Side of the squares in which contours and cells meet.
SQUARE = 64
RING = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _peaks(q: np.ndarray, top: int, least: int) -> list[tuple[int, int, int]]:
    """(bin, row, col) of peaks from the highest bin down: the last line of the square around each is inside the grid and free."""
    near = math.floor(1.5 + 0.5 * math.sqrt(least))
    taken, found = np.zeros(q.shape, bool), []
    for b in range(top, -1, -1):
        h = near + math.floor(b / max(1, top) * near + 0.5)
        for r, c in np.argwhere(q == b).tolist():
            if taken[r, c] or r + h >= q.shape[0] or c - h < 0 or c + h >= q.shape[1] or taken[r + h, c - h : c + h + 1].any():
                continue
            found.append((b, r, c))
            for line in taken[max(0, r - h) : r + h + 1, c - h : c + h + 1]:  # each line up to the first cell that is taken
                line[: int(np.argmax(line)) if line.any() else len(line)] = True
    return found


def _flood(start: list, ok) -> list:
    """Cells reached from start through neighbours for which ok(cell, from) holds; start included."""
    seen, todo = set(start), list(start)
    while todo:
        p = todo.pop()
        for i, j in RING:
            n = (p[0] + i, p[1] + j)
            if n not in seen and ok(n, p):
                seen.add(n)
                todo.append(n)
    return list(seen)


def peak_objects_array(a: np.ndarray, missing: int, low: int, incr: int, high: int, least: int, delta: int) -> np.ndarray:
    """Bins of cells that belong to objects, 0 elsewhere.

    A peak takes the free cells around it whose bins lie at most d below its own, if they are at least `least`, for d = 0..delta in turn.
    Lower cells down its slopes, or nearer to it than to any other peak, become foothills and belong to nothing.
    """
    top = (high - low) // incr
    q = np.where((a == missing) | (a < low), -1, np.minimum((a - low) // incr, top))
    peaks = _peaks(q, top, least)
    mark = np.full(a.shape, FREE)
    at = np.array([p[1:] for p in peaks]).reshape(-1, 2)
    inside = lambda p: 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and mark[p] == FREE
    for d in range(delta + 1):
        for b, r, c in peaks:
            if mark[r, c] != FREE:
                continue
            floor = max(0, b - d)
            own = _flood([(r, c)], lambda p, _: inside(p) and q[p] >= floor)
            if len(own) < least:
                continue
            for p in own:
                mark[p] = b

            def foot(p, source):
                if not inside(p) or not 0 <= q[p] < floor:
                    return False
                far = ((at - p) ** 2).sum(1)
                return q[p] <= q[source] or (r - p[0]) ** 2 + (c - p[1]) ** 2 <= far.min()

            for p in set(_flood(own, foot)) - set(own):
                mark[p] = FOOT
    return np.maximum(mark, 0)


def peak_objects(g: Grid, low: int, incr: int, high: int, least: int, delta: int) -> DataFrame:
    """row, col, value, label: objects of at least so many cells around peaks; the search depends on order, so a grid is one task."""
    m = g.meta.missing
    found = segment._kernel(g, lambda a: peak_objects_array(a, m, low, incr, high, least, delta))
    labels = stats.prune(segment.label(Grid(keep(found, "peaks"), g.meta), 0), least)
    return g.df.join(labels.select("row", "col", "label"), ["row", "col"])


def kmeans_levels(g: Grid, t1: int, t2: int, k: int, rounds: int = 9) -> Grid:
    """Levels 0..k of valid cells: by 0.8 * |v - mean| / increment + 0.2 * share of cells around that differ from its own, 0 if no level is below 1.

    They begin as round((v - t1) / increment). A round is one aggregation of k means and a join of each cell with its neighbours' levels.
    """
    incr = (t2 - t1) / k
    start = F.least(F.greatest(F.floor((F.col("value") - t1) / F.lit(incr) + 0.5), F.lit(0)), F.lit(k)).cast("int")
    cur = g.df.select("row", "col", "value", F.when(F.col("value") == g.meta.missing, 0).otherwise(start).alias("level"))
    for _ in range(rounds):
        means = {r["level"]: r["m"] for r in cur.where("level > 0").groupBy("level").agg(F.avg("value").alias("m")).collect()}
        step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in [(0, 0), *RING])))
        near = cur.select("level", step.alias("o"), "row", "col").select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "level")
        around = near.groupBy("row", "col").agg(F.array(*(F.count(F.when(F.col("level") == x, 1)) for x in range(k + 1))).alias("like"), F.count("*").alias("all"))
        unlike = 1 - F.get("like", F.col("level")) / F.col("all")
        d = [F.struct((0.8 * F.abs(F.col("value") - F.lit(float(means[x]))) / F.lit(incr) + 0.2 * unlike).alias("d"), F.lit(x).alias("x")) for x in sorted(means)]
        best = F.array_min(F.array(F.struct(F.lit(1.0).alias("d"), F.lit(0).alias("x")), *d))["x"]
        new = keep(cur.join(around, ["row", "col"]).select("row", "col", "value", F.when(F.col("value") == g.meta.missing, 0).otherwise(best).alias("level"), F.col("level").alias("was")), "levels")
        changed = new.where("level <> was").limit(1).count()
        cur = new.drop("was")
        if not changed:
            break
    return Grid(cur.select("row", "col", F.col("level").alias("value")), g.meta)


def multiscale(g: Grid, t1: int, t2: int, k: int) -> list[DataFrame]:
    """Labels of the components above each of the levels 1..k; the last has none."""
    levels = kmeans_levels(g, t1, t2, k)
    levels = Grid(keep(levels.df, "levels"), g.meta)
    return [segment.label(levels, t) for t in range(1, k + 1)]


def snake_array(gradient: np.ndarray, nodes: list[tuple[int, int]], rounds: int = 50) -> list[tuple[int, int]]:
    """A closed contour pulled to strong gradients, node by node in 3 x 3 squares: 0.6 continuity + 0.1 curvature - 0.3 gradient, each from 0 to 1.

    Sharp corners lose their curvature term. Between rounds, nodes that meet are merged and gaps over twice the mean are halved.
    """
    strong = (gradient - gradient.min()) / max(1e-9, float(np.ptp(gradient)))
    size, p = np.array(gradient.shape) - 1, np.array(nodes, float)
    box = np.array([(0, 0), *RING], float)
    for _ in range(rounds):
        moved, n = False, len(p)
        gap = np.linalg.norm(p - np.roll(p, 1, 0), axis=1).mean()
        for k in range(n):
            a, c = p[k - 1], p[(k + 1) % n]
            to = np.clip(p[k] + box, 0, size)
            even, bend = np.abs(gap - np.linalg.norm(to - a, axis=1)), ((a - 2 * to + c) ** 2).sum(1)
            u, v = p[k] - a, c - p[k]
            corner = float(u @ v) < 0.25 * np.linalg.norm(u) * np.linalg.norm(v)
            scaled = [x / max(1e-9, x.max()) for x in (even, bend)]
            cost = 0.6 * scaled[0] + (0 if corner else 0.1) * scaled[1] - 0.3 * strong[tuple(to.astype(int).T)]
            best = int(np.argmin(cost))  # staying comes first among equals
            moved |= best > 0 and bool((to[best] != p[k]).any())
            p[k] = to[best]
        apart = np.linalg.norm(np.roll(p, -1, 0) - p, axis=1)
        out = []
        for k in range(len(p)):
            if apart[k] > 0:
                out.append(p[k])
                if apart[k] > 2 * max(1.0, gap):
                    out.append(np.floor((p[k] + p[(k + 1) % len(p)]) / 2))
        if len(out) < 4 or not moved:
            break
        p = np.array(out)
    return [(int(r), int(c)) for r, c in p]


def snakes(gradient: Grid, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """contour, seq, row, col of contours (contour, seq, row, col) pulled to the gradient, a task for each; each gets the grid's cells around it only."""
    margin = rounds
    square = lambda c: F.floor(c / SQUARE)
    span = lambda a, b: F.explode(F.sequence(square(F.col(a) - margin), square(F.col(b) + margin)))
    box = nodes.groupBy("contour").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # a contour goes to the squares that its box touches, so cells and contours meet by equality
    box = box.withColumn("sr", span("r0", "r1")).withColumn("sc", span("c0", "c1"))
    cells = gradient.df.withColumns({"sr": square(F.col("row")), "sc": square(F.col("col"))}).join(box, ["sr", "sc"])
    cells = cells.where(F.col("row").between(F.col("r0") - margin, F.col("r1") + margin) & F.col("col").between(F.col("c0") - margin, F.col("c1") + margin)).select("contour", F.lit(-1).alias("seq"), "row", "col", "value")
    every = cells.unionByName(nodes.select("contour", "seq", "row", "col", F.lit(0).alias("value")))
    missing = gradient.meta.missing

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, n = pdf[pdf["seq"] < 0], pdf[pdf["seq"] >= 0].sort_values("seq")
        r0, c0 = c["row"].min(), c["col"].min()
        a = np.zeros((c["row"].max() - r0 + 1, c["col"].max() - c0 + 1))
        a[c["row"] - r0, c["col"] - c0] = c["value"].where(c["value"] != missing, 0)
        out = snake_array(a, list(zip(n["row"] - r0, n["col"] - c0, strict=True)), rounds)
        return pd.DataFrame({"contour": pdf["contour"].iloc[0], "seq": range(len(out)), "row": [r + r0 for r, _ in out], "col": [x + c0 for _, x in out]})

    return every.groupBy("contour").applyInPandas(run, "contour int, seq int, row int, col int")


def local_texture(g: Grid, nx: int, ny: int, low: int, incr: int, nbins: int) -> DataFrame:
    """row, col, direction, uniformity and max_prob (hundredfold, rounded) of the pairs of bins in the window around each cell.

    Bin nbins holds what is missing or outside. A tile counts one pair of bins after another by running sums.
    """
    hx, hy = nx // 2, ny // 2
    miss, cells = g.meta.missing, (2 * hx + 1) * (2 * hy + 1)
    names = list(DIRECTIONS)

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        bins = np.where((a == miss) | (a < low), nbins, np.minimum((a - low) // incr, nbins - 1))
        uniformity, largest = (np.zeros((*a.shape, len(names)), np.int32) for _ in range(2))
        for d, name in enumerate(names):
            pair = bins * (nbins + 1) + shifted(bins, *DIRECTIONS[name], nbins)
            squares, most = np.zeros(a.shape, np.int64), np.zeros(a.shape, np.int64)
            for x in np.unique(pair):
                n = box_sum((pair == x).astype(np.int64), hx, hy)
                squares += n * n
                np.maximum(most, n, out=most)
            uniformity[..., d] = np.floor(100 * np.round(squares / cells**2, 9) + 0.5)
            largest[..., d] = np.floor(100 * np.round(most / cells, 9) + 0.5)
        return {"uniformity": uniformity, "max_prob": largest}

    at = by_tiles([g], (hx + 1, hy + 1), run, "uniformity array<int>, max_prob array<int>")
    one = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("direction"), "uniformity", "max_prob")).alias("x")
    return at.select("row", "col", one).select("row", "col", F.col("x.direction").alias("direction"), F.col("x.uniformity").alias("uniformity"), F.col("x.max_prob").alias("max_prob"))
