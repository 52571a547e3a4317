"""Motion from coarse to fine, from edges, and by objects."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround
from gridloom.operators import cells, motion, segment, stats, stencil
from gridloom.operators.field import inverse_distance
from gridloom.plans.tables import keep


#: Objects of a frame whose assignment may be solved on the driver, and cells of a frame that may come there.
MOST_SOLVED, MOST_CELLS = 3000, 20_000_000


def shrink(g: Grid, f: int) -> Grid:
    """Smoothed by an odd boxcar of at least f, then every f-th cell."""
    return g if f == 1 else cells.decimate(stencil.smooth(g, stencil.boxcar(f + 1 - f % 2)), f)


def _grow(shift: DataFrame, g: Grid, f: int) -> DataFrame:
    """Shifts of coarse cells, times f, at the f * f cells of g that each stands for."""
    step = F.explode(F.sequence(F.lit(0), F.lit(f - 1)))
    big = shift.withColumn("i", step).withColumn("j", step)
    big = big.select((F.col("row") * f + F.col("i")).alias("row"), (F.col("col") * f + F.col("j")).alias("col"), (F.col("u") * f).alias("u"), (F.col("v") * f).alias("v"))
    return big.where((F.col("row") < g.meta.nrows) & (F.col("col") < g.meta.ncols))


def pyramid(before: Grid, now: Grid, most: int) -> DataFrame:
    """row, col, u, v: shifts of up to most, found at halving resolutions by correlation within one cell, each after moving by the sum so far.

    The window grows by one with each resolution. Each level is written, so plans stay short. Frames are padded to multiples of the coarsest cell.
    """
    levels = int(math.floor(math.log2(max(1, most)) + 0.5))
    f = 1 << levels
    nr, nc = (-(-n // f) * f for n in (now.meta.nrows, now.meta.ncols))
    a, b = (cells.pad(g, nr, nc) for g in (before, now))
    a, b = Grid(keep(a.df, "pyramid"), a.meta), Grid(keep(b.df, "pyramid"), b.meta)
    total, moved = None, a
    for level in range(levels, -1, -1):
        if total is not None:
            at = total.select(F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") - F.col("u")).alias("row"), (F.col("col") - F.col("v")).alias("col"))
            at = at.join(a.df, ["row", "col"], "left").select(F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("value", F.lit(a.meta.missing)).alias("value"))
            moved = Grid(keep(at, "pyramid"), a.meta)
        s = 1 << level
        found = _grow(motion.cross_correlation(shrink(moved, s), shrink(b, s), levels - level, 1, 1), b, s)
        if total is not None:
            found = found.join(total.withColumnsRenamed({"u": "pu", "v": "pv"}), ["row", "col"]).select("row", "col", (F.col("u") + F.col("pu")).alias("u"), (F.col("v") + F.col("pv")).alias("v"))
        total = keep(found, "pyramid")
    return total.where((F.col("row") < now.meta.nrows) & (F.col("col") < now.meta.ncols))


def edge_motion(before: Grid, now: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Optical flow between the Sobel responses of two frames, missing as 0; a frame, of MOST_CELLS at most, goes to the driver."""
    if now.meta.nrows * now.meta.ncols > MOST_CELLS:
        raise ValueError("frames are too large for the driver; crop or decimate them first")
    out = []
    for g in (before, now):
        p = stencil.sobel(g).map(lambda v, m=g.meta.missing: F.when(v == m, 0).otherwise(v)).df.toPandas()
        a = np.zeros((g.meta.nrows, g.meta.ncols))
        a[p["row"], p["col"]] = p["value"]
        out.append(a)
    return motion.horn_schunck(*out)


def track(before: Grid, now: Grid, low: int, high: int, least: int, mode: str = "greedy") -> DataFrame:
    """row, col, u, v of cells of now: tenfold shift of the centre of their object from the one assigned in before; 0 without.

    Objects come by hysteresis and have at least as many cells as least. greedy assigns by joins alone; reference and optimal
    solve on the driver, over a matrix of objects, of which there may be MOST_SOLVED in a frame.
    """
    sides = [stats.prune(segment.hysteresis(g, low, high), least) for g in (before, now)]
    old, new = (keep(stats.regions(s).select("label", "cx", "cy"), "track") for s in sides)
    cost = motion.cost_matrix(new, old)
    if mode == "greedy":
        pairs = motion.greedy(cost).select("i", "j")
    else:
        if max(old.count(), new.count()) > MOST_SOLVED:
            raise ValueError("too many objects to solve for on the driver; assign greedily or prune the small ones")
        rows = cost.collect()
        m = np.full((max((r.i for r in rows), default=0), max((r.j for r in rows), default=0)), 10000.0)
        for r in rows:
            m[r.i - 1, r.j - 1] = r.cost
        got = [(i + 1, int(j) + 1) for i, j in enumerate(segment.hungarian(m, mode) if m.size else []) if j >= 0]
        pairs = before.df.sparkSession.createDataFrame(got, "i int, j int")
    at = pairs.join(new.select(F.col("label").alias("i"), "cx", "cy"), "i").join(old.select(F.col("label").alias("j"), F.col("cx").alias("ox"), F.col("cy").alias("oy")), "j")
    shift = at.select(F.col("i").alias("label"), jround(10 * (F.col("cx") - F.col("ox"))).alias("u"), jround(10 * (F.col("cy") - F.col("oy"))).alias("v"))
    return sides[1].join(shift, "label", "left").select("row", "col", F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("v", F.lit(0)).alias("v"))


def hybrid(before: Grid, now: Grid, labels: DataFrame, max_u: int, max_v: int) -> DataFrame:
    """row, col, u, v: each object's shift of least absolute difference, then weighted by size / (distance**4 + 0.0001) over all objects.

    labels: row, col, value, label of now. Cells that a shift takes off the grid add no difference; ties go to the first shift.
    With one object or none, its cells keep its shift and others 0. Far objects count by boxes, see operators/field: within 1 of the plain sum.
    """
    shifts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(u).alias("u"), F.lit(v).alias("v")) for k, (u, v) in enumerate((u, v) for u in range(-max_u, max_u + 1) for v in range(-max_v, max_v + 1))))
    own = labels.where("label > 0")
    asked = own.withColumn("s", F.explode(shifts)).select("label", "s", F.col("value").alias("is"), (F.col("row") - F.col("s.u")).alias("row"), (F.col("col") - F.col("s.v")).alias("col"))
    was = asked.join(before.df, ["row", "col"], "left")
    errors = was.groupBy("label", "s").agg(F.sum(F.coalesce(F.abs(F.col("is") - F.col("value")), F.lit(0))).alias("e"))
    best = errors.groupBy("label").agg(F.min(F.struct("e", F.col("s.k").alias("k"), F.col("s.u").alias("u"), F.col("s.v").alias("v"))).alias("b"))
    objects = keep(stats.regions(own).join(best, "label").select("label", "cx", "cy", "size", "b.u", "b.v"), "hybrid")
    if objects.count() < 2:
        return labels.select("row", "col", "label").join(objects.select("label", "u", "v"), "label", "left").select("row", "col", F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("v", F.lit(0)).alias("v"))
    return inverse_distance(objects, now.meta)
