"""Inverse-distance fields of many objects by boxes: near objects one by one, far ones by the moments of their box.

Boxes halve from level to level. A cell meets single objects in the 5 x 5 smallest boxes around its own, and beyond them each box that
isn't within two boxes of its own on that level, but whose parent is on the next. So a cell meets some 75 boxes a level whatever the number of objects, by
equality joins, and no table goes whole to any task. Beyond two box sides a weight 1 / distance**4 is expanded to second order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import GridMeta

#: Side of the smallest boxes, boxes that count as near on either side, and boxes a side that share a task.
LEAF, NEAR, SHARED = 16, 2, 4
SOFT = 0.0001
MOMENTS = [f"{q}{m}" for q in ("s", "u", "v") for m in ("0", "x", "y", "xx", "xy", "yy")]


def _levels(meta: GridMeta) -> int:
    """Levels with boxes that are far from others; above them all boxes are near."""
    side = max(meta.nrows, meta.ncols)
    return max(0, math.ceil(math.log2(side / (LEAF * (NEAR + 1)))))


def _moments(objects: DataFrame, levels: int) -> DataFrame:
    """level, bx, by and the moments of size, size * u and size * v about each box's centre, for boxes that hold objects."""
    at = objects.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = LEAF * F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"bx": F.floor(F.col("cx") / side), "by": F.floor(F.col("cy") / side)})
    x, y = F.col("cx") - (F.col("bx") + 0.5) * side, F.col("cy") - (F.col("by") + 0.5) * side
    power = {"0": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    q = {"s": F.col("size"), "u": F.col("size") * F.col("u"), "v": F.col("size") * F.col("v")}
    return at.groupBy("level", "bx", "by").agg(*(F.sum(q[m[0]] * power[m[1:]]).alias(m) for m in MOMENTS))


def _box_sum(r0: np.ndarray, c0: np.ndarray, m: dict[str, np.ndarray], cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Sums of weights, and of u and v by weight, that boxes with centres cx, cy and these moments give the cells r0, c0."""
    tx, ty = m["sx"] / m["s0"], m["sy"] / m["s0"]  # expand about the centre of size
    x, y = r0[:, None] - (cx + tx), c0[:, None] - (cy + ty)
    r2 = x * x + y * y
    out = []
    for q in "suv":
        z, a, b = m[q + "0"], m[q + "x"], m[q + "y"]
        dx, dy = a - z * tx, b - z * ty
        xx, xy, yy = m[q + "xx"] - 2 * a * tx + z * tx * tx, m[q + "xy"] - a * ty - b * tx + z * tx * ty, m[q + "yy"] - 2 * b * ty + z * ty * ty
        first = 4 * (x * dx + y * dy)
        second = 12 * (x * x * xx + 2 * x * y * xy + y * y * yy) / r2 - 2 * (xx + yy)
        out.append(((z + (first + second) / r2) / (r2 * r2)).sum(1))
    return np.array(out)


def inverse_distance(objects: DataFrame, meta: GridMeta) -> DataFrame:
    """row, col, u, v of every cell: means of the objects' u and v (label, cx, cy, size, u, v), weighted by size / (distance**4 + 0.0001)."""
    spark = objects.sparkSession
    nrows, ncols, levels = meta.nrows, meta.ncols, _levels(meta)
    bx, by = -(-nrows // LEAF), -(-ncols // LEAF)
    leaves = spark.range(bx * by).select(F.expr(f"id div {by}").alias("lx"), (F.col("id") % by).alias("ly"))
    around = lambda c, n: F.explode(F.sequence(F.col(c) - n, F.col(c) + n))
    near = leaves.withColumn("bx", around("lx", NEAR)).withColumn("by", around("ly", NEAR))
    own = objects.select(F.floor(F.col("cx") / LEAF).alias("bx"), F.floor(F.col("cy") / LEAF).alias("by"), F.struct(*(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "size", "u", "v"))).alias("o"))
    # each object goes to the leaves around it; objects of a leaf are as many as lie there
    sources = near.join(own, ["bx", "by"]).select("lx", "ly", F.array(*(F.col(f"o.{c}") for c in ("cx", "cy", "size", "u", "v"))).alias("one"), F.lit(-1).alias("level"))
    if levels:
        k = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
        far = leaves.withColumn("level", k).withColumns({"ax": F.expr("shiftright(lx, level)"), "ay": F.expr("shiftright(ly, level)")})
        reach = lambda c: F.explode(F.sequence(F.shiftright(c, 1) * 2 - 2 * NEAR, F.shiftright(c, 1) * 2 + 2 * NEAR + 1))
        far = far.withColumn("bx", reach("ax")).withColumn("by", reach("ay")).where((F.abs(F.col("bx") - F.col("ax")) > NEAR) | (F.abs(F.col("by") - F.col("ay")) > NEAR))
        side = LEAF * F.pow(F.lit(2.0), F.col("level"))
        boxes = far.join(_moments(objects, levels), ["level", "bx", "by"])
        sources = sources.unionByName(boxes.select("lx", "ly", F.array((F.col("bx") + 0.5) * side, (F.col("by") + 0.5) * side, *MOMENTS).alias("one"), "level"))

    def run(table: pa.Table) -> pa.Table:
        lx, ly, level = (table.column(c).to_numpy() for c in ("lx", "ly", "level"))
        values, offsets = (x := table.column("one").combine_chunks()).values.to_numpy(), x.offsets.to_numpy()
        rows = []
        leaf = lx * by + ly
        order = np.argsort(leaf, kind="stable")
        for i in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            r, c = np.meshgrid(np.arange(lx[i[0]] * LEAF, min(nrows, (lx[i[0]] + 1) * LEAF)), np.arange(ly[i[0]] * LEAF, min(ncols, (ly[i[0]] + 1) * LEAF)), indexing="ij")
            r, c = r.ravel(), c.ravel()
            total = np.zeros((3, len(r)))
            one, box = i[level[i] < 0], i[level[i] >= 0]
            if len(one):
                x, y, size, u, v = values[offsets[one][:, None] + np.arange(5)].T
                w = size / (((r[:, None] - x) ** 2 + (c[:, None] - y) ** 2) ** 2 + SOFT)
                total += np.array([w.sum(1), w @ u, w @ v])
            if len(box):
                x, y, *m = values[offsets[box][:, None] + np.arange(2 + len(MOMENTS))].T
                total += _box_sum(r, c, dict(zip(MOMENTS, m, strict=True)), x, y)
            u, v = (np.floor(t / total[0] + 0.5).astype(np.int32) for t in total[1:])
            rows.append((r.astype(np.int32), c.astype(np.int32), u, v))
        return pa.table(dict(zip(("row", "col", "u", "v"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))

    return sources.groupBy(F.expr(f"lx div {SHARED}"), F.expr(f"ly div {SHARED}")).applyInArrow(run, "row int, col int, u int, v int")
