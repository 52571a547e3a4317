"""Edges by the Laplacian of a Gaussian, banks of oriented ellipses, and vector quantization of several grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround
from gridloom.operators import stencil
from gridloom.operators.tiles import weighted


def log_kernel(h: int) -> stencil.Kernel:
    """Laplacian of a Gaussian of sigma h / 3; its centre makes the sum 0."""
    s2 = (h / 3) ** 2
    side = range(-h, h + 1)
    k = [[(x * x + y * y - s2) / s2**2 * math.exp(-(x * x + y * y) / (2 * s2)) for y in side] for x in side]
    k[h][h] -= sum(map(sum, k))
    return k


def log_edges(g: Grid, h: int, t: int) -> Grid:
    """Half the largest step across opposite neighbours whose responses differ in sign, where it is above t; 0 elsewhere. Missing is -1."""
    n = stencil.neighbours(stencil.convolve(g, log_kernel(h)))
    across = [tuple(F.col(c).cast("long") for c in p) for p in (("n_m_0", "n_p_0"), ("n_0_m", "n_0_p"), ("n_m_m", "n_p_p"), ("n_p_m", "n_m_p"))]
    step = F.floor(F.greatest(*(F.when(a * b < 0, F.abs(a - b)).otherwise(0) for a, b in across)) / 2).cast("int")
    edge = 2 * h + 1
    inner = F.col("row").between(edge, g.meta.nrows - 1 - edge) & F.col("col").between(edge, g.meta.ncols - 1 - edge)
    return Grid(n.select("row", "col", F.when(inner & (step > t), step).otherwise(0).alias("value")), g.meta).map(lambda v: v, missing=-1)


def ellipse_masks(n: int, a: int, b: int) -> list[list[list[bool]]]:
    """n masks turned over half a circle; the origin lies at (a, b) of a square of side 2 max(a, b) + 1."""
    if a == b:
        raise ValueError("an ellipse needs two different half axes")
    side, out = range(2 * max(a, b) + 1), []
    for f in range(n):
        c, s = math.cos(f * math.pi / n), math.sin(f * math.pi / n)
        out.append([[(((i - a) * c - (j - b) * s) / a) ** 2 + (((i - a) * s + (j - b) * c) / b) ** 2 <= 1 for j in side] for i in side])
    return out


def oriented(g: Grid, n: int, a: int, b: int) -> Grid:
    """The largest of the means under n turned ellipses; a tile takes them in turn."""
    masks = [[[float(x) for x in line] for line in m] for m in ellipse_masks(n, a, b)]

    def largest(values, valid):
        best, any_valid = np.full(values.shape, -np.inf), valid.astype(np.int64)
        for m in masks:
            s, w = weighted(values, m), weighted(any_valid, m)
            best = np.maximum(best, np.divide(s, w, out=np.full(values.shape, -np.inf), where=w > 0))
        ok = np.isfinite(best)
        return np.floor(np.where(ok, best, 0) + 0.5), ok

    return stencil._windowed(g, masks[0], largest, g.meta.missing)


def normalised(g: Grid) -> Grid:
    """100 * (v - min) / max of valid values; missing is -1."""
    low, top = g.valid.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return g.map(lambda v: F.lit(-1), missing=-1)
    return g.map(lambda v: F.when(v == g.meta.missing, -1).otherwise(jround(100.0 * (v - low) / F.lit(float(top)))), missing=-1)


def _nearest(params: list[str], missing: list[int], centres: list[list[float]]) -> Column:
    """Number of the nearest centre; parameters that miss don't count, and the first of equals wins."""
    d = []
    for c in centres:
        d.append(sum((F.when(F.col(p) != m, F.pow(F.col(p) - F.lit(float(x)), 2)).otherwise(0.0) for p, m, x in zip(params, missing, c, strict=True)), F.lit(0.0)))
    return F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d))))["i"]


def _stack(grids: list[Grid]) -> DataFrame:
    df = grids[0].df.withColumnRenamed("value", "p0")
    for i, g in enumerate(grids[1:], 1):
        df = df.join(g.df.withColumnRenamed("value", f"p{i}"), ["row", "col"])
    return df


def vector_quantizer(grids: list[Grid], k: int) -> list[list[float]]:
    """Centres of at least k classes: the mean, then every centre split to 1.1 and 0.9 times itself, with one reassignment a split.

    Each split is one aggregation of as many sums as there are centres and parameters. A centre without cells becomes 0.
    """
    df, names, missing = _stack(grids), [f"p{i}" for i in range(len(grids))], [g.meta.missing for g in grids]
    means = [F.coalesce(F.avg(F.when(F.col(p) != m, F.col(p))), F.lit(0.0)).alias(p) for p, m in zip(names, missing, strict=True)]
    centres = [list(df.agg(*means).first())]
    while len(centres) < k:
        centres = [[x * f for x in c] for c in centres for f in (1.1, 0.9)]
        got = {r["i"]: list(r)[1:] for r in df.groupBy(_nearest(names, missing, centres).alias("i")).agg(*means).collect()}
        centres = [got.get(i, [0.0] * len(names)) for i in range(len(centres))]
    return centres


def quantize(grids: list[Grid], centres: list[list[float]]) -> Grid:
    """The number of each cell's class, from 1; 0 is missing."""
    names = [f"p{i}" for i in range(len(grids))]
    of = _nearest(names, [g.meta.missing for g in grids], centres) + 1
    return Grid(_stack(grids).select("row", "col", of.cast("int").alias("value")), grids[0].meta).map(lambda v: v, missing=0)
