"""Fourier transforms, convolution and correlation through them, and Hough lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround


def padded(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def fft2(g: Grid | DataFrame, nrows: int = 0, ncols: int = 0) -> DataFrame:
    """row, col, re, im of the transform: one pass by rows, a shuffle, one by columns. Sizes are powers of two at least as large as given.

    g: a grid, padded with 0, or the cells (row, col, re, im) of a complex one of nrows by ncols.
    """
    if isinstance(g, Grid):
        nrows, ncols = nrows or g.meta.nrows, ncols or g.meta.ncols
        g = g.df.select("row", "col", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    nr, nc = padded(nrows), padded(ncols)

    def one(key: str, along: str, n: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros(n, complex)
            x[pdf[along]] = pdf["re"].to_numpy(float) + 1j * pdf["im"].to_numpy(float)  # a null becomes no number, and so does what it enters
            x = np.fft.fft(x)
            return pd.DataFrame({key: pdf[key].iloc[0], along: np.arange(n), "re": x.real, "im": x.imag})[["row", "col", "re", "im"]]

        return run

    schema = "row int, col int, re double, im double"
    return g.groupBy("row").applyInPandas(one("row", "col", nc), schema).groupBy("col").applyInPandas(one("col", "row", nr), schema)


def hough(g: Grid, t: int, dtheta: int = 20, drho: int = 10) -> DataFrame:
    """theta (degrees), bin, rho, votes, r0, c0, r1, c1 and quality of lines through cells above t.

    A cell votes at each angle for the bin nearest to its distance, if that isn't negative. rho is that of the line's last cell in raster
    order; quality is votes**2 / length, rounded, and 0 with one vote.
    """
    hot = g.df.where(F.col("value") > t).withColumn("theta", F.explode(F.array(*(F.lit(a) for a in range(0, 360, dtheta)))))
    angle = F.radians(F.col("theta").cast("double"))
    v = hot.withColumn("rho", F.round(F.col("row") * F.cos(angle) + F.col("col") * F.sin(angle), 9)).withColumn("bin", jround(F.col("rho") / drho)).where("bin >= 0")
    s = v.groupBy("theta", "bin").agg(F.max_by("rho", F.struct("row", "col")).alias("rho"), F.count("*").alias("votes"), F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    return s.withColumn("quality", F.when(F.col("votes") > 1, jround(F.col("votes") * F.col("votes") / F.sqrt((dr * dr + dc * dc).cast("double")))).otherwise(0))


def line_pixels(lines: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """theta, bin, row, col: cells of lines of hough() with at least two votes, stepping along the longer side (rows only if it is longer)."""
    angle = F.radians(F.col("theta").cast("double"))
    by_row = (F.col("r1") - F.col("r0")) > (F.col("c1") - F.col("c0"))
    step = F.explode(F.when(by_row, F.sequence("r0", "r1")).otherwise(F.sequence("c0", "c1")))
    k = lines.where("votes > 1").withColumn("by_row", by_row).withColumn("k", step)
    other = F.when(F.col("by_row"), F.try_divide(F.col("rho") - F.col("k") * F.cos(angle), F.sin(angle))).otherwise(F.try_divide(F.col("rho") - F.col("k") * F.sin(angle), F.cos(angle)))
    k = k.withColumn("other", F.floor(F.round(other, 6) + 0.5))
    row, col = F.when(F.col("by_row"), F.col("k")).otherwise(F.col("other")), F.when(F.col("by_row"), F.col("other")).otherwise(F.col("k"))
    inside = F.when(F.col("by_row"), F.col("other").between(0, ncols - 1)).otherwise(F.col("other").between(0, nrows - 1))
    return k.where(inside).select("theta", "bin", row.cast("int").alias("row"), col.cast("int").alias("col"))


def phase_correlation(before: Grid, now: Grid, max_u: int, max_v: int) -> DataFrame:
    """u, v: the one shift that takes the frame before to now, from the whitened cross power of both.

    Cells of now in a border of max_u rows and max_v columns count as 0 (at the far side one less), and the whole inverse transform is searched: its
    largest squared modulus wins, the first by rows of the shift back on ties (to 9 digits). A shift beyond half the padded size is
    one the other way. A spectrum with a zero in it says nothing, which gives (0, 0). Transforms and the product of spectra are DataFrames.
    Departure from the published code: that compares a squared modulus with the real part of the best so far, so what it finds hangs on the order of cells.
    """
    m = now.meta
    inside = F.col("row").between(max_u, m.nrows - max_u) & F.col("col").between(max_v, m.ncols - max_v)
    middle = Grid(now.df.select("row", "col", F.when(inside, F.col("value")).otherwise(0).alias("value")), m)
    a, b = (fft2(g).select("row", "col", F.col("re").alias(f"re{k}"), F.col("im").alias(f"im{k}")) for k, g in enumerate((before, middle)))
    re, im = F.expr("re0 * re1 + im0 * im1"), F.expr("re0 * im1 - im0 * re1")
    size = F.sqrt(re * re + im * im)
    nr, nc = padded(m.nrows), padded(m.ncols)
    # the inverse transform is the transform of the conjugate, conjugated and divided by the number of cells
    x = fft2(a.join(b, ["row", "col"]).select("row", "col", F.try_divide(re, size).alias("re"), F.try_divide(-im, size).alias("im")), nr, nc)
    u, v = F.expr(f"if(row >= {-(-nr // 2)} and row > 0, row - {nr}, row)"), F.expr(f"if(col >= {-(-nc // 2)} and col > 0, col - {nc}, col)")
    back = F.struct(F.expr(f"({nr} - row) % {nr}"), F.expr(f"({nc} - col) % {nc}"))
    power = F.round((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (nr * nc) ** 2, 9)
    found = x.select(u.alias("u"), v.alias("v"), back.alias("back"), F.when(~F.isnan(power), power).alias("c"))
    best = found.where("c is not null").agg(F.min_by(F.struct("u", "v"), F.struct(-F.col("c"), "back")).alias("b"))
    return best.select(F.coalesce("b.u", F.lit(0)).cast("int").alias("u"), F.coalesce("b.v", F.lit(0)).cast("int").alias("v"))
