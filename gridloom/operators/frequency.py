"""Operations in the frequency domain on distributed transforms: complex arithmetic, convolution, band-pass and alignment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround, spine
from gridloom.operators.spectral import fft2, padded

Complex = tuple[Column, Column]


def add(a: Complex, b: Complex) -> Complex:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Complex, b: Complex) -> Complex:
    return a[0] - b[0], a[1] - b[1]


def multiply(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: Complex) -> Complex:
    return a[0], -a[1]


def norm2(a: Complex) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def divide(a: Complex, b: Complex) -> Complex:
    """Null where b is 0."""
    x, y = multiply(a, conjugate(b))
    return F.try_divide(x, norm2(b)), F.try_divide(y, norm2(b))


def norm(a: Complex) -> Column:
    return F.sqrt(norm2(a))


def phase(a: Complex) -> Column:
    return F.atan2(a[1], a[0])


def inverse(spectrum: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """row, col, re, im: the inverse transform, as the conjugate of the transform of the conjugate."""
    back = fft2(spectrum.select("row", "col", "re", (-F.col("im")).alias("im")), nrows, ncols)
    n = float(nrows * ncols)
    return back.select("row", "col", (F.col("re") / n).alias("re"), (-F.col("im") / n).alias("im"))


def _real(back: DataFrame, g: Grid) -> Grid:
    inside = (F.col("row") < g.meta.nrows) & (F.col("col") < g.meta.ncols)
    return Grid(back.where(inside).select("row", "col", jround(F.col("re")).alias("value")), g.meta)


def fft_convolve(g: Grid, kernel: list[list[float]]) -> Grid:
    """Correlation with a kernel whose first element lies on the cell; missing values count as numbers and edges wrap around the padded grid."""
    nr, nc = padded(g.meta.nrows), padded(g.meta.ncols)
    spark = g.df.sparkSession
    k = spark.createDataFrame([(i, j, float(w), 0.0) for i, line in enumerate(kernel) for j, w in enumerate(line)], "row int, col int, re double, im double")
    full = spine(spark, nr, nc).join(k, ["row", "col"], "left").select("row", "col", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    a, b = fft2(g).alias("a"), fft2(full, nr, nc).alias("b")
    re, im = multiply((F.col("a.re"), F.col("a.im")), conjugate((F.col("b.re"), F.col("b.im"))))
    return _real(inverse(a.join(b, ["row", "col"]).select("row", "col", re.alias("re"), im.alias("im")), nr, nc), g)


def bandpass(g: Grid, low: float, high: float, mode: str = "reference") -> Grid:
    """The grid without frequencies outside low to high, as shares of a quarter of the diagonal of the padded grid.

    reference cuts the frequency (i, j) of the first quadrant along with (n-1-i, j), (i, m-1-j) and (n-1-i, m-1-i); fixed cuts
    by the frequency's own distance from 0 in all quadrants.
    """
    nr, nc = padded(g.meta.nrows), padded(g.meta.ncols)
    quarter = math.hypot(nr, nc) / 4
    row, col = F.col("row"), F.col("col")

    def outside(i: Column, j: Column) -> Column:
        r = F.sqrt((i * i + j * j).cast("double")) / quarter
        return (r < low) | (r > high)

    if mode == "fixed":
        cut = outside(F.least(row, nr - row), F.least(col, nc - col))
        kept = fft2(g).select("row", "col", *(F.when(cut, 0.0).otherwise(F.col(c)).alias(c) for c in ("re", "im")))
    else:
        own = outside(F.least(row, nr - 1 - row), F.least(col, nc - 1 - col))
        first_three = (row < nr // 2) | (col < nc // 2)
        # the last quadrant loses (n-1-i, m-1-i) for each row i that holds any cut frequency
        i = nr - 1 - row
        any_cut = (F.sqrt((i * i).cast("double")) / quarter < low) | (F.sqrt((i * i + (nc // 2 - 1) ** 2).cast("double")) / quarter > high)
        cut = F.when(first_three, own).otherwise((nc - 1 - col == i) & any_cut)
        cut = cut | ((row >= nr // 2) & (nc - 1 - col == i) & any_cut)
        kept = fft2(g).select("row", "col", *(F.when(cut, 0.0).otherwise(F.col(c)).alias(c) for c in ("re", "im")))
    return _real(inverse(kept, nr, nc), g)
