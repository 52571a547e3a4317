"""Aggregates: scalar statistics, histograms and what follows from them, texture, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, idiv, jround
from gridloom.operators.ranks import ranked

DIRECTIONS = {"EAST": (0, 1), "SOUTH": (1, 0), "NORTHEAST": (-1, 1), "SOUTHEAST": (1, -1)}


def scalar(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value).cast("double")
    return df.agg(F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def weighted(df: DataFrame, value: str, weight: str) -> DataFrame:
    w, v = F.col(weight).cast("double"), F.col(value).cast("double")
    mean = F.sum(w * v) / F.nullif(F.sum(w), F.lit(0.0))
    return df.agg(mean.alias("mean"), (F.sum(w * v * v) / F.nullif(F.sum(w), F.lit(0.0)) - mean * mean).alias("variance"), F.sum(weight).alias("n"))


def histogram(g: Grid, low: int, incr: int, nbins: int) -> DataFrame:
    """bin, lo, hi, n; the last bin has no upper end, values below low and missing ones don't count."""
    b = F.least(idiv(F.col("value") - low, incr), F.lit(nbins - 1)).cast("int")
    n = g.valid.where(F.col("value") >= low).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    bins = g.df.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(n, "bin", "left").select("bin", (low + F.col("bin") * incr).cast("int").alias("lo"), (low + (F.col("bin") + 1) * incr).cast("int").alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def centre(low: int, incr: int, b):
    return low + b * incr + incr // 2


def cdf(hist: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    run = F.sum("n").over(Window.orderBy("bin"))  # one row a bin
    return hist.select("bin", "lo", "hi", F.coalesce(run / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("prob"))


def entropy(hist: DataFrame) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return hist.where("n > 0").select(p.alias("p")).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"))


def otsu(hist: DataFrame) -> DataFrame:
    """threshold: the upper end of the first bin that parts the values with the most variance between the two sides, or the lowest bin's
    lower end where no cut has any."""
    every, run = Window.partitionBy(), Window.orderBy("bin")
    p = hist.select("bin", "hi", F.min("lo").over(every).alias("low"), (F.col("n") / F.sum("n").over(every)).alias("p"))
    p = p.select("bin", "hi", "low", F.sum("p").over(run).alias("w"), F.sum(F.col("p") * F.col("bin")).over(run).alias("m"), F.sum(F.col("p") * F.col("bin")).over(every).alias("t"))
    var = F.when((F.col("w") > 1e-12) & (F.col("w") < 1 - 1e-12), F.pow(F.col("t") * F.col("w") - F.col("m"), 2) / (F.col("w") * (1 - F.col("w")))).otherwise(0.0)
    return p.withColumn("var", F.round(var, 9)).orderBy(F.desc("var"), "bin").limit(1).select(F.when(F.col("var") > 0, F.col("hi")).otherwise(F.col("low")).alias("threshold"))


def bin_choice(g: Grid, how: str) -> DataFrame:
    """low, incr, nbins of a histogram by range, full resolution, stddev or sqrt of the number of cells."""
    s = g.valid.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    span = F.col("high") - F.col("low")
    n = {"range": 1 + jround(F.log2(F.greatest(span, F.lit(1)).cast("double"))), "full": span + 1, "stddev": 1 + jround(3.5 * F.col("sd") / F.pow(F.col("n").cast("double"), F.lit(1 / 3))), "sqrt": 1 + jround(F.sqrt(F.col("n").cast("double")))}[how]
    s = s.withColumn("nbins", n.cast("int"))
    incr = F.lit(1) if how == "full" else F.greatest(F.lit(1), idiv(F.col("high") - F.col("low"), F.col("nbins")))
    return s.select("low", incr.cast("int").alias("incr"), "nbins")


def band(g: Grid, low: int, incr: int, nbins: int) -> Grid:
    """Each valid value becomes its bin's centre; values below low become missing."""
    b = lambda v: F.least(idiv(v - low, incr), F.lit(nbins - 1))
    return g.map_valid(lambda v: F.when(v < low, g.meta.missing).otherwise(centre(low, incr, b(v))))


def quantizer(hist: DataFrame, k: int) -> list[int]:
    """Upper bounds of k bands of about equal count: bins fill a band until it holds n / k, what is left gets the top bound."""
    rows = hist.orderBy("bin").collect()  # one row a bin
    want, have, out = sum(r.n for r in rows) / k, 0, []
    for r in rows:
        have += r.n
        if have >= want and len(out) < k:
            out.append(r.hi)
            have = 0
    return out + [rows[-1].hi] * (k - len(out))


def equal_frequency_band(g: Grid, bounds: list[int]) -> Grid:
    """The number of the first bound above a value; missing beyond the last. Missing values aren't skipped."""
    out = F.lit(g.meta.missing)
    for i in reversed(range(len(bounds))):
        out = F.when(F.col("value") < bounds[i], i).otherwise(out)
    return Grid(g.df.select("row", "col", out.alias("value")), g.meta)


def glcm(g: Grid, low: int, incr: int, nbins: int, direction: str = "EAST") -> DataFrame:
    """b1, b2, p: shares of cells by their bin and that of their neighbour; bin nbins is for missing values and outside."""
    dr, dc = DIRECTIONS[direction]
    b = F.when((F.col("value") == g.meta.missing) | (F.col("value") < low), nbins).otherwise(F.least(idiv(F.col("value") - low, incr), F.lit(nbins - 1))).cast("int")
    own = g.df.select("row", "col", b.alias("b1"))
    other = own.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("b1").alias("b2"))
    n = g.meta.nrows * g.meta.ncols
    return own.join(other, ["row", "col"], "left").groupBy("b1", F.coalesce("b2", F.lit(nbins)).alias("b2")).agg((F.count("*") / n).alias("p"))


def glcm_measures(m: DataFrame, k: int = 2) -> DataFrame:
    """uniformity, entropy (without the minus, so never positive), max_prob and difference moment sum(p**2 / |i - j|**k)."""
    p, d = F.col("p"), F.abs(F.col("b1") - F.col("b2"))
    return m.agg(F.sum(p * p).alias("uniformity"), F.sum(p * F.log2("p")).alias("entropy"), F.max(p).alias("max_prob"), F.coalesce(F.sum(F.when(d > 0, p * p / F.pow(F.greatest(d, F.lit(1)).cast("double"), F.lit(float(k))))), F.lit(0.0)).alias("moment"))


def linearity(g: Grid, transform, inverse, distance: int = 1) -> DataFrame:
    """mse and n of interpolating a transformed value from its two neighbours at a distance, along rows and columns."""
    v, parts = F.when(F.col("value") != g.meta.missing, F.col("value")).cast("double"), []
    for by, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(by).orderBy(along)
        parts.append(g.df.select(v.alias("v"), F.lag(v, distance).over(w).alias("a"), F.lead(v, distance).over(w).alias("b")))
    t = parts[0].unionAll(parts[1]).where("v is not null and a is not null and b is not null")
    e = inverse((transform(F.col("a")) + transform(F.col("b"))) / 2) - F.col("v")
    return t.agg(F.avg(e * e).alias("mse"), F.count("*").alias("n"))


def regions(cells: DataFrame) -> DataFrame:
    """Of cells (label, row, col, value) with label > 0: centre, mean value, size and mean product; missing data counts as it stands."""
    d = lambda c: F.col(c).cast("double")
    return cells.where("label > 0").groupBy("label").agg(F.avg(d("row")).alias("cx"), F.avg(d("col")).alias("cy"), F.avg(d("value")).alias("cval"), F.count("*").alias("size"), F.avg(d("row") * d("col")).alias("cxy"), F.avg(d("row") * d("row")).alias("cxx"), F.avg(d("col") * d("col")).alias("cyy"))


def ellipses(r: DataFrame) -> DataFrame:
    """label, a, b (half axes) and phi (degrees) from the second moments of regions()."""
    s11, s22, s12 = F.col("cxx") - F.col("cx") * F.col("cx"), F.col("cyy") - F.col("cy") * F.col("cy"), F.col("cxy") - F.col("cx") * F.col("cy")
    root = F.sqrt((s11 - s22) * (s11 - s22) + 4 * s12 * s12)
    e1, e2 = (s11 + s22 + root) / 2, (s11 + s22 - root) / 2
    return r.select("label", (2 * F.sqrt(F.greatest(e1, F.lit(0.0)))).alias("a"), (2 * F.sqrt(F.greatest(e2, F.lit(0.0)))).alias("b"), F.degrees(F.atan2(e1 - s11, s12)).alias("phi"))


def aspect(e: DataFrame) -> DataFrame:
    """label and aspect (the shorter half axis by the longer one; 1 for a point) of ellipses()."""
    return e.select("label", F.coalesce(F.try_divide(F.col("b"), F.col("a")), F.lit(1.0)).alias("aspect"))


def in_ellipses(cells: DataFrame, r: DataFrame) -> DataFrame:
    """cells (row, col, ...) with ellipse: the last label of regions() whose fitted ellipse holds the cell, or 0.

    An ellipse goes to the rows and columns of its bounding square only, so cells and ellipses meet by equality.
    """
    e = r.select("label", "cx", "cy").join(ellipses(r), "label").where("a > 0 and b > 0")
    reach = lambda c: F.explode(F.sequence(F.floor(F.col(c) - F.col("a")).cast("int"), F.ceil(F.col(c) + F.col("a")).cast("int")))
    e = e.withColumn("row", reach("cx")).withColumn("col", reach("cy"))
    x, y, turn = F.col("row") - F.col("cx"), F.col("col") - F.col("cy"), F.radians("phi")
    p, q = (x * F.cos(turn) + y * F.sin(turn)) / F.col("a"), (y * F.cos(turn) - x * F.sin(turn)) / F.col("b")
    held = e.where(p * p + q * q < 1).groupBy("row", "col").agg(F.max("label").alias("ellipse"))
    return cells.join(held, ["row", "col"], "left").withColumn("ellipse", F.coalesce("ellipse", F.lit(0)))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """category and n; a null is a category of its own."""
    return df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))


def prune_where(cells: DataFrame, r: DataFrame, keep) -> DataFrame:
    """cells whose regions() meet a condition, numbered 1.. in the old order; others become 0."""
    ids = ranked(r.where(keep).select("label"), "label", "id")
    return cells.join(ids, "label", "left").select("row", "col", "value", F.coalesce("id", F.lit(0)).alias("label"))


def prune(cells: DataFrame, least: int) -> DataFrame:
    """cells with labels of at least so many cells, numbered 1.. in the old order; others become 0."""
    keep = cells.where("label > 0").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ids = ranked(keep.select("label"), "label", "id")
    return cells.join(ids, "label", "left").select("row", "col", "value", F.coalesce("id", F.lit(0)).alias("label"))


def region_size(cells: DataFrame) -> DataFrame:
    sizes = cells.where("label > 0").groupBy("label").agg(F.count("*").alias("size"))
    return cells.join(sizes, "label", "left").select("row", "col", F.coalesce("size", F.lit(0)).cast("int").alias("value"))


def weighted_centroid(g: Grid) -> DataFrame:
    v = F.col("value").cast("double")
    return g.valid.agg((F.sum(F.col("row") * v) / F.sum(v)).alias("cx"), (F.sum(F.col("col") * v) / F.sum(v)).alias("cy"), F.avg(v).alias("weight"))
