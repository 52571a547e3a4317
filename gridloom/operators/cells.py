"""Cell algebra, lookups, orderings and grid-to-grid joins; all of it plain expressions and equi-joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround, spine


def crop(g: Grid, r0: int, c0: int, nrows: int, ncols: int) -> Grid:
    m = g.meta
    df = g.df.where(F.col("row").between(r0, r0 + nrows - 1) & F.col("col").between(c0, c0 + ncols - 1))
    return Grid(df.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "value"), replace(m, nrows=nrows, ncols=ncols, nw_lat=m.nw_lat - r0 * m.lat_res, nw_lon=m.nw_lon + c0 * m.lon_res))


def locations(g: Grid) -> DataFrame:
    """Cells with the latitude and longitude of their centres."""
    m = g.meta
    return g.df.withColumns({"lat": F.lit(m.nw_lat) - (F.col("row") + 0.5) * m.lat_res, "lon": F.lit(m.nw_lon) + (F.col("col") + 0.5) * m.lon_res})


def to_cell(g: Grid, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of a location; cut towards zero, so a point up to a cell outside the north-west edges counts as in."""
    m = g.meta
    return ((F.lit(m.nw_lat) - lat) / m.lat_res).cast("int"), ((lon - m.nw_lon) / m.lon_res).cast("int")


def lookup(g: Grid, points: DataFrame) -> DataFrame:
    """points (lat, lon, ...) with the value of their cell, or missing where they lie outside."""
    r, c = to_cell(g, F.col("lat"), F.col("lon"))
    return points.withColumns({"row": r, "col": c}).join(g.df, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(g.meta.missing)))


def remap(g: Grid, other: Grid) -> Grid:
    """g on the cells of other, by nearest cell."""
    m, o = g.meta, other.meta
    cells = locations(Grid(spine(g.df.sparkSession, o.nrows, o.ncols), o))
    r, c = to_cell(g, F.col("lat"), F.col("lon"))
    hit = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), r.alias("row"), c.alias("col")).join(g.df, ["row", "col"], "left")
    return Grid(hit.select(F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("value", F.lit(m.missing)).alias("value")), replace(o, missing=m.missing))


def bilinear(g: Grid, points: DataFrame) -> DataFrame:
    """points (id, y, x in cells) with the weighted mean of the corners that are there; null if none is."""
    corner = points.withColumn("dy", F.explode(F.array_distinct(F.array(F.floor("y"), F.ceil("y"))))).withColumn("dx", F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x")))))
    corner = corner.select("id", F.col("dy").cast("int").alias("row"), F.col("dx").cast("int").alias("col"), ((1 - F.abs(F.col("y") - F.col("dy"))) * (1 - F.abs(F.col("x") - F.col("dx")))).alias("w"))
    got = corner.join(g.valid, ["row", "col"]).groupBy("id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return points.join(got, "id", "left")


def replace_value(g: Grid, old: int, new: int) -> Grid:
    return g.map(lambda v: F.when(v == old, new).otherwise(v))


def fill(g: Grid, value: int) -> Grid:
    return g.map(lambda v: F.lit(value))


def linear_scale(g: Grid, a: float) -> Grid:
    return g.map_valid(lambda v: jround(v * F.lit(float(a))))


def log_scale(g: Grid, a: float) -> Grid:
    """a * log10(v) where v > 1, else 0."""
    return g.map_valid(lambda v: F.when(v > 1, jround(F.lit(float(a)) * F.log10(v.cast("double")))).otherwise(0))


def threshold(g: Grid, t: int) -> Grid:
    """1 from t up, else 0; missing counts as a number."""
    return g.map(lambda v: (v >= t).cast("int"))


def saturate(g: Grid, low: int, high: int) -> Grid:
    """Into low..high; missing becomes low."""
    return g.map(lambda v: F.when(v == g.meta.missing, low).otherwise(F.least(F.greatest(v, F.lit(low)), F.lit(high))))


def saturate_above(g: Grid, top: int) -> Grid:
    """Valid values above top become top."""
    return g.map_valid(lambda v: F.least(v, F.lit(top)))


def invert(g: Grid, a: int) -> Grid:
    return g.map_valid(lambda v: a - v)


def multiply(g: Grid, k: int) -> Grid:
    return g.map(lambda v: v * k)


def pad(g: Grid, nrows: int, ncols: int) -> Grid:
    return g.filled(g.df, nrows=nrows, ncols=ncols)


def wrap_longitude(g: Grid, n: int) -> Grid:
    """n // 2 columns of each side added at the other."""
    h, w = n // 2, g.meta.ncols
    at = F.filter(F.array(F.col("col"), F.col("col") - w, F.col("col") + w), lambda c: (c >= -h) & (c < w + h))
    return Grid(g.df.select("row", F.explode(at).alias("c"), "value").select("row", (F.col("c") + h).alias("col"), "value"), replace(g.meta, ncols=w + 2 * h, nw_lon=g.meta.nw_lon - h * g.meta.lon_res))


def upsample(g: Grid, f: int) -> Grid:
    k = F.sequence(F.lit(0), F.lit(f - 1))
    df = g.df.withColumn("i", F.explode(k)).withColumn("j", F.explode(k)).select((F.col("row") * f + F.col("i")).alias("row"), (F.col("col") * f + F.col("j")).alias("col"), "value")
    m = g.meta
    return Grid(df, replace(m, nrows=m.nrows * f, ncols=m.ncols * f, lat_res=m.lat_res / f, lon_res=m.lon_res / f))


def decimate(g: Grid, f: int) -> Grid:
    m = g.meta
    df = g.df.where((F.col("row") % f == 0) & (F.col("col") % f == 0)).select((F.col("row") / f).cast("int").alias("row"), (F.col("col") / f).cast("int").alias("col"), "value")
    nr, nc = m.nrows // f, m.ncols // f
    return Grid(df.where((F.col("row") < nr) & (F.col("col") < nc)), replace(m, nrows=nr, ncols=nc, lat_res=m.lat_res * f, lon_res=m.lon_res * f))


def top_n(g: Grid, n: int) -> DataFrame:
    return g.valid.orderBy(F.desc("value"), "row", "col").limit(n)


def top_n_ties(g: Grid, n: int) -> DataFrame:
    """Whole levels from the highest down until there are n cells: a level is in if fewer than n cells lie above it."""
    levels = g.valid.groupBy("value").agg(F.count("*").alias("k")).orderBy(F.desc("value")).limit(n)  # n levels hold n cells at least
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.valid.join(levels.withColumn("above", above).where(F.col("above") < n).select("value"), "value").select("row", "col", "value")


def argmax(g: Grid) -> DataFrame:
    """The first cell of the highest value in raster order."""
    return top_n(g, 1)


def level_set(g: Grid) -> DataFrame:
    return g.valid.groupBy("value").agg(F.count("*").alias("n"))


def add(a: Grid, b: Grid) -> Grid:
    """Sums; missing where either is."""
    if (a.meta.nrows, a.meta.ncols) != (b.meta.nrows, b.meta.ncols):
        raise ValueError("grids differ in size")
    x, y = F.col("value"), F.col("v2")
    df = a.df.join(b.df.withColumnRenamed("value", "v2"), ["row", "col"])
    return Grid(df.select("row", "col", F.when((x == a.meta.missing) | (y == b.meta.missing), a.meta.missing).otherwise(x + y).alias("value")), a.meta)


def difference(a: Grid, b: Grid) -> Grid:
    """a - b; missing counts as a number."""
    return Grid(a.df.join(b.df.withColumnRenamed("value", "v2"), ["row", "col"]).select("row", "col", (F.col("value") - F.col("v2")).alias("value")), a.meta)


def align(g: Grid, u: Column, v: Column, motion: DataFrame | None = None) -> Grid:
    """g moved by (u, v) cells: the value at (row - u, col - v), missing where that lies outside. motion: row, col and what u, v use."""
    cells = g.df.select("row", "col") if motion is None else motion
    want = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") - u).cast("int").alias("row"), (F.col("col") - v).cast("int").alias("col"))
    return Grid(want.join(g.df, ["row", "col"], "left").select(F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("value", F.lit(g.meta.missing)).alias("value")), g.meta)


def aligned_difference(now: Grid, before: Grid, motion: DataFrame, scale: float) -> Grid:
    """now - before at the cell it came from: (row - round(u / scale), col - round(v / scale)), or the same cell where that is outside."""
    want = motion.select("row", "col", (F.col("row") - jround(F.col("u") / F.lit(scale))).alias("r"), (F.col("col") - jround(F.col("v") / F.lit(scale))).alias("c"))
    was = before.df.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("moved"))
    df = now.df.join(want, ["row", "col"]).join(was, ["r", "c"], "left").join(before.df.withColumnRenamed("value", "same"), ["row", "col"])
    return Grid(df.select("row", "col", (F.col("value") - F.coalesce("moved", "same")).alias("value")), now.meta)
