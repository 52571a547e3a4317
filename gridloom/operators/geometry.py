"""Map projection, polygons, lines and splines, nearest points, and interpolation of points to a grid."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta, jround, spine
from gridloom.operators.cells import locations, to_cell

#: Semi-major axis in metres and squared eccentricity (fixed values).
WGS84 = (6378137.0, 0.00669437999013)
NAD27 = (6378206.4, 0.006768658)


@dataclass(frozen=True)
class Lambert:
    """Lambert conformal conic with two standard parallels."""

    lat0: float
    lon0: float
    lat1: float
    lat2: float
    ellipsoid: tuple[float, float] = WGS84
    northing: float = 0.0
    easting: float = 0.0

    def _m(self, x: float) -> float:
        return math.cos(x) / math.sqrt(1 - self.ellipsoid[1] * math.sin(x) ** 2)

    def _t(self, x: float) -> float:
        e = math.sqrt(self.ellipsoid[1])
        return math.tan(math.pi / 4 - x / 2) / ((1 - e * math.sin(x)) / (1 + e * math.sin(x))) ** (e / 2)

    @property
    def constants(self) -> tuple[float, float, float]:
        a, b, o = (math.radians(x) for x in (self.lat1, self.lat2, self.lat0))
        n = math.sin(a) if a == b else (math.log(self._m(a)) - math.log(self._m(b))) / (math.log(self._t(a)) - math.log(self._t(b)))
        f = self._m(a) / (n * self._t(a) ** n)
        return n, f, self.ellipsoid[0] * f * self._t(o) ** n

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Northing and easting in metres."""
        n, f, r0 = self.constants
        e, x = math.sqrt(self.ellipsoid[1]), F.radians(lat)
        t = F.tan(F.lit(math.pi / 4) - x / 2) / F.pow((1 - e * F.sin(x)) / (1 + e * F.sin(x)), F.lit(e / 2))
        r, theta = self.ellipsoid[0] * f * F.pow(t, F.lit(n)), n * (F.radians(lon) - math.radians(self.lon0))
        return self.northing + r0 - r * F.cos(theta), self.easting + r * F.sin(theta)

    def inverse(self, north: Column, east: Column) -> tuple[Column, Column]:
        """Latitude and longitude, by five fixed-point steps."""
        n, f, r0 = self.constants
        e = math.sqrt(self.ellipsoid[1])
        dy, dx = r0 - (north - self.northing), east - self.easting
        r = math.copysign(1, n) * F.sqrt(dx * dx + dy * dy)
        t = F.pow(r / (self.ellipsoid[0] * f), F.lit(1 / n))
        x = F.lit(math.pi / 2) - 2 * F.atan(t)
        for _ in range(5):
            x = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - e * F.sin(x)) / (1 + e * F.sin(x)), F.lit(e / 2)))
        return F.degrees(x), F.degrees(F.atan2(dx, dy) / n) + self.lon0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, ellipsoid=WGS84) -> Column:
    """Great-circle distance with a radius of curvature taken at the mean latitude (with its sine where the formula has the sine's square)."""
    a, e2 = ellipsoid
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    s = 1 - e2 * F.sin((p1 + p2) / 2)
    return a * (1 - e2) / F.pow(s * s, F.lit(1.5)) / 1000 * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def edges(vertices: DataFrame) -> DataFrame:
    """(poly, y0, x0, y1, x1) of closed rings from (poly, seq, lat, lon)."""
    w = Window.partitionBy("poly").orderBy("seq")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select("poly", F.col("lat").alias("y0"), F.col("lon").alias("x0"), F.coalesce(F.lead("lat").over(w), F.first("lat").over(first)).alias("y1"), F.coalesce(F.lead("lon").over(w), F.first("lon").over(first)).alias("x1"))


def area(vertices: DataFrame) -> DataFrame:
    """poly, area (square degrees) and centroid, by the shoelace formula."""
    c = F.expr("x0 * y1 - x1 * y0")
    s = edges(vertices).groupBy("poly").agg((F.sum(c) / 2).alias("a"), F.sum((F.col("y0") + F.col("y1")) * c).alias("y"), F.sum((F.col("x0") + F.col("x1")) * c).alias("x"))
    return s.select("poly", F.abs("a").alias("area"), (F.col("y") / (6 * F.col("a"))).alias("lat"), (F.col("x") / (6 * F.col("a"))).alias("lon"))


def point_in_polygon(points: DataFrame, vertices: DataFrame, most: int = 100_000) -> DataFrame:
    """points (id, lat, lon, ...) with poly: the smallest polygon that holds them, by its box and then odd crossings in both directions; -1 if none.

    Polygons are broadcast up to a number of edges; beyond it points and boxes meet by whole degrees of latitude.
    """
    e = edges(vertices)
    box = vertices.groupBy("poly").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    inside = F.expr("lat between s and n and lon between w and e")
    if e.count() <= most:
        near = points.join(F.broadcast(box), inside)
    else:
        rows = box.withColumn("deg", F.explode(F.sequence(F.floor("s"), F.floor("n"))))
        near = points.withColumn("deg", F.floor("lat")).join(rows, "deg").where(inside)
    c = near.select("id", "lat", "lon", "poly").join(e, "poly")
    above = F.expr("(y0 > lat) <> (y1 > lat)") & (F.col("lon") < F.col("x0") + F.expr("try_divide((lat - y0) * (x1 - x0), y1 - y0)"))
    beside = F.expr("(x0 > lon) <> (x1 > lon)") & (F.col("lat") < F.col("y0") + F.expr("try_divide((lon - x0) * (y1 - y0), x1 - x0)"))
    odd = c.groupBy("id", "poly").agg((F.count_if(above) % 2).alias("a"), (F.count_if(beside) % 2).alias("b")).where("a = 1 and b = 1")
    return points.join(odd.groupBy("id").agg(F.min("poly").alias("poly")), "id", "left").withColumn("poly", F.coalesce("poly", F.lit(-1)))


#: The fullest cell of a search's first round holds at most so many distinct positions.
CROWD = 64


def _crowd_free(sites: DataFrame, size: float) -> float:
    """size, or a fraction of it at which no cell holds more than CROWD of the distinct positions (plat, plon), down to 1e-6."""
    while size > 1e-6:
        n = sites.groupBy(F.floor(F.col("plat") / size), F.floor(F.col("plon") / size)).count().agg(F.max("count")).first()[0] or 0
        if n <= CROWD:
            break
        size /= 2 ** math.ceil(math.log2(n / CROWD) / 2)
    return size


def _meet(spots: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """Pairs of spots (lat, lon, ...) and sites (plat, plon, ...) up to size apart, and some farther ones, with their squared distance d: a site lies in nine cells."""
    cell = lambda c: F.floor(F.col(c) / (size * (1 + 1e-6)))
    step = F.sequence(F.lit(-1), F.lit(1))
    around = sites.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).select(*sites.columns, (cell("plat") + F.col("i")).alias("ci"), (cell("plon") + F.col("j")).alias("cj"))
    d = F.pow(F.col("lat") - F.col("plat"), 2) + F.pow(F.col("lon") - F.col("plon"), 2)
    return spots.withColumns({"ci": cell("lat"), "cj": cell("lon")}).join(around, ["ci", "cj"]).withColumn("d", d)


def _closest(spots: DataFrame, sites: DataFrame, size: float, most: float, fits: str) -> DataFrame:
    """lat, lon, d and place of the closest site (plat, plon, place, ...) that fits each of the distinct spots (lat, lon, ...) nearer than most.

    Cells begin so small that none is crowded, and widen fourfold for spots without a site within a cell's size. Spots that are far from
    a dense cluster of distinct positions still meet all of it.
    """
    from gridloom.plans.tables import keep

    size, found = _crowd_free(sites, size), None
    while True:
        size = min(size, most)
        best = _meet(spots, sites, size).where(F.expr(fits) & (F.col("d") < size * size)).groupBy("lat", "lon").agg(F.min(F.struct("d", "place")).alias("b")).select("lat", "lon", "b.*")
        got = best if size == most else keep(best, "nearest")
        found = got if found is None else found.unionAll(got)
        if size == most:
            return found
        spots = spots.join(got, ["lat", "lon"], "left_anti")
        if not spots.limit(1).count():
            return found
        size *= 4


def nearest(points: DataFrame, places: DataFrame, radius: float = 0.5) -> DataFrame:
    """points (id, lat, lon) with place: the nearest of places (place, plat, plon) within radius degrees, the smallest on ties; null if none.

    Points of one position are searched for once, and places of one position count as the smallest of them, so there is no product of the two.
    """
    from gridloom.plans.tables import keep

    sites = keep(places.where("plat is not null and plon is not null").groupBy("plat", "plon").agg(F.min("place").alias("place")), "nearest")
    spots = keep(points.where("lat is not null and lon is not null").select("lat", "lon").distinct(), "nearest")
    return points.join(_closest(spots, sites, radius, radius, "true").drop("d"), ["lat", "lon"], "left").select(*points.columns, "place")


def mean_neighbour_distance(points: DataFrame) -> DataFrame:
    """Mean distance, in degrees, of points to their nearest other point (of another id), and the number of points that have one.

    Where two ids share a position it is 0; only points alone at theirs are searched for, among positions, in cells that widen until each has a
    neighbour. Points that a round leaves have none within a quarter of a cell, so a cell holds few of them, however many positions it has.
    """
    from gridloom.plans.tables import keep

    own = points.select("id", "lat", "lon").where("id is not null and lat is not null and lon is not null")
    sites = keep(own.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min("id").alias("place"), F.max("id").alias("last")), "nearest")
    spans = sites.agg(F.max("plat") - F.min("plat"), F.max("plon") - F.min("plon")).first()
    at = sites.select(F.col("plat").alias("lat"), F.col("plon").alias("lon"), F.col("place").alias("id"), "last")
    alone = _closest(at.where("id = last").select("lat", "lon", "id"), sites, 1.0, max(1.0, 1.5 * max(x or 0 for x in spans)), "place <> id or last <> id")
    d = at.where("id <> last").select("lat", "lon", F.lit(0.0).alias("d")).unionAll(alone.select("lat", "lon", F.sqrt("d").alias("d")))
    return own.join(d, ["lat", "lon"]).groupBy("id").agg(F.min("d").alias("d")).agg(F.avg("d").alias("mean"), F.count("*").alias("n"))


def cressman(radius: float) -> Callable[[Column], Column]:
    """Weight by squared distance: (1 - q) / (1 + q), null beyond the radius."""
    return lambda d2: F.when(d2 <= radius * radius, (1 - d2 / radius**2) / (1 + d2 / radius**2))


def gaussian(sigma: float) -> Callable[[Column], Column]:
    return lambda d2: F.when(d2 < 18 * sigma * sigma, F.exp(-d2 / (2 * sigma * sigma)))


def interpolate(points: DataFrame, meta: GridMeta, weight: Callable[[Column], Column], reach: float, least: int = 1) -> Grid:
    """Weighted average of points (lat, lon, value) at each cell centre; missing with fewer than least points of positive weight.

    Each point is scattered to the cells within reach degrees of it, and one aggregation gathers them.
    """
    n = int(math.ceil(reach / min(meta.lat_res, meta.lon_res))) + 1
    r, c = to_cell(Grid(points, meta), F.col("lat"), F.col("lon"))
    step = F.sequence(F.lit(-n), F.lit(n))
    e = points.withColumns({"r": r, "c": c}).withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    e = e.select("lat", "lon", "value", (F.col("r") + F.col("i")).alias("row"), (F.col("c") + F.col("j")).alias("col"))
    e = e.where(F.col("row").between(0, meta.nrows - 1) & F.col("col").between(0, meta.ncols - 1))
    y, x = F.lit(meta.nw_lat) - (F.col("row") + 0.5) * meta.lat_res, F.lit(meta.nw_lon) + (F.col("col") + 0.5) * meta.lon_res
    w = weight((y - F.col("lat")) * (y - F.col("lat")) + (x - F.col("lon")) * (x - F.col("lon")))
    s = e.withColumn("w", w).where("w > 0").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    return Grid(points, meta).filled(s.where(F.col("n") >= least).select("row", "col", jround(F.col("s") / F.col("w")).alias("value")))


def bounding_grid(points: DataFrame, lat_res: float, lon_res: float, missing: int = -9999) -> GridMeta:
    """The shape and place of a grid that holds all points (lat, lon), a cell beyond them on each side, with edges at multiples of the cell."""
    s, n, w, e = points.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if s is None:
        raise ValueError("there are no points")
    near = lambda x, d: math.floor(x / d + 0.5) * d
    s, n, w, e = near(s - lat_res, lat_res), near(n + lat_res, lat_res), near(w - lon_res, lon_res), near(e + lon_res, lon_res)
    return GridMeta(math.floor((n - s) / lat_res + 0.5), math.floor((e - w) / lon_res + 0.5), missing, n, w, lat_res, lon_res)


def scatter(points: DataFrame, meta: GridMeta, weight: Callable[[Column], Column], reach: float, least: int = 1) -> Grid:
    """As interpolate(), but with the weights of a kernel that is centred on the cell of each point, not on the point itself."""
    nr, nc = (int(math.ceil(reach / x)) for x in (meta.lat_res, meta.lon_res))
    r, c = to_cell(Grid(points, meta), F.col("lat"), F.col("lon"))
    cells = points.where(F.col("value") != meta.missing).select(r.alias("r"), c.alias("c"), F.col("value").cast("double").alias("value")).groupBy("r", "c").agg(F.sum("value").alias("value"), F.count("*").alias("k"))
    e = cells.withColumn("i", F.explode(F.sequence(F.lit(-nr), F.lit(nr)))).withColumn("j", F.explode(F.sequence(F.lit(-nc), F.lit(nc))))
    y, x = F.col("i") * meta.lat_res, F.col("j") * meta.lon_res
    e = e.select((F.col("r") + F.col("i")).alias("row"), (F.col("c") + F.col("j")).alias("col"), "value", "k", weight(y * y + x * x).alias("w")).where("w > 0")
    s = e.where(F.col("row").between(0, meta.nrows - 1) & F.col("col").between(0, meta.ncols - 1)).groupBy("row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(F.col("w") * F.col("k")).alias("w"), F.sum("k").alias("n"))
    return Grid(points, meta).filled(s.where(F.col("n") >= least).select("row", "col", jround(F.col("s") / F.col("w")).alias("value")))


def interpolate_passes(points: DataFrame, meta: GridMeta, weight, reach: float, passes: int = 2, least: int = 1) -> Grid:
    """Further passes analyse the residuals at the points and add them, within the range of the first."""
    from gridloom.operators.cells import lookup
    from gridloom.plans.tables import keep

    g = interpolate(points, meta, weight, reach, least)
    low, high = points.agg(F.min("value"), F.max("value")).first()
    for _ in range(passes - 1):
        g = Grid(keep(g.df, "oban"), meta)
        at = lookup(g, points.withColumnRenamed("value", "seen")).where(F.col("value") != meta.missing).select("lat", "lon", (F.col("seen") - F.col("value")).alias("value"))
        more = interpolate(at, meta, weight, reach, least).df.withColumnRenamed("value", "more")
        v = F.when((F.col("value") == meta.missing) | (F.col("more") == meta.missing), F.col("value")).otherwise(F.least(F.greatest(F.col("value") + F.col("more"), F.lit(low)), F.lit(high)))
        g = Grid(g.df.join(more, ["row", "col"]).select("row", "col", v.alias("value")), meta)
    return g


def line_cells(lines: DataFrame) -> DataFrame:
    """Distinct (row, col) of segments (r0, c0, r1, c1), stepping along the longer side with a rounded slope."""
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))
    e = lines.select("*", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    step = lambda a, b: F.col(a) + jround(F.coalesce(F.try_divide((F.col(b) - F.col(a)) * F.col("k").cast("double"), F.col("n")), F.lit(0.0)))
    return e.select(step("r0", "r1").alias("row"), step("c0", "c1").alias("col")).distinct()


def catmull_rom(knots: DataFrame, at: DataFrame) -> DataFrame:
    """at (x) with y of the spline through knots (x, y), ends clamped; outside the knots nothing. Knots at one x are averaged.

    Intervals and positions meet in cells of the mean interval's width, so there are at most twice as many cells as knots.
    """
    k = knots.groupBy("x").agg(F.avg("y").alias("y"))
    low, top, n = k.agg(F.min("x"), F.max("x"), F.count("*")).first()
    width = (top - low) / (n - 1) if n > 1 else 1.0
    w = Window.orderBy("x")  # the knots of one curve
    k = k.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.lag("y").over(w).alias("p0"), F.lead("y", 2).over(w).alias("p3")).where("x2 is not null")
    cell = lambda c: F.floor((F.col(c) - F.lit(low)) / width)
    k = k.withColumn("cell", F.explode(F.sequence(cell("x1"), cell("x2"))))
    t = (F.col("x") - F.col("x1")) / (F.col("x2") - F.col("x1"))
    p0, p1, p2, p3 = F.coalesce("p0", "y1"), F.col("y1"), F.col("y2"), F.coalesce("p3", "y2")
    y = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)
    inside = (F.col("x") >= F.col("x1")) & ((F.col("x") < F.col("x2")) | ((F.col("x") == F.col("x2")) & (F.col("x2") == F.lit(top))))
    return at.withColumn("cell", cell("x")).join(k, "cell").where(inside).select("x", y.alias("y"))


def spline_raster(g: Grid, control: DataFrame, value: int = 1) -> Grid:
    """g with value at the cells of the Catmull-Rom curve through control (seq, lat, lon), sampled at each column between its ends."""
    m = g.meta
    ends = control.agg(F.min("lon"), F.max("lon")).first()
    cols = [int((x - m.nw_lon) / m.lon_res) for x in ends]
    at = control.sparkSession.range(max(0, cols[0]), min(m.ncols - 1, cols[1]) + 1).select((F.lit(m.nw_lon) + (F.col("id") + 0.5) * m.lon_res).alias("x"))
    curve = catmull_rom(control.select(F.col("lon").alias("x"), F.col("lat").alias("y")), at)
    r, c = to_cell(g, F.col("y"), F.col("x"))
    on = curve.select(r.alias("row"), c.alias("col")).distinct().withColumn("on", F.lit(True))
    return Grid(g.df.join(on, ["row", "col"], "left").select("row", "col", F.when(F.col("on"), value).otherwise(F.col("value")).alias("value")), m)


def polygon_raster(meta: GridMeta, vertices: DataFrame) -> Grid:
    """The first polygon that holds each cell's centre, or -1."""
    cells = locations(Grid(spine(vertices.sparkSession, meta.nrows, meta.ncols), meta)).withColumn("id", F.col("row").cast("long") * meta.ncols + F.col("col"))
    return Grid(point_in_polygon(cells, vertices).select("row", "col", F.col("poly").cast("int").alias("value")), meta)
