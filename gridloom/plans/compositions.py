"""Whole analyses composed of operators: sprawl, metropolitan areas, cities, categories, markets, lines of skeletons, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta, idiv
from gridloom.operators import cells, distance, geometry, mining, models, objects, segment, spectral, stats, stencil
from gridloom.plans.tables import keep


def otsu_of(g: Grid, low: int, incr: int, nbins: int) -> int:
    return stats.otsu(stats.histogram(g, low, incr, nbins)).first()[0]


def prefix_lookup(names: DataFrame, table: DataFrame) -> DataFrame:
    """names (name) with code of table (name, code): by the whole name, else by the first name in order that begins with half of it, else null.

    Each start of a name in the table is a row, and keeps the first name that has it; half names meet these by equality.
    """
    exact = names.join(table, "name", "left")
    half = exact.where("code is null").select("name", F.expr("substring(name, 1, cast(length(name) / 2 as int))").alias("half")).distinct()
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k)))
    first = table.select("name", "code", starts.alias("half")).groupBy("half").agg(F.min_by("code", "name").alias("near"))
    found = half.join(first, "half").select("name", "near")
    return exact.join(found, "name", "left").select("name", F.coalesce("code", "near").alias("code"))


def code_raster(places: Grid, codes: DataFrame) -> Grid:
    """The category (place, code) of each cell's place; cells without one keep their value."""
    df = places.df.join(codes, F.col("value") == F.col("place"), "left")
    return Grid(df.select("row", "col", F.coalesce(F.col("code").cast("int"), F.col("value")).alias("value")), places.meta)


def sprawl(before: Grid, now: Grid, low: int, incr: int, nbins: int, top: int = 20) -> DataFrame:
    """label, row, col, lat, lon and growth (per cent) of the regions of now that grew most and least, top of each.

    Regions come by hysteresis at Otsu's threshold t and 2t. Cells of regions of over 5 cells in both count; a region's last one stands for it.
    """
    t = otsu_of(now, low, incr, nbins)
    a, b = (keep(segment.hysteresis(g, t, 2 * t), "sprawl") for g in (before, now))
    sizes = stats.region_size(a).select("row", "col", F.col("value").alias("s1")).join(stats.region_size(b).select("row", "col", F.col("value").alias("s2")), ["row", "col"]).where("s1 > 5 and s2 > 5")
    growth = sizes.withColumn("growth", idiv(100 * (F.col("s2") - F.col("s1")), F.col("s1"))).join(b.select("row", "col", "label"), ["row", "col"]).where("label > 0")
    one = keep(growth.groupBy("label").agg(F.max(F.struct("row", "col", "growth")).alias("x")).select("label", "x.row", "x.col", "x.growth"), "sprawl")
    ends = one.orderBy(F.desc("growth"), "label").limit(top).unionByName(one.orderBy("growth", "label").limit(top)).distinct()
    lat, lon = now.meta.nw_lat - (F.col("row") + 0.5) * now.meta.lat_res, now.meta.nw_lon + (F.col("col") + 0.5) * now.meta.lon_res
    return ends.withColumns({"lat": lat, "lon": lon})


def metro(g: Grid, low: int, incr: int, nbins: int, most: int) -> Grid:
    """1 where cells lie near bright ones: Otsu, distance, inverted, Otsu of the distances, threshold."""
    far = distance.edt_clamped(g, otsu_of(g, low, incr, nbins), most)
    near = cells.invert(Grid(keep(far.df, "metro"), far.meta), most)
    return cells.threshold(near, otsu_of(near, 0, max(1, most // 50), 50))


def named(r: DataFrame, meta: GridMeta, places: DataFrame, radius: float = 0.5) -> DataFrame:
    """label, lat, lon, size and mean value of regions, and the nearest place (place, plat, plon) within radius degrees of their centres."""
    lat, lon = meta.nw_lat - (F.col("cx") + 0.5) * meta.lat_res, meta.nw_lon + (F.col("cy") + 0.5) * meta.lon_res
    at = r.select(F.col("label").alias("id"), lat.alias("lat"), lon.alias("lon"), "size", "cval")
    return at.join(geometry.nearest(at.select("id", "lat", "lon"), places, radius).select("id", "place"), "id", "left").withColumnRenamed("id", "label")


def cities(g: Grid, t: int, least: int, places: DataFrame, radius: float = 0.5) -> DataFrame:
    """named() with half axes and phi, of regions above t with at least so many cells."""
    r = keep(stats.regions(stats.prune(segment.label(g, t), least)), "cities")
    return named(r, g.meta, places, radius).join(stats.ellipses(r), "label")


def primary_cities(regions: DataFrame, countries: Grid) -> DataFrame:
    """country, label, cval: of the regions whose centre lies in a country, the one with the largest mean; the first on ties."""
    at = regions.select("label", "cval", F.floor("cx").cast("int").alias("row"), F.floor("cy").cast("int").alias("col"))
    of = at.join(countries.df, ["row", "col"]).where(F.col("value") >= 0).select(F.col("value").alias("country"), "label", "cval")
    return of.withColumn("k", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("cval"), "label"))).where("k = 1").drop("k")


def patterns(labels: DataFrame, grids: dict[str, Grid]) -> DataFrame:
    """label and the mean of each grid over the cells of each region, in one aggregation."""
    df = labels.where("label > 0").select("row", "col", "label")
    for name, g in grids.items():
        df = df.join(g.df.withColumnRenamed("value", name), ["row", "col"])
    return df.groupBy("label").agg(*(F.avg(n).alias(n) for n in grids))


def paint(labels: DataFrame, attribute: DataFrame, column: str, like: Grid) -> Grid:
    """A region's attribute (label, column) at its cells; 0 elsewhere."""
    return Grid(labels.join(attribute.select("label", F.col(column).cast("int").alias("__x")), "label", "left").select("row", "col", F.coalesce("__x", F.lit(0)).alias("value")), like.meta)


def city_categories(pop: Grid, light: Grid, labels: DataFrame) -> Grid:
    """At the cells of each region the number, from 1, of the nearest published centre to its mean population and light; 0 elsewhere."""
    p = patterns(labels, {"pop": pop, "light": light})
    # means, deviations and standardised centres as published (fixed values)
    mean, std = [32.6673, 42.5539], [33.05260, 31.75972]
    centres = [[4.0449725, 1.1114502], [-0.2898599, -0.7153647], [0.1143215, 1.0642556]]
    raw = [[c * s + m for c, m, s in zip(centre, mean, std, strict=True)] for centre in centres]
    return paint(labels, p.withColumn("category", mining.nearest_centre([F.col("pop"), F.col("light")], mean, std, raw) + 1), "category", pop)


def market_raster(pop: Grid, light: Grid) -> Grid:
    """The market score of each cell; missing where either grid is."""
    both = pop.df.join(light.df.withColumnRenamed("value", "light"), ["row", "col"])
    gap = (F.col("value") == pop.meta.missing) | (F.col("light") == light.meta.missing)
    return Grid(both.select("row", "col", F.when(gap, pop.meta.missing).otherwise(mining.market(F.col("value").cast("double"), F.col("light").cast("double"))).alias("value")), pop.meta)


def training_patterns(pop: Grid, light: Grid, level: Grid, countries: Grid, labels: DataFrame) -> DataFrame:
    """label, pop, light and gdi (mean level of development) of the primary city of each country."""
    first = primary_cities(stats.regions(labels), countries).select("label").distinct()
    return patterns(labels.join(first, "label", "left_semi"), {"pop": pop, "light": light, "gdi": level})


def write_patterns(p: DataFrame, path: str) -> None:
    """One line of two-decimal numbers, parted by spaces, for each pattern, in order of label."""
    p.orderBy("label").select(F.concat_ws(" ", *(F.format_string("%.2f", F.col(c).cast("double")) for c in p.columns if c != "label")).alias("value")).write.text(path)


def city_models(pop: Grid, light: Grid, labels: DataFrame) -> DataFrame:
    """label, pop, light and what four models make of each region: linear, tree, net, market."""
    p = patterns(labels, {"pop": pop, "light": light})
    a, b = F.col("pop"), F.col("light")
    return p.select("label", "pop", "light", mining.linear_model(a, b).alias("linear"), models.decision_tree(a, b).alias("tree"), models.neural_net(a, b).alias("net"), mining.market(a, b).alias("market"))


def skeleton_lines(g: Grid, t: int, top: int = 20) -> DataFrame:
    """The best lines through the skeleton of the closed and eroded cells above t."""
    bold = stencil.erode(stencil.close(cells.threshold(g, t), 1), 1)
    bold = bold.map(lambda v: F.when(v == g.meta.missing, 0).otherwise(v))
    thin = distance.skeleton(Grid(keep(bold.df, "skeleton"), bold.meta), 0)
    return spectral.hough(thin, 0).orderBy(F.desc("quality"), "theta", "bin").limit(top)


def outlines(g: Grid, low: int, high: int, least: int, rounds: int = 20) -> DataFrame:
    """contour, seq, row, col: active contours that begin as ellipses around the objects by hysteresis, pulled to the grid's edges."""
    labels = keep(stats.prune(segment.hysteresis(g, low, high), least), "outlines")
    r = stats.regions(labels).select("label", "cx", "cy", (F.sqrt(F.col("size") / 3.14159265) + 2).alias("radius"))
    turn = F.col("seq") * 0.3926990817
    node = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("int")
    nodes = r.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(F.col("label").cast("int").alias("contour"), "seq", node(F.col("cx") + F.col("radius") * F.cos(turn), g.meta.nrows).alias("row"), node(F.col("cy") + F.col("radius") * F.sin(turn), g.meta.ncols).alias("col"))
    edge = stencil.sobel(g)
    return objects.snakes(Grid(keep(edge.df, "outlines"), edge.meta), nodes, rounds)
