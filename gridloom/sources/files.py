"""Readers and writers of grids and points as text; files go through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta
from gridloom.sources import esri


def read_esri(spark: SparkSession, path: str, scale=lambda v: v) -> Grid:
    """An ESRI ASCII grid, gzip or plain, through the data source of sources/esri, which cuts plain files into ranges.

    scale: a function of the value's column; the result is rounded half up. The header's no-data text is missing. A folder holds one grid.
    """
    esri.register(spark)
    found = esri.grids_at(path)
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} grids; read_esri_all() reads several")
    meta, _ = esri.header(found[0])
    cells = spark.read.format("esri").load(found[0])
    return Grid(cells.select("row", "col", _scaled(F.col("value"), scale, meta.missing)), meta)


def read_esri_all(spark: SparkSession, path: str, pattern: str | None = None, scale=lambda v: v) -> tuple[DataFrame, dict[str, GridMeta]]:
    """(grid, row, col, value) of every grid of a folder whose name matches pattern, and their shapes; grid is the file's path."""
    esri.register(spark)
    metas = {x: esri.header(x)[0] for x in esri.grids_at(path, pattern)}
    read = spark.read.format("esri")
    cells = (read.option("pathGlobFilter", pattern) if pattern else read).load(path)
    missing = F.create_map(*(F.lit(x) for k, m in metas.items() for x in (k, m.missing))) if metas else F.create_map()
    return cells.select("grid", "row", "col", _scaled(F.col("value"), scale, F.try_element_at(missing, F.col("grid")) if metas else F.lit(None))), metas


def _scaled(v, scale, missing):
    return F.when(v.isNull(), missing).otherwise(F.floor(scale(v) + 0.5)).cast("int").alias("value")


def population(spark: SparkSession, path: str, log: bool = False) -> Grid:
    """People per area in thousandths; with log 100 * log10(v), 0 up to 1."""
    return read_esri(spark, path, (lambda v: F.when(v > 1, 100 * F.log10(v)).otherwise(0.0)) if log else (lambda v: v * 0.001))


def night_lights(spark: SparkSession, path: str) -> Grid:
    """Lights from 0 to 63, brought to 0 to 100."""
    return read_esri(spark, path, lambda v: v * (100 / 63.0))


def write_esri(g: Grid, path: str) -> None:
    """One gzip file, grid.asc.gz, in a folder: the header, then a line for each row. Tasks write ranges of rows, which are joined at the end."""
    esri.register(g.df.sparkSession)
    m = g.meta
    rows = g.df.select(*(F.col(c).cast("int").alias(c) for c in ("row", "col", "value"))).repartitionByRange("row").sortWithinPartitions("row", "col")
    options = {"nrows": m.nrows, "ncols": m.ncols, "missing": m.missing, "nw_lat": m.nw_lat, "nw_lon": m.nw_lon, "lat_res": m.lat_res}
    rows.write.format("esri").options(**options).mode("append").save(path)


def read_numbers(spark: SparkSession, path: str, names: list[str], header: bool = False) -> DataFrame:
    """A table of numbers between white space, the first len(names) of every line; with header, lines that aren't numbers are left out."""
    f = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(f.alias("f"))
    at = [F.get("f", F.lit(i)) for i in range(len(names))]
    rows = rows.select(*((x.try_cast("double") if header else x.cast("double")).alias(n) for x, n in zip(at, names, strict=True)))
    return rows.where(F.col(names[0]).isNotNull()) if header else rows


def write_numbers(df: DataFrame, path: str, order: list[str]) -> None:
    """The columns of df between spaces, a line for each row, in parts that follow each other in that order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.text(path)


def write_assignment(cost: DataFrame, chosen: DataFrame, path: str, columns: int, top: int = 10000) -> None:
    """A matrix of costs (i, j, cost; top where there is none) as lines of text, j from 1 to columns; chosen (i, j) bear a star."""
    cells = cost.select("i", F.explode(F.sequence(F.lit(1), F.lit(columns))).alias("j")).distinct().join(cost, ["i", "j"], "left").join(chosen.select("i", "j", F.lit("*").alias("star")), ["i", "j"], "left")
    text = F.concat(F.coalesce(F.col("cost").cast("long"), F.lit(top)).cast("string"), F.coalesce("star", F.lit("")))
    rows = cells.groupBy("i").agg(F.concat_ws("  & ", F.transform(F.array_sort(F.collect_list(F.struct("j", text.alias("t")))), lambda x: x["t"])).alias("line"))
    rows.repartitionByRange("i").sortWithinPartitions("i").select(F.concat("line", F.lit(r" \\")).alias("value")).write.text(path)


def read_points(spark: SparkSession, path: str, scale: float, missing: int) -> DataFrame:
    """station, date, time, lat, lon, value of a white-space table with a header; values are scaled and rounded."""
    f = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.size(f) >= 6).select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("station", "date", "time", "v", "lat", "lon"))))
    rows = rows.where(F.expr("try_cast(v as double) is not null"))
    return rows.select("station", "date", "time", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce(F.floor(F.col("v").cast("double") * scale + 0.5).cast("int"), F.lit(missing)).alias("value"))


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("zip string, lat double, lon double, city string, state string, county string").csv(path).where("lat is not null and county is not null")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """name, category, code from a CSV whose first and fourth columns hold them; aggregates and empty ones are left out."""
    codes = ["Low income", "Lower middle income", "Upper middle income", "High income: nonOECD", "High income: OECD"]
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(F.col(rows.columns[0]).alias("name"), F.col(rows.columns[3]).alias("category")).where("category is not null and category not in ('', 'Aggregates')")
    return rows.withColumn("code", F.array_position(F.array(*map(F.lit, codes)), F.col("category")).cast("int"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """poly, ring, seq, name, lat, lon of the rings of each Placemark, by regular expressions over whole files."""
    marks = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit("(?s)<Placemark.*?</Placemark>"), 0)).alias("poly", "mark"))
    rings = marks.select("poly", F.regexp_extract("mark", "(?s)<name>(.*?)</name>", 1).alias("name"), F.posexplode(F.regexp_extract_all("mark", F.lit("(?s)<LinearRing>.*?<coordinates>(.*?)</coordinates>"), 1)).alias("ring", "c"))
    at = rings.select("poly", "name", "ring", F.posexplode(F.split(F.trim("c"), "\\s+")).alias("seq", "p"))
    xy = F.split("p", ",")
    return at.select("poly", "ring", "seq", "name", F.get(xy, F.lit(1)).cast("double").alias("lat"), F.get(xy, F.lit(0)).cast("double").alias("lon"))


def kml_placemarks(points: DataFrame) -> str:
    """A KML document of (name, lat, lon); for small results."""
    marks = "".join(f"<Placemark><name>{r.name}</name><Point><coordinates>{r.lon},{r.lat},0.</coordinates></Point></Placemark>" for r in points.toLocalIterator())
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>'


def colour_index(g: Grid, low: int, high: int) -> DataFrame:
    """row, col and palette index: 0 for missing and below low, 255 from high up, between them in proportion."""
    v = F.col("value")
    i = F.when((v == g.meta.missing) | (v < low), 0).when(v >= high, 255).otherwise(((v - low) * 255 / F.lit(float(high - low + 1)) + 1.5).cast("int"))
    return g.df.select("row", "col", i.alias("value"))
