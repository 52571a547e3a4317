"""Readers of satellite frames and of grids in a Lambert projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta
from gridloom.operators import cells
from gridloom.operators.geometry import Lambert

#: Fixed: type_date_ROWSxCOLS_lat_lon_subtype_dlat_dlon.llg; the subtype may hold underscores.
FRAME_NAME = r"([^_/]+)_([0-9]+-[0-9]+)_([0-9]+)x([0-9]+)_([-0-9.]+)_([-0-9.]+)_(.*)_([-0-9.]+)_([-0-9.]+)\.llg$"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame_ts, nrows, ncols, nw_lat, nw_lon, lat_res, lon_res, row, col, value of the .llg files at path, in any order.

    All metadata are in the name. A cell is a signed byte, whose negative is the value; 0 is missing. Seconds are read as such.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.llg").load(path)
    part = lambda i, t="double": F.regexp_extract("path", FRAME_NAME, i).cast(t)
    named = files.where(F.col("path").rlike(FRAME_NAME)).select(F.to_timestamp(F.regexp_extract("path", FRAME_NAME, 2), "yyyyMMdd-HHmmss").alias("frame_ts"), part(3, "int").alias("nrows"), part(4, "int").alias("ncols"), part(5).alias("nw_lat"), part(6).alias("nw_lon"), part(8).alias("lat_res"), part(9).alias("lon_res"), "content")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = -np.frombuffer(r.content, np.int8)[: r.nrows * r.ncols].astype(np.int32)
                at = np.arange(len(a))
                own = {k: getattr(r, k) for k in ("frame_ts", "nrows", "ncols", "nw_lat", "nw_lon", "lat_res", "lon_res")}
                yield pd.DataFrame(own | {"row": (at // r.ncols).astype(np.int32), "col": (at % r.ncols).astype(np.int32), "value": a})

    return named.mapInPandas(run, "frame_ts timestamp, nrows int, ncols int, nw_lat double, nw_lon double, lat_res double, lon_res double, row int, col int, value int")


def read_lambert(spark: SparkSession, path: str, scaling: int) -> Grid:
    """A text grid in a Lambert projection, southmost row first, brought to a latitude and longitude grid of the same size by bilinear means.

    Ten pairs of name and value come first: ellipsoid, projection, two parallels, centre, cell sizes east and north, rows and columns.
    Values are scaled, with 0.5 added, and cut; text that is no number is missing (-999).
    """
    text = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), "\\s+").alias("t"))
    h = text.select(F.slice("t", 1, 20).alias("h")).first()["h"][1::2]
    if h[:2] != ["WGS-84", "LAMBERT2SP"]:
        raise ValueError(f"the projection is {h[1]} on {h[0]}, not LAMBERT2SP on WGS-84")
    lat1, lat2, lat0, lon0, dx, dy = map(float, h[2:8])
    nr, nc = int(h[8]), int(h[9])
    project = Lambert(lat0, lon0, lat1, lat2, northing=-nr * 0.5 * dy, easting=nc * 0.5 * dx)
    body = text.select(F.posexplode(F.slice("t", 21, nr * nc)).alias("p", "x"))
    value = F.coalesce((F.lit(0.5) + F.expr("try_cast(x as double)") * scaling).cast("int"), F.lit(-999))
    # rows count from the north here: the first in the file is the last
    plane = Grid(body.select((nr - 1 - F.floor(F.col("p") / nc)).cast("int").alias("row"), (F.col("p") % nc).cast("int").alias("col"), value.alias("value")), GridMeta(nr, nc, -999))
    # northings count down from 0 at the upper edge, eastings from 0 at the left one
    lat, lon = project.inverse(-(F.col("row") + 0.5) * dy, (F.col("col") + 0.5) * dx)
    south, north, west, east = plane.df.select(lat.alias("lat"), lon.alias("lon")).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    meta = GridMeta(nr, nc, -999, north, west, (north - south) / nr or 1.0, (east - west) / nc or 1.0)
    n, e = project.forward(F.col("lat"), F.col("lon"))
    at = cells.locations(Grid(plane.df, meta)).select(F.col("row").alias("r"), F.col("col").alias("c"), "lat", "lon")
    y, x = -n / dy - 0.5, e / dx - 0.5
    corners = at.select("r", "c", y.alias("y"), x.alias("x"))
    corners = corners.withColumn("row", F.explode(F.array_distinct(F.array(F.floor("y"), F.ceil("y"))))).withColumn("col", F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x")))))
    w = (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col")))
    means = corners.join(plane.valid, ["row", "col"]).groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.floor(F.sum(w * F.col("value")) / F.nullif(F.sum(w), F.lit(0.0)) + 0.5).cast("int").alias("value"))
    assert math.isfinite(meta.lat_res)
    return Grid(plane.df, meta).filled(means)
