"""The grid model: a long DataFrame (row, col, value) and a small record of its shape and place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridMeta:
    nrows: int
    ncols: int
    missing: int = -9999
    nw_lat: float = 0.0
    nw_lon: float = 0.0
    lat_res: float = 1.0
    lon_res: float = 1.0

    @property
    def se_corner(self) -> tuple[float, float]:
        return self.nw_lat - self.nrows * self.lat_res, self.nw_lon + self.ncols * self.lon_res


@dataclass(frozen=True)
class Grid:
    """A dense grid: every (row, col) is there once; meta.missing marks cells without a value."""

    df: DataFrame
    meta: GridMeta

    def map(self, f: Callable[[Column], Column], **meta) -> Grid:
        """Replace every value, missing ones included."""
        return Grid(self.df.select("row", "col", f(F.col("value")).cast("int").alias("value")), replace(self.meta, **meta))

    def map_valid(self, f: Callable[[Column], Column], **meta) -> Grid:
        """Replace every value that isn't missing."""
        return self.map(lambda v: F.when(v == self.meta.missing, v).otherwise(f(v)), **meta)

    @property
    def valid(self) -> DataFrame:
        return self.df.where(F.col("value") != self.meta.missing)

    def filled(self, df: DataFrame, **meta) -> Grid:
        """A grid from sparse cells (row, col, value); the rest is missing."""
        m = replace(self.meta, **meta)
        return Grid(spine(df.sparkSession, m.nrows, m.ncols).join(df, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("value").cast("int"), F.lit(m.missing)).alias("value")), m)


def spine(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    return spark.range(nrows * ncols).select(F.expr(f"cast(id div {ncols} as int)").alias("row"), (F.col("id") % ncols).cast("int").alias("col"))


def jround(x: Column) -> Column:
    """Round half up, as an int."""
    return F.floor(x + F.lit(0.5)).cast("int")


def idiv(a: Column, b) -> Column:
    """Integer division that cuts towards zero; b is a number or a column."""
    return ((a - a % b) / b).cast("long")
