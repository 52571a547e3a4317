"""Grids and points from the driver's tables, and tables that cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta

META = GridMeta(48, 64, -9999, 50.0, -100.0, 0.5, 0.5)
FRAME = GridMeta(24, 24, -1, 40.0, -90.0, 0.25, 0.25)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which executors share. Where none is set, a local session gets one of its own; a cluster's needs one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder; forget() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of keep() that no later step reads."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(t.kept_at)
        at.getFileSystem(conf).delete(at, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g1(spark: SparkSession, sf_dir: str) -> Grid:
    """Summed quantities by order and part key: 48 x 64."""
    s = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 48).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(F.sum("l_quantity").cast("int").alias("value"))
    return Grid(s, META).filled(s)


def large(spark: SparkSession, sf_dir: str, n: int = 1000) -> Grid:
    """Summed quantities by order and part key: n x n, missing where there are none."""
    meta = GridMeta(n, n, -9999, 50.0, -100.0, 0.01, 0.01)
    s = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % n).cast("int").alias("row"), (F.col("l_partkey") % n).cast("int").alias("col")).agg(F.sum("l_quantity").cast("int").alias("value"))
    return Grid(s, meta).filled(s)


def g1g(spark: SparkSession, sf_dir: str) -> Grid:
    """g1 with a gap wherever 7 divides the value."""
    return g1(spark, sf_dir).map(lambda v: F.when(v % 7 == 0, META.missing).otherwise(v))


def g2(spark: SparkSession, sf_dir: str, day: int) -> Grid:
    """Events of a day of January 2024 by user and hour: 24 x 24, 0 where none."""
    e = read(spark, sf_dir, "events").where(F.dayofmonth("ts") == day)
    s = e.groupBy((F.col("user_id") % 24).cast("int").alias("row"), F.hour("ts").alias("col")).agg(F.count("*").cast("int").alias("value"))
    g = Grid(s, FRAME).filled(s)
    return g.map(lambda v: F.when(v == FRAME.missing, 0).otherwise(v))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as observations: id, lat, lon, value."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), (26 + (k * 37 % 240) / 10.0).alias("lat"), (-100 + (k * 53 % 320) / 10.0).alias("lon"), F.floor(F.col("c_acctbal") + 0.5).cast("int").alias("value"))


SQL = {
    "g1": """g1 as (select r::int "row", c::int col, coalesce(v, -9999) "value" from (select unnest(range(48)) r), (select unnest(range(64)) c)
        left join (select l_orderkey % 48 a, l_partkey % 64 b, cast(sum(l_quantity) as int) v from lineitem group by 1, 2) on a = r and b = c)""",
    "g1g": """g1g as (select "row", col, case when "value" % 7 = 0 then -9999 else "value" end "value" from g1)""",
    "f1": """f1 as (select r::int "row", c::int col, coalesce(v, 0)::int "value" from (select unnest(range(24)) r), (select unnest(range(24)) c)
        left join (select user_id % 24 a, hour(ts) b, count(*) v from events where day(ts) = 3 group by 1, 2) on a = r and b = c)""",
    "f2": """f2 as (select r::int "row", c::int col, coalesce(v, 0)::int "value" from (select unnest(range(24)) r), (select unnest(range(24)) c)
        left join (select user_id % 24 a, hour(ts) b, count(*) v from events where day(ts) = 4 group by 1, 2) on a = r and b = c)""",
    "pts": """pts as (select c_custkey id, 26 + (c_custkey * 37 % 240) / 10.0::double lat, -100 + (c_custkey * 53 % 320) / 10.0::double lon,
        cast(floor(c_acctbal + 0.5) as int) "value" from customer)""",
}


def sql(names: str, body: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names.split()) + " " + body
