"""Ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.tables import keep


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with name: 1, 2, ... in the order of by, whose values are distinct and not null.

    Rows are dealt by ranges of by and numbered within a range; a row for each range tells how many came before. The ranges are drawn
    from a sample, so the dealt rows are a table: a task that runs again finds the same ranges.
    """
    dealt = keep(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()), "ranked")
    held = dealt.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(by))
    return dealt.join(held.select("__range", before.alias("__before")), "__range").withColumn(name, (own + F.col("__before")).cast("int")).drop("__range", "__before")
