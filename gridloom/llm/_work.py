"""Tables that cut lineage, in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.tables import shared_dir


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nobody holds any more, and give the driver's free memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: For tables whose rows are megabytes: a row group is read as one batch, and by default holds 100 rows at least and 128 MB of packed bytes,
#: so that a task's memory would follow the size of its file.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


class Workspace:
    """Named Parquet tables of one operator call. A table survives lost executors, as its files are shared."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame, wide: bool = False) -> DataFrame:
        df.write.options(compression="zstd", **(WIDE_ROWS if wide else {})).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let go of the shuffles behind tables already written."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(conf).delete(at, True)
        release(self.spark)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows; sizes the number of buckets that keys are dealt to."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)
