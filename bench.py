"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from gridloom.operators import distance, motion, objects, segment, stats, stencil
from gridloom.plans.queries import QUERIES
from gridloom.plans.tables import keep, large

NAMES = ["histogram", "otsu", "dilate", "smooth_boxcar", "local_stats", "threshold_segment", "region_props", "edt", "nearest_point", "oban_gather", "hough", "glcm_measures"]

if __name__ == "__main__":
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["histogram"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    # the same operators on a grid of a million cells, to show how they grow
    g = large(spark, sf)
    g = type(g)(keep(g.df, "bench"), g.meta)
    for name, run in {"histogram": lambda: stats.histogram(g, 0, 10, 60), "dilate": lambda: stencil.dilate(g, 2).df, "local_stats": lambda: stencil.local_stats(g, 5, 5), "threshold_segment": lambda: segment.label(g, 20), "edt": lambda: distance.edt(g, 45).df, "smooth_11x11": lambda: stencil.smooth(g, stencil.boxcar(11)).df, "median_5x5": lambda: stencil.median(g, 2).df, "local_texture": lambda: objects.local_texture(g, 3, 3, 0, 20, 6), "cross_correlation": lambda: motion.cross_correlation(g, g, 2, 2, 2)}.items():
        t = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[f"{name}_1000x1000"] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
