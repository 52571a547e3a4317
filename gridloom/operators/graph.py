"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.tables import forget, keep


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Large-star and small-star contraction in turn: the number of rounds is logarithmic in the longest path, and each round is a table in the
    shared folder, which the next one replaces. Edges from a node to itself say nothing; nodes that have no others are left out.
    """
    cur, last = keep(_clean(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges"), None
    while True:
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = keep(_clean(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        new = keep(_clean(small), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(cur, large)
        cur = new
        if state == last:  # every edge is now (smallest of its component, node)
            return cur.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        last = state


def _clean(e: DataFrame) -> DataFrame:
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
