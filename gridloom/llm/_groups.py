"""Components for documents of which equal sets count once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._bytes import column, groups
from gridloom.llm._components import components
from gridloom.llm._work import Workspace


def settled(ws: Workspace, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of docs (doc_id, n, hi, lo), where edges link the smallest doc_ids of equal sets (hi, lo).

    Rows of one doc_id with different texts are one node; a row without words goes with the other rows of its doc_id.
    """
    same = ws.table("same", docs.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    node = docs.join(same.select("hi", "lo", "rep"), ["hi", "lo"])
    several = ws.table("several", node.groupBy("doc_id").agg(F.count("*").alias("k"), F.collect_set(F.when(F.col("n") > 0, F.col("rep"))).alias("reps")).where("k > 1").select("doc_id", "reps"))
    meet = several.where(F.size("reps") > 1).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    linked = components(edges.unionByName(meet))
    of = same.join(linked, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.when(F.col("n") > 0, F.coalesce("component", "rep")).alias("component"))
    out = ws.table("linked", docs.join(of, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    least = out.join(several.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
    out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    ws.drop("same")
    return out


def without_id(docs: DataFrame, k: int) -> DataFrame:
    """The same columns for rows whose doc_id is null: they link with nothing."""
    from gridloom.llm.jaccard_join import sets_of

    def sizes(batches):
        for batch in batches:
            data, offsets = column(batch.column(0))
            for a, b in groups(offsets, 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)], pa.int64())], ["n_shingles"])

    n = docs.where("doc_id is null").select("text").mapInArrow(sizes, "n_shingles long")
    return n.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
