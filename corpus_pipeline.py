"""The corpus pipeline: language ID, line dedup, near-duplicate join, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Null texts: language ID rejects them. Rows with a null doc_id go through
every stage, but take no part in line and document matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, language_id, line_dedup, mix_sources
from gridloom.llm._work import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose best language is less probable than the calibrated threshold."""
    model = language_id.fit(docs)
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # columns of any name pass in one
    found = language_id.predict(docs.select(rest.alias("row"), "text"), model).where("accepted")
    return found.select(*(F.col(c if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that match an earlier line; documents stay, if need be with an empty text."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group that shares 80 % of its 5-word shingles."""
    return jaccard_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 10 consecutive words of a benchmark item, or all of a shorter one."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Rates are spread widely in the last stage. By this ridge a document that is surely of a domain with target 0 keeps at most the rate
#: LEAST_RATE / (1 + LEAST_RATE); what isn't drawn more often than LEAST_RATE goes.
LEAST_RATE = 0.05


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, posterior and rate, and drops documents of rates up to LEAST_RATE: they are of a domain whose target is none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_sources.mix(docs, docs, labels, ridge=LEAST_RATE).where(F.col("rate") > LEAST_RATE)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixing", mixing)]

#: Language ID and mixing are learned, which SQL can't express; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.table(name, stage(spark, docs, sf_dir))
    return docs
