"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last repeats each document as often as the mix
takes it and adds ``copy`` (from 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialize, read
from factloom.llm.decontaminate import drop_contaminated
from factloom.llm.exact_dedup import drop_exact_duplicates
from factloom.llm.mixture import mix_documents
from factloom.llm.near_dedup import drop_near_duplicates
from factloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test item occurs."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: each document as many times as its source's target takes it."""
    return mix_documents(docs).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for no, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if no + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs


#: Toxicity scoring is a trained model, which SQL can't express; the stages are tested against brute force instead.
ORACLE_SQL = None
