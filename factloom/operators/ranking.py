"""Ranking, limits per group and ordered carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, key, order, 1).drop("rank")


def mask_top_k(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """Values beyond the k largest of a group become 0."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie)))
    return df.withColumn(value, F.when(rank <= k, F.col(value)).otherwise(0.0))


def rank_with_margin(df: DataFrame, by: str, key: str, score: str, least: float, margin: float) -> DataFrame:
    """Best row per group with ``accepted``: good enough and clear of the second, or a full score."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    best = df.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead(score).over(w)).filter("rank = 1")
    clear = (F.col(score) >= least) & (F.col(score) - F.coalesce("second", F.lit(0.0)) >= margin)
    return best.select(by, key, score, (clear | (F.col(score) >= 0.999)).alias("accepted"))


def carry_forward(df: DataFrame, by: str, order: list[str], value: str, out: str) -> DataFrame:
    """The latest non-null value up to each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def interleave(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """Round robin over strata until n rows, numbered from 1."""
    rounds = df.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("round") <= n)
    first = rounds.orderBy("round", stratum).limit(n)  # the report's n rows
    return first.withColumn("no", F.row_number().over(Window.orderBy("round", stratum)))
