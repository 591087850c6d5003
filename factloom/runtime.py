"""Cutting lineage in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is set and Spark runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-factloom-")
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and go on from the files, without what the planner knew: a checkpoint keeps the plan's
    constraints, and in a loop that makes columns of each other they double with each round."""
    path = f"{shared_folder(df.sparkSession)}/factloom/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by ``by`` to at least as many tasks as run at once: a table packed into one small file is read by one task,
    however much is made of its rows, and a number that is asked for is not made smaller afterwards."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)
