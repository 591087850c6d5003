"""Keyed state over a stream of operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder


def fold_stream(ops: DataFrame) -> DataFrame:
    """Streaming ``key, last`` of operations ``key, seq, op, value``: the built-in aggregate keeps one row of state per key."""
    return ops.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, be the table one file or a folder: as a pattern, the path may name either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All of a stream's output once its input is drained: what was appended, or the last complete table. Batches go to the shared folder."""
    spark = stream.sparkSession
    home, written = f"{shared_folder(spark)}/factloom/state-{uuid.uuid4().hex}", []

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/state/epoch={epoch}")
        written.append(epoch)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/log").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    kept = sorted(set(written)) if mode == "append" else sorted(written)[-1:]
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{home}/state/epoch={e}" for e in kept])


def drain(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` once all operations of an event table were read as a stream."""
    events = source(spark, path).filter("event_type in ('purchase', 'signup', 'error')")
    ops = events.select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "value")
    return run(fold_stream(ops), "complete").filter("last.op = 'set'").select("key", "last.value")
