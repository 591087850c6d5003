"""Ingest of a stream of utterances into a written fact table, each fact once, however often a batch or a stream is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from . import turns

FACTS = "fid string, relation string, roles map<string,string>, kind string, w double, seen_at timestamp, stream string, batch long"


def known_facts(spark: SparkSession, home: str) -> DataFrame:
    """The facts that streams have written to ``home``."""
    return spark.read.schema(FACTS).parquet(f"{home}/facts")


def candidates_of(utterances: DataFrame, verbs: list[str], kind: str = "assertion") -> DataFrame:
    """Candidates ``cand_id, relation, roles, kind, confidence, ts`` of utterances ``conv_id, turn, text, ts``."""
    said = turns.facts_of(utterances, verbs)
    roles = F.create_map(F.lit("SUBJECT"), F.col("subject"), F.lit("OBJECT"), F.col("object"))
    return said.select(F.xxhash64("conv_id", "turn", "subject", "verb", "object").alias("cand_id"), F.col("verb").alias("relation"), roles.alias("roles"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"), "ts")


def write_batch(candidates: DataFrame, home: str, roles: list[str], stream: str, batch: int, horizon: str | None = None) -> None:
    """Write a batch's new facts to its own folder; a batch that is run again replaces what it wrote.

    New is what no other batch or stream has written. With a ``horizon`` (an interval such as '1 day') only facts seen at
    most that long before the batch's first utterance are compared, so what is read stays bounded; a fact may come again
    after it. Only keys of earlier facts are read and shuffled.
    """
    spark = candidates.sparkSession
    first, last = candidates.agg(F.min("ts"), F.max("ts")).first()
    # the folder is there from the first batch on
    spark.createDataFrame([], FACTS).drop("stream", "batch").write.mode("overwrite").parquet(f"{home}/facts/stream=none/batch=-1")
    others = known_facts(spark, home).filter((F.col("stream") != stream) | (F.col("batch") != batch))
    if horizon is not None and first is not None:
        others = others.filter(F.col("seen_at") >= F.lit(first) - F.expr(f"INTERVAL {horizon}"))
    new = ingest.ingest(candidates, others.select("relation", "roles", "kind"), roles)
    new.withColumn("seen_at", F.lit(last).cast("timestamp")).write.mode("overwrite").parquet(f"{home}/facts/stream={stream}/batch={batch}")


def ingest_stream(utterances: DataFrame, home: str, verbs: list[str], roles: list[str], stream: str = "turns", horizon: str | None = None) -> StreamingQuery:
    """Start the ingest of streaming utterances into ``home``: drained, then ended. Its checkpoint lies there under the stream's name."""

    def save(batch: DataFrame, epoch: int) -> None:
        write_batch(candidates_of(batch, verbs), home, roles, stream, epoch, horizon)

    return utterances.writeStream.option("checkpointLocation", f"{home}/log/{stream}").foreachBatch(save).trigger(availableNow=True).start()
