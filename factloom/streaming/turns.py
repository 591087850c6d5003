"""Streams of utterances and facts: ingest per turn, duplicates, fading evidence and recent history.

Each function takes and returns a DataFrame that may be streaming; state is what Spark's operators keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ingest


def facts_of(utterances: DataFrame, verbs: list[str]) -> DataFrame:
    """Candidates of each utterance's sentences (``conv_id, turn, text, ts``), without state: ``conv_id, turn, ts, subject, verb, object``."""
    pattern = f"([a-z]+) ({'|'.join(verbs)}) ([a-z]+)"
    cut = utterances.select("conv_id", "turn", "ts", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("s"))
    part = lambda k: F.regexp_extract("s", pattern, k)
    return cut.select("conv_id", "turn", "ts", part(1).alias("subject"), part(2).alias("verb"), part(3).alias("object")).filter("verb <> ''")


def first_seen(facts: DataFrame, delay: str | None = None) -> DataFrame:
    """Each relation, role map and kind once. With a ``delay`` on column ``ts``, keys are forgotten behind the watermark, so state stays bounded."""
    keyed = facts.withColumn("rolekey", ingest.role_key(F.col("roles")))
    key = ["relation", "rolekey", "kind"]
    if delay is None:
        return keyed.dropDuplicates(key)
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def faded_evidence(hits: DataFrame, ticks: int, least: float = 0.05) -> DataFrame:
    """``run_id, uid, lam`` after ``ticks``: at each tick the evidence halves, is dropped below ``least``, and takes in the
    tick's hits (``run_id, uid, tick, lam``; ticks from 0, others are left out).

    The state of a node is one sum per tick, from which its evidence is folded.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("tick") == k, F.col("lam"))), F.lit(0.0)).alias(f"t{k}") for k in range(ticks + 1)]
    left = lambda lam: F.when(lam * 0.5 < least, F.lit(0.0)).otherwise(lam * 0.5)
    folded = F.aggregate(F.array(*[F.col(f"t{k}") for k in range(ticks + 1)]), F.lit(0.0), lambda lam, hit: left(lam) + hit)
    return hits.groupBy("run_id", "uid").agg(*sums).select("run_id", "uid", folded.alias("lam")).filter("lam > 0")


def recent_history(messages: DataFrame, n: int = 24) -> DataFrame:
    """``conv_id, history``: the last n messages (``conv_id, turn, role, text``) in order."""
    row = F.struct("turn", "role", "text")
    if not messages.isStreaming:
        last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.struct("turn", "role", "text").desc()))
        messages = messages.withColumn("_k", last).filter(F.col("_k") <= n)
    top = messages.groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(row), asc=False), 1, n).alias("last"))
    return top.select("conv_id", F.reverse("last").alias("history"))


def live_nodes(hits: DataFrame, tick: int, ttl: int) -> DataFrame:
    """``uid, last``: nodes that a hit (``uid, tick``) up to ``tick`` touched less than ``ttl`` ago; the rest is garbage.

    The state is one number per node. On a stream with event times, give the query a state of ``ttl`` by watermark instead.
    """
    return hits.filter(F.col("tick") <= tick).groupBy("uid").agg(F.max("tick").alias("last")).filter(F.lit(tick) - F.col("last") < ttl)
