"""Registered queries of keyed streaming state and of the ingest of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import state_stream
from ..runtime import shared_folder
from ..streaming import keyed, sink
from .purchase import table
from .registered import query
from .sources import _faded_sql

_OPS = "SELECT 'u' || user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type IN ('purchase', 'signup') THEN 'set' ELSE 'append' END AS op, value FROM events"


@query("st2_stream_state", f"WITH ops AS ({_OPS}), l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops WHERE op <> 'append' GROUP BY 1), a AS (SELECT key, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs, round(sum(value), 6) AS total FROM ops WHERE op = 'append' GROUP BY 1) SELECT key, CASE WHEN l.op = 'set' THEN l.value END AS value, coalesce(l.op = 'set', false) AS is_set, coalesce(length(a.seqs) - length(replace(a.seqs, ',', '')) + 1, 0) AS n, coalesce(total, 0) AS total FROM (SELECT DISTINCT key FROM ops) LEFT JOIN l USING (key) LEFT JOIN a USING (key)")
def st2(spark, d):
    """Set, delete and append operations of one stream in keyed state."""
    events = state_stream.source(spark, f"{d}/events.parquet")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type").isin("purchase", "signup"), "set").otherwise("append")
    ops = events.select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")
    state = keyed.latest(keyed.fold_operations(ops), ["key"])
    total = F.round(F.aggregate("items", F.lit(0.0), lambda s, x: s + x), 6)
    return state.select("key", "value", "is_set", F.size("items").cast("long").alias("n"), total.alias("total"))


@query("st4_evidence_timers", _faded_sql(40).replace("% 10", "% 40"))
def st4_timers(spark, d):
    """Forty ticks of fading by timers; a clock that runs on after the hits ends the last tick, in a second run of the same query."""
    home = f"{shared_folder(spark)}/factloom/fading-{uuid.uuid4().hex}"
    kind = "run_id string, uid string, tick long, lam double"
    spark.createDataFrame([], kind).write.parquet(f"{home}/clock")
    rows = state_stream.source(spark, f"{d}/events.parquet")
    hits = rows.select(F.lit("r").alias("run_id"), F.concat(F.lit("u"), "user_id").alias("uid"), (F.col("event_id") % 40).alias("tick"), F.col("value").alias("lam"))
    faded = keyed.fading_evidence(hits.unionByName(spark.readStream.schema(kind).parquet(f"{home}/clock")))
    keyed.latest(faded, ["run_id", "uid"], f"{home}/state")
    spark.createDataFrame([("clock", "", 41, 0.0)], kind).write.mode("append").parquet(f"{home}/clock")
    state = keyed.latest(faded, ["run_id", "uid"], f"{home}/state")
    return state.filter("lam > 0 and run_id <> 'clock'").select("run_id", "uid", F.round("lam", 6).alias("lam"))


@query("st6_capped_history", "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4 GROUP BY 1")
def st6_capped(spark, d):
    """The last four messages in a list that never holds more."""
    rows = keyed.latest(keyed.history(state_stream.source(spark, f"{d}/conversations.parquet"), 4), ["conv_id"])
    return rows.select("conv_id", F.array_join(F.col("history.turn"), ",").alias("turns"))


_SAID = "SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s FROM conversations"
_VERB = "'([a-z]+) (is|ist|est|es) ([a-z]+)'"


@query("st1_ingest_facts", f"SELECT DISTINCT regexp_extract(s, {_VERB}, 1) AS subject, upper(regexp_extract(s, {_VERB}, 2)) AS relation, regexp_extract(s, {_VERB}, 3) AS object FROM ({_SAID}) WHERE regexp_matches(s, {_VERB})")
def st1_ingest(spark, d):
    """The conversations are streamed into the fact table, and once more by another stream, which adds nothing."""
    home = f"{shared_folder(spark)}/factloom/ingest-{uuid.uuid4().hex}"
    said = state_stream.source(spark, f"{d}/conversations.parquet").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    for stream in ("first", "again"):
        sink.ingest_stream(said, home, ["is", "ist", "est", "es"], ["SUBJECT", "OBJECT"], stream).awaitTermination()
    facts = sink.known_facts(spark, home)
    return facts.select(F.col("roles.SUBJECT").alias("subject"), F.upper("relation").alias("relation"), F.col("roles.OBJECT").alias("object"))
