"""Registered queries of exports, redaction, streams and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import state_stream
from ..runtime import shared_folder
from ..sources import files
from ..streaming import turns
from .purchase import FACTS, LINKS, facts, follow_links, table
from .registered import members_of, query


@query("io7_export_edges", f"WITH {FACTS}, {LINKS} SELECT fid AS source, uid AS target, role AS kind, false AS directed FROM inc UNION ALL SELECT e1, e2, 'FOLLOW', true FROM links")
def io7(spark, d):
    return files.edges(members_of(spark, d), follow_links(spark, d).withColumn("type", F.lit("FOLLOW")))


@query("io8_top_nodes", "SELECT 'P' || p_partkey AS uid, p_size / 50 AS x FROM part ORDER BY p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45), p_size DESC, 'P' || p_partkey LIMIT 100")
def io8(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"), (F.col("p_size") / 50).alias("x"))
    members = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("P"), "l_partkey").alias("uid"))
    return files.top_nodes(nodes, members, 100)


@query("io10_redact", "SELECT event_id, '***' AS token, '***' AS inner_key, event_type AS inner_kind FROM events")
def io10(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("token"), F.struct(F.col("props").alias("api_key"), F.col("event_type").alias("kind")).alias("inner"))
    return files.redact(e, ["token", "api_key"]).select("event_id", "token", F.col("inner.api_key").alias("inner_key"), F.col("inner.kind").alias("inner_kind"))


@query("io4_jsonl_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def io4(spark, d):
    """Parts written as JSON lines to the shared folder and read back with the strict reader."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    path = f"{shared_folder(spark)}/factloom/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema, rows.columns)[0]


@query("io2_write_graph", f"WITH {FACTS} SELECT 'N' || s_nationkey AS graph_id, count(*) AS facts, round(sum(w), 6) AS w FROM facts JOIN supplier ON source = 'S' || s_suppkey GROUP BY 1")
def io2(spark, d):
    """Facts as a graph per nation of the supplier, written by graph and read again."""
    home = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("source"), F.concat(F.lit("N"), "s_nationkey").alias("graph_id"))
    path = f"{shared_folder(spark)}/factloom/graphs-{uuid.uuid4().hex}"
    files.write_tables({"factors": facts(spark, d).join(home, "source").select("graph_id", "fid", "w")}, path)
    back = files.read_tables(spark, path, ("factors",))["factors"]
    return back.groupBy("graph_id").agg(F.count("*").alias("facts"), F.round(F.sum("w"), 6).alias("w"))


@query("io3_read_jsonl", "SELECT CASE p_size % 5 WHEN 0 THEN 'unknown key' WHEN 1 THEN 'missing key' WHEN 2 THEN 'blank value' WHEN 3 THEN 'not an object' ELSE 'good' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def io3(spark, d):
    """A part a line; four of five sizes are broken, each in its way."""
    k = F.col("p_size") % 5
    uid = F.col("p_partkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit('{"id": '), uid, F.lit(', "name": "x", "more": 1}'))).when(k == 1, F.concat(F.lit('{"id": '), uid, F.lit("}"))).when(k == 2, F.concat(F.lit('{"id": '), uid, F.lit(', "name": " "}'))).when(k == 3, uid).otherwise(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))))
    path = f"{shared_folder(spark)}/factloom/lines-{uuid.uuid4().hex}"
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    good, bad = files.read_jsonl(spark, path, StructType.fromDDL("id long, name string"), ["id", "name"])
    return good.select(F.lit("good").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("io5_csv_round_trip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def io5(spark, d):
    path = f"{shared_folder(spark)}/factloom/csv-{uuid.uuid4().hex}"
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    files.write_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("io6_whole_texts", "SELECT r_name AS folder, md5(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS digest FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def io6(spark, d):
    """A file per region that lists its nations."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = f"{shared_folder(spark)}/factloom/texts-{uuid.uuid4().hex}"
    rows.groupBy(F.replace("r_name", F.lit(" "), F.lit("_")).alias("folder")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value")).write.partitionBy("folder").text(path)
    read = files.read_texts(spark, path)
    return read.select(F.replace(F.regexp_extract("path", "folder=([^/]+)/", 1), F.lit("_"), F.lit(" ")).alias("folder"), F.md5("text").alias("digest"))


@query("st1_stream_ingest", "SELECT conv_id, turn, regexp_extract(s, '([a-z]+) (is|ist|est|es) ([a-z]+)', 1) AS subject, regexp_extract(s, '([a-z]+) (is|ist|est|es) ([a-z]+)', 2) AS verb, regexp_extract(s, '([a-z]+) (is|ist|est|es) ([a-z]+)', 3) AS object FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s FROM conversations) WHERE regexp_matches(s, '([a-z]+) (is|ist|est|es) ([a-z]+)')")
def st1(spark, d):
    said = state_stream.source(spark, f"{d}/conversations.parquet").withColumn("ts", F.lit(None).cast("timestamp"))
    return state_stream.run(turns.facts_of(said, ["is", "ist", "est", "es"]).drop("ts"), "append")


@query("st3_stream_dedupe", "SELECT DISTINCT l_returnflag AS relation, l_partkey AS part, l_linestatus AS kind FROM lineitem")
def st3(spark, d):
    rows = state_stream.source(spark, f"{d}/lineitem.parquet")
    facts = rows.select(F.col("l_returnflag").alias("relation"), F.create_map(F.lit("OBJECT"), F.col("l_partkey").cast("string")).alias("roles"), F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("part"))
    return state_stream.run(turns.first_seen(facts).select("relation", "part", "kind"), "append")


def _faded_sql(ticks: int) -> str:
    """One step a tick: halve, drop below 0.05, take in the tick's hits."""
    sums = ", ".join(f"coalesce(sum(value) FILTER (event_id % 10 = {k}), 0) AS h{k}" for k in range(ticks + 1))
    steps = [f"f0 AS (SELECT *, h0 AS x FROM (SELECT 'u' || user_id AS uid, {sums} FROM events GROUP BY 1))"]
    steps += [f"f{k} AS (SELECT * REPLACE (CASE WHEN x * 0.5 < 0.05 THEN 0 ELSE x * 0.5 END + h{k} AS x) FROM f{k - 1})" for k in range(1, ticks + 1)]
    return f"WITH {', '.join(steps)} SELECT 'r' AS run_id, uid, round(x, 6) AS lam FROM f{ticks} WHERE x > 0"


@query("st4_evidence_decay", _faded_sql(10))
def st4(spark, d):
    rows = state_stream.source(spark, f"{d}/events.parquet")
    hits = rows.select(F.lit("r").alias("run_id"), F.concat(F.lit("u"), "user_id").alias("uid"), (F.col("event_id") % 10).alias("tick"), F.col("value").alias("lam"))
    return state_stream.run(turns.faded_evidence(hits, 10), "complete").withColumn("lam", F.round("lam", 6))


@query("st6_recent_history", "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4 GROUP BY 1")
def st6(spark, d):
    rows = turns.recent_history(state_stream.source(spark, f"{d}/conversations.parquet"), 4)
    return state_stream.run(rows, "complete").select("conv_id", F.array_join(F.col("history.turn"), ",").alias("turns"))


@query("io1_read_graph", "SELECT 'R' || r_regionkey AS graph_id, 'graphs' AS part, r_name AS uid, CAST(r_regionkey AS VARCHAR) AS value, 0.0::DOUBLE AS w FROM region UNION ALL SELECT 'R' || n_regionkey, 'nodes', 'N' || n_nationkey, n_name, 0 FROM nation UNION ALL SELECT 'R' || n_regionkey, 'links', 'L' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'PART_OF' ELSE 'ASSOC' END, CASE WHEN n_nationkey % 3 = 0 THEN 0.25 ELSE 1 END FROM nation UNION ALL SELECT 'R' || n_regionkey, 'factors', 'F' || n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'pair' ELSE 'hyper' END, 0.5 FROM nation UNION ALL SELECT 'R' || n_regionkey, 'incidence', 'F' || n_nationkey, 'SUBJECT=N' || n_nationkey, 0 FROM nation")
def io1(spark, d):
    """A snapshot per region (a document of bounded size: its nations), written as JSON and read; a third of the factors has no
    kind, a third an unknown one, and some links have no type or weight."""
    nation = table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    key = lambda prefix: F.concat(F.lit(prefix), F.col("k"))
    node = F.struct(F.col("n_name").alias("label"))
    link = F.struct(F.when(F.col("k") % 2 == 0, "PART_OF").alias("type"), key("N").alias("e1"), F.when(F.col("k") % 3 == 0, 0.25).alias("w"))
    factor = F.struct(key("F").alias("fid"), F.when(F.col("k") % 3 == 0, "pair").when(F.col("k") % 3 == 1, "rumour").alias("kind"), F.lit(0.5).alias("w"), F.create_map(F.lit("SUBJECT"), key("N")).alias("roles"))
    entries = lambda prefix, value: F.map_from_entries(F.collect_list(F.struct(key(prefix), value)))
    stored = nation.groupBy("n_regionkey").agg(entries("N", node).alias("C"), entries("L", link).alias("L"), F.collect_list(factor).alias("semantic_factors"))
    graphs = stored.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = F.struct(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.struct(F.col("r_regionkey").alias("tau"), "C", "L", "semantic_factors").alias("store"))
    path = f"{shared_folder(spark)}/factloom/snapshots-{uuid.uuid4().hex}"
    graphs.select("r_regionkey", F.to_json(whole).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    parts = files.read_snapshots(spark, f"{path}/*")
    row = lambda part, uid, value, w: parts[part].select("graph_id", F.lit(part).alias("part"), F.expr(uid).alias("uid"), F.expr(value).alias("value"), F.expr(w).cast("double").alias("w"))
    out = row("graphs", "name", "cast(tau as string)", "0").unionByName(row("nodes", "uid", "label", "0")).unionByName(row("links", "uid", "type", "w"))
    return out.unionByName(row("factors", "fid", "kind", "w")).unionByName(row("incidence", "fid", "concat(role, '=', uid)", "0"))
