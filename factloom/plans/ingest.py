"""Registered queries of text preparation and fact ingest over documents, conversations and purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from .purchase import FACTS, facts, table
from .registered import query

STOP = ["the", "of", "and", "is", "on", "in", "to", "der", "die", "das", "le", "la", "de", "el"]
_STOP = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"


@query("t3_slug", f"SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_brand || ' of the ' || p_type || ', ' || p_name), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))[1:4], '_').upper() AS slug FROM part")
def t3(spark, d):
    said = F.concat("p_brand", F.lit(" of the "), "p_type", F.lit(", "), "p_name")
    return table(spark, d, "part").select("p_partkey", ingest.slug(said, STOP).alias("slug"))


@query("t5_too_wide", "SELECT p_partkey, len(string_split(u, '_')) > 4 OR len(string_split(u, '_')) <> len(list_distinct(string_split(u, '_'))) AS wide FROM (SELECT p_partkey, replace(p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' x y' ELSE ' ' || p_name END, ' ', '_') AS u FROM part)")
def t5(spark, d):
    u = F.replace(F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") > 25, " x y").otherwise(F.concat(F.lit(" "), "p_name"))), F.lit(" "), F.lit("_"))
    return table(spark, d, "part").select("p_partkey", ingest.too_wide(u).alias("wide"))


@query("t6_paragraph_batches")
def t6(spark, d):
    """Tested against a loop over paragraphs."""
    return ingest.paragraph_batches(table(spark, d, "documents")).select("doc_id", "batch", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query("t7_atomic_segments")
def t7(spark, d):
    """Spans of list items, clauses and sentences; tested on known texts and by cutting the spans out again."""
    return ingest.segments(table(spark, d, "documents")).select("doc_id", "no", "kind", "start", "stop", "list_at", F.md5("body").alias("digest"))


_VERBS, _PRON = ["is", "ist", "est", "es"], ["it", "that", "es", "qui", "que"]
_SENT = "s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS sentence, generate_subscripts(regexp_split_to_array(lower(text), '[.!?\\n]+'), 1) - 1 AS no FROM documents), f AS (SELECT doc_id, no, regexp_extract(sentence, '([a-z]+) (is|ist|est|es) ([a-z]+)', 1) AS said, regexp_extract(sentence, '([a-z]+) (is|ist|est|es) ([a-z]+)', 2) AS verb, regexp_extract(sentence, '([a-z]+) (is|ist|est|es) ([a-z]+)', 3) AS object FROM s)"


@query("t12_verb_facts", f"WITH {_SENT} SELECT * FROM (SELECT doc_id, no, last_value(CASE WHEN said NOT IN ('it', 'that', 'es', 'qui', 'que') THEN said END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS subject, verb, object FROM f WHERE verb <> '') WHERE subject IS NOT NULL")
def t12(spark, d):
    return ingest.verb_facts(table(spark, d, "documents"), _VERBS, _PRON).withColumn("no", F.col("no").cast("long"))


# statements: an order's line says what was bought, of a kind by its flag
_CAND = "cand AS (SELECT l_orderkey * 10 + l_linenumber AS cand_id, l_orderkey AS conv_id, l_linenumber AS seq, 'C' || o_custkey AS subj, 'P' || l_partkey AS obj, CASE l_returnflag WHEN 'R' THEN 'proposal' WHEN 'A' THEN 'assertion' ELSE 'decision' END AS kind, l_quantity / 50 AS confidence, l_shipdate, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def candidates(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "proposal").when(F.col("l_returnflag") == "A", "assertion").otherwise("decision")
    roles = F.create_map(F.lit("SUBJECT"), F.concat(F.lit("C"), "o_custkey"), F.lit("OBJECT"), F.concat(F.lit("P"), "l_partkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_id"), F.col("l_orderkey").alias("conv_id"), F.col("l_linenumber").alias("seq"), F.lit("buys").alias("relation"), roles.alias("roles"), kind.alias("kind"), (F.col("l_quantity") / 50).alias("confidence"), "l_suppkey")


@query("t10_split_coordinated", "SELECT p_partkey AS cand_id, unnest(CASE WHEN p_size % 2 = 0 THEN [string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]] ELSE [p_name] END) AS object FROM part")
def t10(spark, d):
    said = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(" and "))).otherwise(F.col("p_name"))
    cands = table(spark, d, "part").select(F.col("p_partkey").alias("cand_id"), F.create_map(F.lit("SUBJECT"), F.col("p_brand"), F.lit("OBJECT"), said).alias("roles"))
    return ingest.split_coordinated(cands).select("cand_id", F.element_at("roles", "OBJECT").alias("object"))


@query("t13_problems", "SELECT event_id AS cand_id, concat_ws(',', CASE WHEN value > 50 THEN 'confidence' END, CASE WHEN event_type = 'view' THEN 'unknown role' END, CASE WHEN event_type = 'error' THEN 'blank filler' END) AS problems FROM events")
def t13(spark, d):
    kind = F.col("event_type")
    roles = F.create_map(F.lit("SUBJECT"), F.concat(F.lit("u"), "user_id"), F.when(kind == "view", "SEEN").otherwise("OBJECT"), F.when(kind == "error", " ").otherwise(kind))
    cands = table(spark, d, "events").select(F.col("event_id").alias("cand_id"), kind.alias("relation"), roles.alias("roles"), (F.col("value") / 50).alias("confidence"))
    return ingest.problems(cands, ["SUBJECT", "OBJECT"]).select("cand_id", F.array_join("problems", ",").alias("problems"))


@query("t17_gate_candidates", "SELECT p_partkey AS cand_id, CASE WHEN p_size / 50 < 0.5 THEN 'confidence' WHEN p_partkey % 3 = 0 THEN 'not in source' END AS reason FROM part")
def t17(spark, d):
    part = table(spark, d, "part")
    cands = part.select(F.col("p_partkey").alias("cand_id"), F.create_map(F.lit("SUBJECT"), F.col("p_name"), F.lit("OBJECT"), F.when(F.col("p_partkey") % 3 == 0, "unsaid").otherwise(F.col("p_type"))).alias("roles"), (F.col("p_size") / 50).alias("confidence"))
    said = part.select(F.col("p_partkey").alias("cand_id"), F.concat(F.lit("A "), "p_name", F.lit(", "), "p_type", F.lit(".")).alias("text"))
    return ingest.gate(cands, said).select("cand_id", "reason")


@query("t18_classify_utterance", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\?\s*$') THEN 'question' WHEN regexp_matches(lower(text), '[a-z]+ (is|ist|est|es) [a-z]+') THEN 'fact' ELSE 'message' END AS kind FROM conversations")
def t18(spark, d):
    has_fact = F.lower("text").rlike("[a-z]+ (is|ist|est|es) [a-z]+")
    return table(spark, d, "conversations").select("conv_id", "turn", ingest.classify(F.col("text"), has_fact).alias("kind"))


@query("t20_ingest_facts", f"WITH {_CAND}, good AS (SELECT DISTINCT subj, obj, kind FROM cand WHERE confidence >= 0.5 AND confidence <= 1), old AS (SELECT subj, obj, kind FROM cand WHERE l_suppkey % 10 = 0) SELECT subj AS subject, obj AS object, kind, 0.5::DOUBLE * CASE kind WHEN 'proposal' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS w FROM good g WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.subj = g.subj AND o.obj = g.obj AND o.kind = g.kind)")
def t20(spark, d):
    """Statements that suppliers with a key divisible by ten made are in the graph already."""
    c = candidates(spark, d)
    new = ingest.ingest(c, c.filter("l_suppkey % 10 = 0"), ["SUBJECT", "OBJECT"])
    wide = ingest.members(new).groupBy("fid").pivot("role", ["SUBJECT", "OBJECT"]).agg(F.first("uid"))
    return new.join(wide, "fid").select(F.col("SUBJECT").alias("subject"), F.col("OBJECT").alias("object"), "kind", "w")


@query("t21_dedupe_facts", f"WITH {_CAND} SELECT min(cand_id) AS cand_id, kind FROM cand GROUP BY subj, obj, kind")
def t21(spark, d):
    return ingest.dedupe_facts(candidates(spark, d)).select("cand_id", "kind")


@query("t23_conversation_anchor", f"WITH {_CAND} SELECT conv_id, min(subj) AS anchor FROM cand WHERE kind <> 'proposal' GROUP BY 1")
def t23(spark, d):
    return ingest.anchors(candidates(spark, d), ["SUBJECT", "OBJECT"])


@query("t25_upsert_entities", "SELECT coalesce(k.uid, s.uid) AS uid, array_to_string(list_sort(list_distinct(list_concat(coalesce(k.forms, []), coalesce(s.forms, [])))), '|') AS forms, CASE WHEN k.uid IS NULL THEN 7 ELSE 1 END AS created_tau FROM (SELECT p_brand AS uid, list(DISTINCT p_name) AS forms FROM part WHERE p_size < 3 GROUP BY 1) k FULL JOIN (SELECT p_brand AS uid, list(DISTINCT p_name) AS forms FROM part WHERE p_size > 47 GROUP BY 1) s ON k.uid = s.uid")
def t25(spark, d):
    part = table(spark, d, "part")
    known = part.filter("p_size < 3").groupBy(F.col("p_brand").alias("uid")).agg(F.collect_set("p_name").alias("forms")).withColumn("created_tau", F.lit(1))
    return ingest.upsert_entities(known, part.filter("p_size > 47").select(F.col("p_brand").alias("uid"), F.col("p_name").alias("form")), 7).select("uid", F.array_join("forms", "|").alias("forms"), "created_tau")


@query("t26_assign_ids", "SELECT o_orderkey, printf('E_%05d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS uid FROM orders")
def t26(spark, d):
    return ingest.assign_ids(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "E").select("o_orderkey", "uid")


@query("t27_property_upsert", "SELECT p_partkey AS uid, CASE WHEN p_size > 40 THEN 'missing row' ELSE 'name taken' END AS reason FROM part WHERE p_size > 40 OR p_size % 2 = 0")
def t27(spark, d):
    part = table(spark, d, "part")
    rows = part.filter("p_size <= 40").select(F.col("p_partkey").alias("uid"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("props"))
    new = part.select(F.col("p_partkey").alias("uid"), F.when(F.col("p_size") % 2 == 0, "brand").otherwise("type").alias("name"), F.col("p_type").alias("value"))
    return ingest.add_properties(rows, new)[1].select("uid", "reason")


@query("t29_render_facts", f"WITH {FACTS} SELECT fid, subject || ' bought ' || object || ' from ' || source AS body FROM facts")
def t29(spark, d):
    roles = F.create_map(F.lit("SUBJECT"), F.col("subject"), F.lit("OBJECT"), F.col("object"), F.lit("SOURCE"), F.col("source"))
    return facts(spark, d).select("fid", ingest.render(F.lit("PURCHASE"), roles, F.lit("{SUBJECT} bought {OBJECT} from {SOURCE}")).alias("body"))


@query("t31_format_fact", f"WITH {FACTS} SELECT fid, concat_ws(' ', CASE WHEN w > 0.2 THEN '[sure]' END, 'PURCHASE', subject || ',', object, '(' || substr(time, 8, 2) || '.' || substr(time, 6, 2) || '.' || substr(time, 2, 4) || ')') AS line FROM facts")
def t31(spark, d):
    day = F.date_format(F.to_date(F.substring("time", 2, 8), "yyyyMMdd"), "dd.MM.yyyy")
    return facts(spark, d).select("fid", F.concat_ws(" ", F.when(F.col("w") > 0.2, "[sure]"), F.lit("PURCHASE"), F.concat("subject", F.lit(",")), "object", F.concat(F.lit("("), day, F.lit(")"))).alias("line"))
