"""Registered queries of candidates: payloads, entity fillers, seeds, plug-ins and their evaluation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import ingest, plugins
from .ingest import STOP, candidates
from .purchase import table
from .registered import query

_STOP = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"


@query("f6_get", "SELECT 'P' || l_partkey AS uid, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_type <> want THEN 'other kind' ELSE 'found' END AS outcome FROM (SELECT DISTINCT l_partkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS l_partkey, CASE WHEN l_returnflag = 'R' THEN 'SMALL' ELSE 'LARGE' END AS want FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey")
def f6(spark, d):
    wanted = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 100000000).otherwise(0)).alias("uid"), F.when(F.col("l_returnflag") == "R", "SMALL").otherwise("LARGE").alias("kind")).distinct()
    rows = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"), F.col("p_type").alias("kind"))
    good, bad = ingest.get(wanted, rows)
    return good.select("uid", F.lit("found").alias("outcome")).unionByName(bad.select("uid", F.col("problem").alias("outcome")))


@query("f11_assistant_only", "SELECT l_orderkey * 10 + l_linenumber AS cand_id, 'P' || l_partkey AS object FROM lineitem WHERE l_returnflag = 'R' AND l_quantity / 50 >= 0.75")
def f11(spark, d):
    return ingest.assistant_only(candidates(spark, d), STOP).select("cand_id", F.element_at("roles", F.lit("OBJECT")).alias("object"))


@query("f12_without_query_clauses", "SELECT l_orderkey * 10 + l_linenumber AS cand_id FROM lineitem WHERE NOT (l_linenumber % 2 = 0 AND l_returnflag IN ('R', 'A'))")
def f12(spark, d):
    kind = F.when(F.col("kind") == "proposal", "topic").when(F.col("kind") == "assertion", "open_question").otherwise(F.col("kind"))
    return ingest.without_query_clauses(candidates(spark, d).withColumn("kind", kind).withColumn("asked", F.col("seq") % 2 == 0)).select("cand_id")


@query("t4_head_entity", "SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN upper(replace(p_name, ' ', '_')) WHEN 2 THEN 'QUICKLY_' || upper(replace(p_name, ' ', '_')) END AS head FROM part")
def t4(spark, d):
    """Stop words and signs go, an adverb may stay beside a head but is none."""
    k = F.col("p_size") % 3
    filler = F.when(k == 0, "the slowly").when(k == 1, F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand")).otherwise(F.concat(F.lit("quickly "), "p_name"))
    return table(spark, d, "part").select("p_partkey", ingest.head_entity(filler, STOP).alias("head"))


def payloads(spark, d):
    """Per order a JSON payload with a candidate for each line; returned lines have no kind, priorities 1 and 2 are questions."""
    kind = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_returnflag") == "A", "Decision").otherwise("rumour")
    relation = F.when(F.col("l_linenumber") == 1, "is_what_was_bought_by_them").otherwise("buys")
    one = F.struct(F.col("l_linenumber").alias("n"), "l_partkey", relation.alias("relation"), F.concat(F.lit("C"), "o_custkey").alias("subject"), F.concat(F.lit("P"), "l_partkey").alias("object"), kind.alias("kind"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity") / 50).alias("confidence"))
    with_roles = lambda c: F.struct(c["relation"].alias("relation"), F.create_map(F.lit("SUBJECT"), c["subject"], F.lit("OBJECT"), c["object"]).alias("roles"), c["kind"].alias("kind"), c["confidence"].alias("confidence"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    said = F.when(F.col("o_orderpriority") < "3", "question").otherwise("fact")
    packed = rows.groupBy("l_orderkey", said.alias("kind")).agg(F.transform(F.array_sort(F.collect_list(one)), with_roles).alias("candidates"))
    return packed.select(F.col("l_orderkey").alias("text_id"), F.to_json(F.struct("kind", "candidates")).alias("payload"))


_PAYLOAD = "pl AS (SELECT l_orderkey AS text_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS no, l_linenumber, 'C' || o_custkey AS subject, 'P' || l_partkey AS object, CASE l_returnflag WHEN 'R' THEN CASE WHEN o_orderpriority < '3' THEN NULL ELSE 'assertion' END WHEN 'A' THEN 'decision' END AS kind, CASE WHEN l_linenumber > 2 THEN l_quantity / 50 ELSE 0.8 END AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("t15_from_payload", f"WITH {_PAYLOAD} SELECT text_id, l_linenumber AS line, CASE WHEN l_linenumber > 1 THEN 'BUYS' WHEN kind = 'decision' THEN 'DECIDES' ELSE 'RELATED_TO' END AS relation, object, kind, round(confidence, 6) AS confidence FROM pl WHERE kind IS NOT NULL")
def t15(spark, d):
    found = ingest.from_payload(payloads(spark, d))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("text_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("P"), "l_partkey").alias("object"), F.row_number().over(_by_line()).alias("place"))
    out = found.withColumn("place", F.col("no") + 1).join(lines.drop("object"), ["text_id", "place"])
    return out.select("text_id", "line", "relation", F.element_at("roles", F.lit("OBJECT")).alias("object"), "kind", F.round("confidence", 6).alias("confidence"))


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")


@query("io11_replay_facts", f"WITH {_PAYLOAD} SELECT relation, kind, count(*) AS n FROM (SELECT DISTINCT CASE WHEN l_linenumber > 1 THEN 'BUYS' WHEN kind = 'decision' THEN 'DECIDES' ELSE 'RELATED_TO' END AS relation, subject, object, kind FROM pl WHERE kind IS NOT NULL AND confidence >= 0.5) GROUP BY 1, 2")
def io11(spark, d):
    stored = payloads(spark, d)
    none = candidates(spark, d).limit(0).select("relation", "roles", "kind")
    return ingest.replay(stored, none, ["SUBJECT", "OBJECT"]).groupBy("relation", "kind").agg(F.count("*").alias("n"))


@query("t16_finalize", "SELECT min(l_orderkey * 10 + l_linenumber) AS cand_id, 'BUYS' AS relation, 'C' || o_custkey AS subject, 'P' || l_partkey AS object FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 4 <> 0 GROUP BY o_custkey, l_partkey")
def t16(spark, d):
    """Every fourth line's object is no entity."""
    roles = F.when(F.col("seq") % 4 == 0, F.create_map(F.lit("SUBJECT"), F.element_at("roles", F.lit("SUBJECT")), F.lit("OBJECT"), F.lit("of the"))).otherwise(F.col("roles"))
    done = ingest.finalize(candidates(spark, d).withColumn("roles", roles), STOP)
    return done.select("cand_id", "relation", F.element_at("roles", F.lit("SUBJECT")).alias("subject"), F.element_at("roles", F.lit("OBJECT")).alias("object"))


@query("t19_seed_entities", rf"WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM w), f AS (SELECT conv_id, turn, token, min(pos) AS pos FROM e WHERE (regexp_matches(token, '^\d+$') OR (length(token) >= 2 AND NOT list_contains({_STOP}, token))) AND NOT regexp_matches(token, '^\p{{L}}{{3,}}ly$') GROUP BY 1, 2, 3) SELECT conv_id, turn, rank, token FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rank FROM f) WHERE rank <= 8")
def t19(spark, d):
    said = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("text_id"), "text")
    return ingest.seed_entities(said, STOP).select("text_id.conv_id", "text_id.turn", "rank", "token")


@query("t24_compound_heads", "WITH t AS (SELECT p_partkey AS text_id, unnest(list_distinct(string_split(p_name, ' ') || [lower(p_type)])) AS token, string_split(p_name, ' ')[1] AS head, p_size FROM part) SELECT text_id, token FROM t WHERE NOT (token = head AND p_size > 25)")
def t24(spark, d):
    part = table(spark, d, "part")
    seeds = part.select(F.col("p_partkey").alias("text_id"), F.explode(F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))).alias("token"))
    named = part.select(F.col("p_partkey").alias("text_id"), F.create_map(F.lit("OBJECT"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.lower("p_type"))).alias("roles"))
    return ingest.without_compound_heads(seeds, named)


_CLAUSE = "([a-z]+) (is|ist|est|es) ([a-z]+)"


def clause_extractor(batch: pd.DataFrame) -> pd.DataFrame:
    """The last clause of each text; a text that begins with a digit is refused."""
    rows = []
    for uid, text in zip(batch["text_id"], batch["text"], strict=True):
        if re.match("[0-9]", text):
            raise ValueError("begins with a digit")
        found = re.findall(_CLAUSE, text.lower())
        if found:
            rows.append((uid, found[-1][1], {"SUBJECT": found[-1][0], "OBJECT": found[-1][2]}, "assertion", 0.9))
    return pd.DataFrame(rows, columns=["text_id", "relation", "roles", "kind", "confidence"])


def said(spark, d):
    uid = F.concat_ws(":", "conv_id", "turn")
    return table(spark, d, "conversations").select(uid.alias("text_id"), F.regexp_replace("text", "^[0-9]+", "").alias("text"))


_FOUND = f"f AS (SELECT conv_id || ':' || turn AS text_id, regexp_extract_all(lower(regexp_replace(text, '^[0-9]+', '')), '{_CLAUSE}', 1) AS s, regexp_extract_all(lower(regexp_replace(text, '^[0-9]+', '')), '{_CLAUSE}', 2) AS v, regexp_extract_all(lower(regexp_replace(text, '^[0-9]+', '')), '{_CLAUSE}', 3) AS o FROM conversations)"


@query("t11_extract_facts", f"WITH {_FOUND} SELECT text_id, v[-1] AS relation, s[-1] AS subject, o[-1] AS object FROM f WHERE len(s) > 0")
def t11(spark, d):
    out = plugins.extract_facts(said(spark, d), clause_extractor)
    return out.select("text_id", "relation", F.element_at("roles", F.lit("SUBJECT")).alias("subject"), F.element_at("roles", F.lit("OBJECT")).alias("object"))


@query("q9_role_eval", f"WITH {_FOUND}, r AS (SELECT text_id, 'SUBJECT' AS role, s[1] AS want, s[-1] AS got FROM f WHERE len(s) > 0 UNION ALL SELECT text_id, 'OBJECT', o[1], o[-1] FROM f WHERE len(s) > 0) SELECT role, round(avg((want = got)::INT), 6) AS f1 FROM r GROUP BY 1 UNION ALL SELECT 'LOCATION', 0.0")
def q9(spark, d):
    """The first clause is expected, the extractor gives the last."""
    texts = said(spark, d)
    part = lambda k: F.regexp_extract(F.lower("text"), _CLAUSE, k)
    first = texts.filter(part(1) != "").select("text_id", F.explode(F.create_map(F.lit("SUBJECT"), part(1), F.lit("OBJECT"), part(3))).alias("role", "value"))
    made = plugins.extract_or_report(texts, clause_extractor).filter("error is null").select("text_id", F.explode("roles").alias("role", "value"))
    named = lambda df: df.withColumnRenamed("text_id", "item")
    return ev.role_scores(named(first), named(made)).select("role", F.round("f1", 6).alias("f1"))


def shout(batch: pd.DataFrame) -> pd.DataFrame:
    """An upper-case relation for labels of even length, more confident than allowed."""
    even = batch[batch["raw"].str.len() % 2 == 0]
    return even.assign(canonical=even["raw"].str.upper().str.replace(" ", "_"), confidence=even["raw"].str.len() / 20)


@query("n5_normalize_external", "SELECT DISTINCT p_name AS raw, upper(replace(p_name, ' ', '_')) AS canonical, least(1, length(p_name) / 20) AS confidence FROM part WHERE length(p_name) % 2 = 0")
def n5(spark, d):
    return plugins.normalize_external(table(spark, d, "part").select(F.col("p_name").alias("raw")), shout)


def letters(batch: pd.DataFrame) -> pd.DataFrame:
    """A vector of three numbers: length, vowels a and e."""
    t = batch["text"]
    return batch.assign(embedding=[[float(len(x)), float(x.count("a")), float(x.count("e"))] for x in t])


@query("v8_embed", "SELECT conv_id, turn, length(text) AS n, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'e', '')) AS e FROM conversations")
def v8(spark, d):
    out = plugins.embed(table(spark, d, "conversations").select("conv_id", "turn", "text"), letters)
    return out.select("conv_id", "turn", *[F.col("embedding")[i].cast("long").alias(c) for i, c in enumerate("nae")])
