"""Registered queries of paths, proofs, hygiene and question answering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import paths, propagation, questions, text
from .purchase import FACTS, LINKS, PARAMS, evidence, factors, facts, follow_links, node_name, seeds, steps_sql, table
from .registered import members_of, purchase_rows, query, spread


@query("h3_collect_garbage", "SELECT 'P' || p_partkey AS uid, CASE WHEN 50 - p_size >= 20 THEN 'removed' ELSE 'protected' END AS fate FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def h3(spark, d):
    """Parts are live while a large order links them to a supplier."""
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"), F.col("p_size").alias("added_at"))
    links = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("e1"), F.concat(F.lit("P"), "l_partkey").alias("e2"), F.when(F.col("l_quantity") > 45, 1.0).otherwise(0.0).alias("w"))
    roots = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("uid"))
    return paths.collect_garbage(nodes, links, roots, 50, 20)[2]


@query("h9_validate", "SELECT 'property' AS \"check\", 'P' || p_partkey AS uid FROM part WHERE len(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) < 3 UNION ALL SELECT 'reference', 'F' || l_orderkey || '_' || l_linenumber FROM lineitem WHERE l_partkey > 1900")
def h9(spark, d):
    names = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"), names.alias("names"))
    moved = F.when(F.col("l_partkey") > 1900, -1).otherwise(F.col("l_partkey"))
    refs = table(spark, d, "lineitem").select(F.concat(F.lit("F"), "l_orderkey", F.lit("_"), "l_linenumber").alias("uid"), F.concat(F.lit("P"), moved).alias("ref"))
    return paths.issues(nodes, refs)


@query("h11_explain_paths", f"WITH RECURSIVE {LINKS}, e AS (SELECT e1 AS a, e2 AS b FROM links UNION ALL SELECT e2, e1 FROM links), r AS (SELECT 'O' || min(o_orderkey) AS uid, 0 AS depth FROM orders GROUP BY o_custkey UNION SELECT b, depth + 1 FROM r JOIN e ON a = uid WHERE depth < 4) SELECT uid, min(depth) AS depth FROM r GROUP BY uid")
def h11(spark, d):
    """Consecutive orders as two-member factors; a customer's first order is a seed."""
    links = follow_links(spark, d)
    m = links.select("fid", F.col("e1").alias("uid")).unionByName(links.select("fid", F.col("e2").alias("uid")))
    orders = table(spark, d, "orders")
    beliefs = orders.select(F.concat(F.lit("O"), "o_orderkey").alias("uid"), F.lit(0.5).alias("belief"))
    seeds = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(F.concat(F.lit("O"), "k").alias("uid"))
    return paths.explain(m, links.select("fid", F.lit(1.0).alias("w")), beliefs, seeds).select("uid", "depth")


@query("h11_explanations", f"WITH RECURSIVE {LINKS}, bl AS (SELECT 'O' || o_orderkey AS uid, (o_orderkey * 31 % 97) / 100.0::DOUBLE AS belief FROM orders), sd AS (SELECT arg_min('O' || o_orderkey, (o_orderdate, o_orderkey)) AS uid FROM orders GROUP BY o_custkey), r AS (SELECT uid, 0 AS depth, [uid] AS nodes FROM sd UNION ALL SELECT e2, depth + 1, list_append(nodes, e2) FROM r JOIN links ON e1 = r.uid JOIN bl ON bl.uid = e2 WHERE depth < 4 AND belief >= 0.15), sh AS (SELECT uid, belief, nodes FROM r JOIN bl USING (uid) WHERE belief > 0.9 ORDER BY belief DESC, uid LIMIT 1000), al AS (SELECT false AS isolated, uid, belief, array_to_string(nodes, ' > ') AS path FROM sh UNION ALL SELECT true, uid, belief, uid FROM sd JOIN bl USING (uid) WHERE uid NOT IN (SELECT unnest(nodes) FROM sh)) SELECT row_number() OVER (ORDER BY isolated, belief DESC, uid) AS rank, uid, path, isolated FROM al ORDER BY rank LIMIT 1000")
def h11_report(spark, d):
    """A report of 1,000 rows: paths from customers' first orders to what is most believed, then seeds that lead nowhere."""
    links = follow_links(spark, d)
    m = links.select("fid", F.col("e1").alias("uid")).unionByName(links.select("fid", F.col("e2").alias("uid")))
    orders = table(spark, d, "orders")
    uid = F.concat(F.lit("O"), "o_orderkey")
    beliefs = orders.select(uid.alias("uid"), (F.col("o_orderkey") * 31 % 97 / 100).alias("belief"))
    seeds = orders.groupBy("o_custkey").agg(F.min_by(uid, F.struct("o_orderdate", "o_orderkey")).alias("uid"))
    reached = paths.explain(m, links.select("fid", F.lit(1.0).alias("w")), beliefs, seeds, 4, 0.15)
    return paths.explanations(reached, beliefs, seeds, 0.9, 1000)


_CHAIN = "st AS (SELECT o_custkey AS case_id, o_orderkey, row_number() OVER w AS pos, 'O' || o_orderkey AS subject, CASE WHEN o_orderstatus = 'P' THEN 'PART' ELSE 'FOLLOW' END AS relation, 'O' || lead(o_orderkey) OVER w AS object FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def chains(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.row_number().over(w).alias("pos"), F.concat(F.lit("O"), "o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "P", "PART").otherwise("FOLLOW").alias("relation"), F.concat(F.lit("O"), F.lead("o_orderkey").over(w)).alias("object"))
    return rows.filter("object is not null")


@query("h14_chain_check", f"WITH {_CHAIN} SELECT case_id, true AS linked, count(DISTINCT relation) = 1 AS one_relation, 'O' || max(o2) = arg_max(object, pos) AS answered FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY case_id) AS o2 FROM st) WHERE object IS NOT NULL GROUP BY 1")
def h14(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.max("o_orderkey").alias("k")).select("case_id", F.concat(F.lit("O"), "k").alias("answer"))
    return paths.chain_check(chains(spark, d), last)


@query("h12_proof_view", f"WITH {_CHAIN} SELECT case_id, string_agg(subject || ' ' || relation || ' ' || object, '; ' ORDER BY pos) AS view FROM st WHERE object IS NOT NULL GROUP BY 1")
def h12(spark, d):
    labels = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"), F.col("p_name").alias("label"))
    return paths.proof_view(chains(spark, d), labels)


@query("h13_full_trace", f"WITH {FACTS}, a AS (SELECT 'C' || c_custkey AS uid FROM customer WHERE c_acctbal > 9000), f AS (SELECT DISTINCT fid FROM inc WHERE uid IN (SELECT uid FROM a)) SELECT 'node' AS part, uid AS id FROM a UNION ALL SELECT 'factor', fid FROM f UNION ALL (SELECT DISTINCT 'relation', 'PURCHASE' FROM f) UNION ALL (SELECT DISTINCT 'event', time FROM facts WHERE fid IN (SELECT fid FROM f))")
def h13(spark, d):
    rows = facts(spark, d)
    active = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("C"), "c_custkey").alias("uid"))
    return paths.touched(members_of(spark, d), active, rows.withColumn("relation", F.lit("PURCHASE")), rows.select("fid", F.col("time").alias("event")))


@query("r7_message_trace", f"WITH {FACTS}, {PARAMS} SELECT run_id, a.fid, a.uid, round(least(1, greatest(0, x * f.w * f.confidence * CASE WHEN a.pos = 0 THEN f.forward ELSE f.backward END)), 6) AS sent FROM ev JOIN inc a ON a.uid = ev.uid JOIN fac f ON f.fid = a.fid WHERE ev.x > 0")
def r7(spark, d):
    sent = propagation.messages(members_of(spark, d), factors(facts(spark, d)), evidence(spark, d))
    return sent.select("run_id", "fid", "uid", F.round("sent", 6).alias("sent"))


@query("r10_query_eval", f"WITH {FACTS}, {PARAMS}, {steps_sql('linear', 2)}, a AS (SELECT run_id, uid, x FROM s2 WHERE x >= 0.05 AND uid LIKE 'P%'), g AS (SELECT DISTINCT run_id, object AS uid FROM facts JOIN ev ON subject = ev.uid WHERE w > 0.2), k AS (SELECT run_id, count(*) AS said, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.run_id = a.run_id AND g.uid = a.uid)) AS hit, arg_max(uid, (round(x, 9), uid)) AS answer FROM a GROUP BY 1) SELECT k.run_id, answer, said, hit, (SELECT count(*) FROM g WHERE g.run_id = k.run_id) AS wanted FROM k")
def r10(spark, d):
    """Does propagation from a region's customers light up the parts they bought in quantity? All questions run as one job."""
    rows = purchase_rows(spark, d)
    state = spread(spark, d, ("linear",), 2, ["object"], rows=rows).select("run_id", "uid", "x")
    lit_up = state.filter("x >= 0.05 and uid like 'P%'")
    asked = seeds(spark, d).select("run_id", F.col("node").alias("subject"))
    bought = rows.filter("w > 0.2").select("subject", "object").join(asked, "subject").select("run_id", "object").distinct()
    gold = bought.select("run_id", node_name(F.lit(1), F.col("object")).alias("uid"))
    judged = lit_up.join(gold.withColumn("hit", F.lit(1)), ["run_id", "uid"], "left")
    said = judged.groupBy("run_id").agg(F.max_by("uid", F.struct(F.round("x", 9).alias("x"), "uid")).alias("answer"), F.count("*").alias("said"), F.count("hit").alias("hit"))
    return said.join(gold.groupBy("run_id").agg(F.count("*").alias("wanted")), "run_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))


@query("q1_target_role", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'TIME' WHEN 2 THEN 'SUBJECT' ELSE 'OBJECT' END AS role FROM part")
def q1(spark, d):
    k = F.col("p_size") % 4
    asked = F.concat(F.when(k == 0, "Where is ").when(k == 1, "When came ").when(k == 2, "Who bought ").otherwise("Which is "), "p_name", F.lit("?"))
    return table(spark, d, "part").select("p_partkey", questions.target_role(asked).alias("role"))


@query("q2_query_terms", "SELECT question_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM (SELECT p_partkey AS question_id, lower(p_type) AS term, 1 AS pos FROM part UNION ALL SELECT p_partkey, lower(p_brand), 2 FROM part) GROUP BY 1")
def q2(spark, d):
    part = table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("Which "), "p_type", F.lit(" part of "), "p_brand", F.lit(" is an xx "), F.element_at(F.split("p_name", " "), 2)).alias("question"))
    labels = part.select(F.col("p_partkey").alias("question_id"), F.element_at(F.split("p_name", " "), 2).alias("label"))
    terms = questions.query_terms(asked, labels, ["which", "part", "of", "is", "an", "xx"])
    listed = terms.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("all"))
    return listed.select("question_id", F.array_join(F.col("all.term"), " ").alias("terms"))


_RELS = "rel AS (SELECT p_type AS relation, unnest(string_split(p_name, ' ')) AS term, false AS label FROM part UNION SELECT p_type, lower(p_type), true FROM part), q AS (SELECT p_partkey AS question_id, unnest(list_distinct([string_split(p_name, ' ')[1], lower(p_type)])) AS term FROM part), sc AS (SELECT question_id, relation, sum(CASE WHEN label THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) / any_value(n) AS score FROM q JOIN rel USING (term) JOIN (SELECT question_id, count(*) AS n FROM q GROUP BY 1) USING (question_id) GROUP BY 1, 2)"


def relation_scores(spark, d):
    part = table(spark, d, "part")
    docs = part.select(F.col("p_type").alias("relation"), F.explode(F.split("p_name", " ")).alias("term"), F.lit(False).alias("label")).union(part.select("p_type", F.lower("p_type"), F.lit(True))).distinct()
    terms = part.select(F.col("p_partkey").alias("question_id"), F.explode(F.array_distinct(F.array(F.split("p_name", " ")[0], F.lower("p_type")))).alias("term"))
    return questions.score_relations(terms, docs)


@query("q3_score_relations", f"WITH {_RELS} SELECT question_id, relation, round(score, 6) AS score FROM sc")
def q3(spark, d):
    return relation_scores(spark, d).withColumn("score", F.round("score", 6))


def _unit_sql(source: str) -> str:
    """Unit vectors ``k, slot, u`` of the hashed runs of 2, 3 and 4 characters of a source's texts ``k, t``."""
    grams = f"SELECT k, substr(' ' || lower(t) || ' ', i, n) AS g FROM (SELECT k, t, n, unnest(range(1, CAST(length(t) + 4 - n AS BIGINT))) AS i FROM {source}, (SELECT unnest([2, 3, 4]) AS n) WHERE length(t) >= 2)"
    slots = f"SELECT k, ('0x' || substr(md5(g), 1, 8))::UBIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(md5(g), 9, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM ({grams}) GROUP BY 1, 2"
    return f"(SELECT k, slot, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS u FROM ({slots}))"


@query("q3_vector_scores", f"WITH qs AS (SELECT p_partkey AS k, p_name AS t FROM part), ls AS (SELECT DISTINCT p_type AS k, p_type AS t FROM part), ds AS (SELECT p_type AS k, min(p_name) || ' ' || max(p_brand) AS t FROM part GROUP BY 1), w AS (SELECT k, slot, sum(u) AS u FROM (SELECT k, slot, 0.7::DOUBLE * u AS u FROM {_unit_sql('ls')} UNION ALL SELECT k, slot, 0.3::DOUBLE * u FROM {_unit_sql('ds')}) GROUP BY 1, 2), s AS (SELECT q.k AS question_id, w.k AS relation, sum(q.u * w.u) AS score FROM {_unit_sql('qs')} q JOIN w USING (slot) GROUP BY 1, 2), n AS (SELECT p_type AS relation, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) SELECT question_id, relation, round(score + CASE WHEN p_size > 25 AND p_type = relation THEN 0.08::DOUBLE * (1 - 1.0::DOUBLE / n) ELSE 0 END, 6) AS score FROM s JOIN n USING (relation) JOIN part ON p_partkey = question_id")
def q3_vectors(spark, d):
    """Part names ask for types by hashed runs of characters; large parts want a list of their own type's brands."""
    part = table(spark, d, "part")
    vectors = lambda df, key, said: text.hashed_ngrams(df, key, said, (2, 3, 4), 64, apart=True)
    labels = part.select(F.col("p_type").alias("relation"), F.col("p_type").alias("label")).distinct()
    docs = part.groupBy(F.col("p_type").alias("relation")).agg(F.concat(F.min("p_name"), F.lit(" "), F.max("p_brand")).alias("doc"))
    brands = part.groupBy(F.col("p_type").alias("relation")).agg(F.countDistinct("p_brand").alias("n"))
    kinds = part.filter("p_size > 25").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("relation")).join(F.broadcast(brands), "relation")
    asked = vectors(part.withColumnRenamed("p_partkey", "question_id"), "question_id", "p_name")
    scores = questions.score_relations_by_vectors(asked, vectors(labels, "relation", "label"), vectors(docs, "relation", "doc"), kinds)
    return scores.withColumn("score", F.round("score", 6))


@query("q4_plan", f"WITH {_RELS}, r AS (SELECT question_id, relation, round(score, 6) AS score, row_number() OVER w AS k, lead(round(score, 6)) OVER w AS second FROM sc WINDOW w AS (PARTITION BY question_id ORDER BY round(score, 6) DESC, relation)) SELECT question_id, relation FROM r WHERE k = 1 AND score >= 0.12 AND score - coalesce(second, 0) >= 0.025")
def q4(spark, d):
    return questions.choose(relation_scores(spark, d).withColumn("score", F.round("score", 6))).select("question_id", "relation")


@query("q5_decode", f"WITH {FACTS} SELECT c_custkey AS question_id, string_agg(DISTINCT object, ', ' ORDER BY object) AS answer, count(DISTINCT object) AS n FROM customer JOIN facts ON subject = 'C' || c_custkey GROUP BY 1")
def q5(spark, d):
    plans = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("C"), "c_custkey").alias("anchor"), F.lit("OBJECT").alias("role"))
    return questions.decode(plans, members_of(spark, d))


@query("q6_compose_answer", "SELECT c.c_custkey AS question_id, coalesce(a, CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'unknown') AS answer FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS a FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def q6(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "question_id")
    decoded = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("question_id")).agg(F.max("o_orderpriority").alias("answer"))
    return questions.compose(c, [decoded, c.filter("c_acctbal > 0").select("question_id", F.col("c_mktsegment").alias("answer"))]).select("question_id", "answer")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{5,}}'))"


@query("v7_retrieve", f"WITH q AS (SELECT item_id AS question_id, unnest({_WORDS.format('text')}) AS w FROM benchmark), c AS (SELECT doc_id AS chunk_id, unnest({_WORDS.format('text')}) AS w FROM documents) SELECT question_id, chunk_id, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, chunk_id) AS rank FROM (SELECT question_id, chunk_id, count(*) AS overlap FROM q JOIN c USING (w) GROUP BY 1, 2) WHERE overlap >= 2) WHERE rank <= 8")
def v7(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return questions.best_chunks(asked, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body")), 8)


@query("v9_answer_by_marker", r"SELECT question_id, arg_max(answer, turn) AS answer, max(turn) AS cited FROM (SELECT conv_id AS question_id, turn, trim(regexp_extract(text, '(?:the|die|la)\s+([^\s.,;:!?]+)', 1)) AS answer FROM conversations) WHERE answer <> '' GROUP BY 1")
def v9(spark, d):
    retrieved = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.col("turn").alias("id"), F.col("text").alias("body"))
    return questions.marked_answer(retrieved, "(?:the|die|la)")
