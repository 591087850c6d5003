"""Registered queries of lookups, role maps, recency, rules, sweeps, coverage and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import evaluation, graph, ingest, propagation, state, text
from .purchase import FACTS, PARAMS, ROLES, evidence, factors, facts, steps_sql, table
from .registered import members_of, query, spread


@query("f1_find_symbols", "SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#1') OR list_contains(string_split(p_name, ' '), 'bolt')")
def f1(spark, d):
    forms = F.split("p_name", " ")
    return table(spark, d, "part").filter(F.contains(F.lower("p_brand"), F.lit("#1")) | F.exists(forms, lambda f: F.lower(f) == "bolt")).select("p_partkey")


@query("f3_find_by_kind", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def f3(spark, d):
    meta = F.array(F.struct(F.lit("kind").alias("name"), F.col("p_type").alias("value")))
    return table(spark, d, "part").filter(F.exists(meta, lambda m: (m["name"] == "kind") & (m["value"] == "ECONOMY"))).select("p_partkey")


@query("f7_added_at", "SELECT p_partkey AS uid, coalesce(o.first, s.first, 0) AS added_at FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS first FROM lineitem WHERE l_quantity > 45 GROUP BY 1) o ON o.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1) s ON s.l_partkey = p_partkey")
def f7(spark, d):
    first = lambda df, name: df.groupBy(F.col("l_partkey").alias("uid")).agg(F.min("l_orderkey").alias(name))
    lines = table(spark, d, "lineitem")
    stamps = first(lines.filter("l_quantity > 45"), "a").join(first(lines, "b"), "uid", "full")
    return table(spark, d, "part").select(F.col("p_partkey").alias("uid")).join(stamps, "uid", "left").select("uid", F.coalesce("a", "b", F.lit(0)).alias("added_at"))


@query("f14_fold", r"SELECT p_partkey, trim(regexp_replace(translate(lower('  ' || p_brand || '__' || p_name || '-X '), '_-', '  '), '\s+', ' ', 'g')) AS folded FROM part")
def f14(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.fold(F.concat(F.lit("  "), "p_brand", F.lit("__"), "p_name", F.lit("-X "))).alias("folded"))


@query("j1_factor_event", f"WITH {FACTS}, e AS (SELECT 'D' || strftime(ts, '%Y%m%d') AS time, count(*) AS n FROM events GROUP BY 1) SELECT fid, coalesce(n, 0) AS n FROM facts LEFT JOIN e USING (time)")
def j1(spark, d):
    days = table(spark, d, "events").groupBy(F.concat(F.lit("D"), F.date_format("ts", "yyyyMMdd")).alias("time")).agg(F.count("*").alias("n"))
    return facts(spark, d).join(days, "time", "left").select("fid", F.coalesce("n", F.lit(0)).alias("n"))


@query("j11_role_map", f"WITH {FACTS} SELECT fid, CASE role WHEN 'SOURCE' THEN 'LOCATION' ELSE role END AS role, uid FROM inc")
def j11(spark, d):
    """The canonical role from a small map of roles; an unmapped role keeps its name."""
    mapping = spark.createDataFrame([(role, "LOCATION") for _, role in ROLES if role == "SOURCE"], "role string, canonical string")
    return members_of(spark, d).join(F.broadcast(mapping), "role", "left").select("fid", F.coalesce("canonical", "role").alias("role"), "uid")


_TIER = "t AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 0 WHEN contains(text, '?') THEN 2 ELSE 1 END AS tier, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS recent FROM conversations)"


@query("w5_tiered_recency", f"WITH {_TIER} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tier, turn DESC, role) AS k FROM t WHERE tier = 0 OR recent <= 4) WHERE k <= 6")
def w5(spark, d):
    tier = F.when(F.col("role") == "system", 0).when(F.contains("text", F.lit("?")), 2).otherwise(1)
    recent = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.col("turn").desc()))
    rows = table(spark, d, "conversations").withColumn("tier", tier).withColumn("recent", recent).filter("tier = 0 or recent <= 4")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("tier", F.col("turn").desc(), "role"))
    return rows.withColumn("k", k).filter("k <= 6").select("conv_id", "turn")


@query("w6_scored_recall", "SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id DESC) AS k FROM (SELECT user_id, event_id, round(value / 10 + CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 20 ELSE 0 END, 6) AS score FROM events) WHERE score >= 3) WHERE k <= 16")
def w6(spark, d):
    bonus = F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "signup", 20).otherwise(0)
    scored = table(spark, d, "events").withColumn("score", F.round(F.col("value") / 10 + bonus, 6)).filter("score >= 3")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("event_id").desc()))
    return scored.withColumn("k", k).filter("k <= 16").select("user_id", "event_id", "score")


@query("w11_top_n_report", f"WITH {FACTS}, {PARAMS}, {steps_sql('linear', 2)} SELECT run_id, uid FROM (SELECT run_id, uid, row_number() OVER (PARTITION BY run_id ORDER BY round(x, 9) DESC, uid) AS k FROM s2) WHERE k <= 12")
def w11(spark, d):
    x = spread(spark, d, ("linear",), 2)
    k = F.row_number().over(Window.partitionBy("run_id").orderBy(F.round("x", 9).desc(), "uid"))
    return x.withColumn("k", k).filter("k <= 12").select("run_id", "uid")


@query("b31_param_sweep", " UNION ALL ".join(f"SELECT * FROM (WITH {FACTS}, {PARAMS}, {steps_sql(kernel, 2)} SELECT '{kernel}' AS kernel, threshold, run_id, count(*) FILTER (round(x, 9) >= threshold) AS spread, round(max(x), 6) AS peak FROM s2, (SELECT unnest([0.05::DOUBLE, 0.3::DOUBLE, 0.7::DOUBLE]) AS threshold) GROUP BY 2, 3)" for kernel in ("linear", "relu")))
def b31(spark, d):
    """Kernels times thresholds; thresholds share the propagation of their kernel, runs and kernels share the job."""
    x = spread(spark, d, ("linear", "relu"), 2).withColumn("r", F.round("x", 9))
    thresholds = (0.05, 0.3, 0.7)
    runs = x.groupBy("kernel", "run_id").agg(F.round(F.max("x"), 6).alias("peak"), F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("r") >= t).alias("spread")) for t in thresholds]).alias("all"))
    return runs.select("kernel", "run_id", "peak", F.explode("all").alias("at")).select("kernel", "at.threshold", "run_id", "at.spread", "peak")


@query("b5_damp", "SELECT p_partkey, round(0.6::DOUBLE * p_size / 50 + 0.4::DOUBLE * 0.5, 9) AS message FROM part")
def b5(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(fn.damp(F.lit(0.5), F.col("p_size") / 50, 0.4), 9).alias("message"))


_FLAGS = "SELECT p_partkey, p_size % 2 = 0 AS d, p_size % 3 = 0 AS s, p_size % 5 = 0 AS t, p_size % 7 = 0 AS c, p_size % 11 = 0 AS st FROM part"


@query("g6_factor_params", f"SELECT p_partkey, round(least(1, 0.5 + CASE WHEN c THEN 0.2 ELSE 0 END + CASE WHEN st THEN 0.1 ELSE 0 END), 6)::DOUBLE AS transmission, CASE WHEN t THEN 0.05 ELSE 0.1 END::DOUBLE AS decay, CASE WHEN d AND NOT s THEN 0.9 ELSE 0.5 END::DOUBLE AS directionality, CASE WHEN c THEN 0.75 ELSE 0.5 END::DOUBLE AS selectivity FROM ({_FLAGS})")
def g6(spark, d):
    flags = [F.col("p_size") % k == 0 for k in (2, 3, 5, 7, 11)]
    params = graph.rule_params(*flags)
    return table(spark, d, "part").select("p_partkey", *[F.round(params[c], 6).alias(c) for c in ("transmission", "decay", "directionality", "selectivity")])


@query("g7_project_params", "SELECT vec_id, k, round(1 / (1 + exp(-(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((i - 1) * (k + 1)) % 7 - 3) / 10.0::DOUBLE)) + k / 10.0::DOUBLE))), 6) AS p FROM embeddings, (SELECT unnest(range(7)) AS k)")
def g7(spark, d):
    """Seven parameters from a vector: logistic of a fixed 7 by 64 matrix times it, plus a bias."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("k"))
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * ((i * (F.col("k") + 1)) % 7 - 3) / F.lit(10.0))
    z = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) + F.col("k") / F.lit(10.0)
    return rows.select("vec_id", "k", F.round(fn.logistic(z), 6).alias("p"))


@query("a3_relation_docs", "SELECT p_brand AS label, string_agg(part, ' | ' ORDER BY spot, part) AS doc FROM (SELECT p_brand, part, min(pos) AS spot FROM (SELECT p_brand, p_name AS part, 1 AS pos FROM part UNION ALL SELECT p_brand, p_type, 0 FROM part) GROUP BY 1, 2) GROUP BY 1")
def a3(spark, d):
    part = table(spark, d, "part")
    parts = part.select("p_brand", F.col("p_name").alias("part"), F.lit(1).alias("pos")).unionByName(part.select("p_brand", F.col("p_type").alias("part"), F.lit(0).alias("pos")))
    first = parts.groupBy("p_brand", "part").agg(F.min("pos").alias("pos"))
    docs = first.groupBy(F.col("p_brand").alias("label")).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("all"))
    return docs.select("label", F.array_join(F.col("all.part"), " | ").alias("doc"))


@query("v2_ngram_counts", "WITH g AS (SELECT p_partkey, substr(' ' || lower(p_name) || ' ', i, 3) AS g FROM (SELECT p_partkey, p_name, unnest(range(1, CAST(length(p_name) + 1 AS BIGINT))) AS i FROM part)) SELECT p_partkey, CAST(('0x' || substr(md5(g), 1, 8))::UBIGINT % 64 AS BIGINT) AS slot, count(*) AS v FROM g GROUP BY 1, 2")
def v2(spark, d):
    return text.hashed_ngrams(table(spark, d, "part"), "p_partkey", "p_name", (3,), 64, signed=False, apart=True)


@query("v3_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v3(spark, d):
    e = table(spark, d, "embeddings")
    ahead = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(ahead, "vec_id").select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("next")), 5).alias("similarity"))


@query("s1_expand_rules", "SELECT event_id AS seq, 'set' AS op, 'OWNS:u' || user_id AS key, event_type AS value FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'append', 'LOG:u' || user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def s1(spark, d):
    """Rules per event type, from the types that the table holds."""
    e = table(spark, d, "events")
    kinds = e.select(F.col("event_type").alias("relation")).distinct()
    rule = lambda df, op, key: df.select("relation", F.lit(op).alias("op"), F.lit(key).alias("key"), F.lit("{OBJECT}").alias("value"))
    rules = rule(kinds.filter("relation = 'purchase'"), "set", "OWNS:{SUBJECT}").unionByName(rule(kinds.filter("relation in ('purchase', 'signup')"), "append", "LOG:{SUBJECT}"))
    rows = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("relation"), F.create_map(F.lit("SUBJECT"), F.concat(F.lit("u"), "user_id"), F.lit("OBJECT"), F.col("event_type")).alias("roles"))
    return state.expand_rules(rows, rules).filter("not missing").drop("missing")


@query("s5_factual_only", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'R'")
def s5(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "proposal").when(F.col("l_returnflag") == "A", "assertion").otherwise("decision")
    return table(spark, d, "lineitem").filter(kind.isin(*ingest.FACTUAL)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("t8_coverage_audit", "SELECT p_partkey AS part_id, CASE p_size % 3 WHEN 0 THEN 'sentence' WHEN 1 THEN 'list_item' ELSE 'clause' END AS kind, (p_partkey % 4 > 0)::BIGINT AS support, CASE WHEN p_partkey % 4 = 0 THEN false WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN true ELSE p_partkey % 4 > 1 END AS covered FROM part")
def t8(spark, d):
    """A part's two-word name is the segment; its candidate names one word or both."""
    part = table(spark, d, "part")
    k = F.col("p_size") % 3
    parts = part.select(F.col("p_partkey").alias("part_id"), F.when(k == 0, "sentence").when(k == 1, "list_item").otherwise("clause").alias("kind"), F.col("p_name").alias("body"))
    head = F.split("p_name", " ")[0]
    cands = part.filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("part_id"), F.col("p_partkey").alias("cand_id"), F.create_map(F.lit("SUBJECT"), F.when(F.col("p_partkey") % 4 == 1, head).otherwise(F.col("p_name"))).alias("roles"))
    return ingest.coverage(parts, cands)


@query("t9_infer_list_items", "SELECT p_partkey AS part_id, 'HAS' AS relation, p_brand AS subject, p_name AS object FROM part WHERE p_size > 25")
def t9(spark, d):
    """Each brand is a list of its parts; the smaller ones have candidates."""
    part = table(spark, d, "part")
    items = part.select(F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("part_id"), F.col("p_name").alias("body"))
    known = part.filter("p_size <= 25").select(F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("part_id"), F.lit("HAS").alias("relation"), F.create_map(F.lit("SUBJECT"), F.col("p_brand"), F.lit("OBJECT"), F.col("p_name")).alias("roles"))
    return ingest.infer_list_items(items, known).select("part_id", "relation", F.element_at("roles", "SUBJECT").alias("subject"), F.element_at("roles", "OBJECT").alias("object"))


@query("t30_rag_corpus", "SELECT p_brand AS graph_id, md5(string_agg(p_name, chr(10) || chr(10) ORDER BY seq)) AS digest FROM (SELECT p_brand, p_name, min(p_partkey) AS seq FROM part GROUP BY 1, 2) GROUP BY 1")
def t30(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("graph_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("line"))
    return ingest.corpus(parts).select("graph_id", F.md5("body").alias("digest"))


@query("a21_paired_report", "WITH a AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS x FROM orders WHERE o_orderpriority < '3' GROUP BY 1), b AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS x FROM orders WHERE o_orderpriority >= '3' GROUP BY 1) SELECT c_mktsegment, count(*) AS n, round(avg(a.x - b.x), 6) AS delta FROM customer JOIN a ON a.o_custkey = c_custkey JOIN b ON b.o_custkey = c_custkey GROUP BY 1")
def a21(spark, d):
    arm = F.when(F.col("o_orderpriority") < "3", "a").otherwise("b").alias("arm")
    scored = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), arm).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("x"))
    both = evaluation.paired(scored, "c_custkey", "arm", ("a", "b"), ["x"]).filter("x_delta is not null").join(table(spark, d, "customer"), "c_custkey")
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("x_delta"), 6).alias("delta"))
