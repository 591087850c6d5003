"""Further registered queries: lookups, joins, sets, metrics, factor-graph parts, vectors, text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import belief, ranking, state_stream, text
from .purchase import FACTS, LINKS, facts, follow_links, table
from .registered import ORACLES, members_of, query

_LINK_TABLE = f"{LINKS}, p AS (SELECT 'P' || p_partkey AS e1, p_brand AS e2, 'IS-A' AS t FROM part UNION ALL SELECT e1, e2, 'FOLLOW' FROM links)"


def typed_links(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("e1"), F.col("p_brand").alias("e2"), F.lit("IS-A").alias("t"))
    return parts.unionByName(follow_links(spark, d).select("e1", "e2", F.lit("FOLLOW").alias("t")))


@query("f4_find_links", f"WITH {_LINK_TABLE} SELECT u.uid, e1, e2, t FROM p JOIN (SELECT 'O' || o_orderkey AS uid FROM orders WHERE o_orderpriority = '5-LOW') u ON e1 = uid OR e2 = uid")
def f4(spark, d):
    wanted = table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(F.concat(F.lit("O"), "o_orderkey").alias("uid"))
    ends = typed_links(spark, d).select(F.explode(F.array_distinct(F.array("e1", "e2"))).alias("uid"), "e1", "e2", "t")
    return ends.join(wanted, "uid")


@query("f8_edges_of_type", f"WITH {_LINK_TABLE} SELECT e1, e2 FROM p WHERE t = 'IS-A'")
def f8(spark, d):
    return typed_links(spark, d).filter("t = 'IS-A'").select("e1", "e2")


@query("f9_eligible_factors", f"WITH {FACTS} SELECT fid, 'PURCHASE' AS label FROM facts WHERE fid IN (SELECT fid FROM inc WHERE uid IN (SELECT 'C' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def f9(spark, d):
    anchors = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), "c_custkey").alias("uid"))
    return members_of(spark, d).join(anchors, "uid", "left_semi").select("fid").distinct().withColumn("label", F.lit("PURCHASE"))


@query("f10_node_label", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, list_min(string_split(p_name, ' ')), lower(replace(p_brand, '#', ' '))) AS label FROM part")
def f10(spark, d):
    label = F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.array_min(F.split("p_name", " ")), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))))
    return table(spark, d, "part").select("p_partkey", label.alias("label"))


@query("f13_keyword_hit", "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'token') AS hit FROM documents")
def f13(spark, d):
    keywords = F.array(F.lit("license"), F.lit("token"))
    return table(spark, d, "documents").select("doc_id", F.exists(keywords, lambda k: F.contains(F.lower("text"), k)).alias("hit"))


@query("j2_both_ends", f"WITH {LINKS}, ok AS (SELECT 'O' || o_orderkey AS uid FROM orders WHERE o_orderstatus <> 'F') SELECT fid, e1, e2 FROM links WHERE e1 IN (SELECT uid FROM ok) AND e2 IN (SELECT uid FROM ok)")
def j2(spark, d):
    ok = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.concat(F.lit("O"), "o_orderkey").alias("uid"))
    links = follow_links(spark, d)
    return links.join(ok, links.e1 == ok.uid, "left_semi").join(ok.withColumnRenamed("uid", "end"), F.col("e2") == F.col("end"), "left_semi").select("fid", "e1", "e2")


@query("j4_missing_support", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j4(spark, d):
    got = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(got, "c_custkey", "left_anti")


@query("j9_carry_over", "SELECT p.p_partkey AS uid, coalesce(o.x, 0.5) AS x FROM part p LEFT JOIN (SELECT l_partkey, max(l_discount) AS x FROM lineitem WHERE l_quantity > 45 GROUP BY 1) o ON p.p_partkey = o.l_partkey")
def j9(spark, d):
    old = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("uid")).agg(F.max("l_discount").alias("x"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("uid")).join(old, "uid", "left").select("uid", F.coalesce("x", F.lit(0.5)).alias("x"))


@query("u3_variables", f"WITH {FACTS} SELECT DISTINCT uid FROM inc UNION SELECT 'C' || c_custkey FROM customer")
def u3(spark, d):
    return members_of(spark, d).select("uid").union(table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey"))).distinct()


@query("g1_factor_counts", f"WITH {FACTS}, {LINKS} SELECT 'hyper' AS kind, count(*) AS n FROM facts UNION ALL SELECT 'pair', count(*) FROM links UNION ALL SELECT 'prior', count(*) FROM (SELECT uid FROM inc UNION SELECT e1 FROM links UNION SELECT e2 FROM links) UNION ALL SELECT 'obs', count(*) FROM (SELECT * FROM customer WHERE c_acctbal > 9000)")
def g1(spark, d):
    links = follow_links(spark, d)
    uids = members_of(spark, d).select("uid").union(links.select("e1")).union(links.select("e2")).distinct()
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(facts(spark, d), "hyper").union(count(links, "pair")).union(count(uids, "prior")).union(count(table(spark, d, "customer").filter("c_acctbal > 9000"), "obs"))


@query("g2_link_potential", f"WITH {_LINK_TABLE} SELECT e1, e2, CASE WHEN t = 'IS-A' THEN 'is_a' WHEN t = 'FOLLOW' THEN 'follow' ELSE 'assoc' END AS potential FROM p")
def g2(spark, d):
    return typed_links(spark, d).select("e1", "e2", F.when(F.col("t") == "IS-A", "is_a").when(F.col("t") == "FOLLOW", "follow").otherwise("assoc").alias("potential"))


_MSG = "m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(1, l_quantity / 50) AS p, l_discount * 10 AS w, l_linenumber % 2 AS pos FROM lineitem)"


def _pull(name: str, potential: str, strength_sql: str):
    @query(name, f"WITH {_MSG} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(0.5 + (p - 0.5) * {strength_sql}, 9) AS sent FROM m")
    def run(spark, d):
        m = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.least(F.lit(1.0), F.col("l_quantity") / 50).alias("p"), (F.col("l_discount") * 10).alias("w"), (F.col("l_linenumber") % 2).alias("pos"))
        sent = fn.pulled(F.col("p"), belief.strength(F.lit(potential), F.col("w"), F.col("pos")))
        return m.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(sent, 9).alias("sent"))


_pull("b8_assoc", "assoc", "least(1, w * 0.4)")
_pull("b9_bind", "bind", "least(1, w * 0.8)")
_pull("b10_is_a", "is_a", "least(1, w * CASE WHEN pos = 1 THEN 0.9 ELSE 0.2 END)")
_pull("b11_follow", "follow", "least(1, w * CASE WHEN pos = 1 THEN 0.8 ELSE 0.1 END)")


@query("b3_evidence_likelihood", "SELECT c_custkey, round(1 / (1 + exp(-least(50, greatest(0, c_acctbal / 1000)))), 9) AS p FROM customer")
def b3(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(fn.logistic(fn.clip(F.col("c_acctbal") / 1000, 0.0, 50.0)), 9).alias("p"))


@query("b32_scalar_decay", "SELECT event_id, round(value * exp(-0.1 * (event_id % 17)), 6) AS x FROM events")
def b32(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * F.exp(-0.1 * (F.col("event_id") % 17)), 6).alias("x"))


@query("w4_mrr", "SELECT round(avg(coalesce(rr, 0)), 6) AS mrr FROM (SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 / k END) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) GROUP BY 1)")
def w4(spark, d):
    ranked = table(spark, d, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")))
    best = ranked.groupBy("c_nationkey").agg(F.max(F.when(F.col("c_mktsegment") == "BUILDING", 1.0 / F.col("k"))).alias("rr"))
    return best.agg(F.round(F.avg(F.coalesce("rr", F.lit(0.0))), 6).alias("mrr"))


@query("w9_retain_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 24")
def w9(spark, d):
    return ranking.top_k(table(spark, d, "events"), ["user_id"], [F.col("event_id").desc()], 24).select("user_id", "event_id")


@query("a2_mode_counts", "SELECT p_type AS mode, count(*) AS n FROM part GROUP BY 1")
def a2(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("mode")).agg(F.count("*").alias("n"))


@query("a5_modal_relation", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1 AND n >= 2")
def a5(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ranking.keep_first(counts, ["user_id"], [F.col("n").desc(), F.col("event_type")]).filter("n >= 2").select("user_id", "event_type", "n")


@query("a6_varying_role", f"WITH {FACTS}, c AS (SELECT subject, count(DISTINCT object) AS OBJECT, count(DISTINCT source) AS SOURCE, count(DISTINCT time) AS TIME FROM facts GROUP BY 1) SELECT subject, CASE WHEN OBJECT >= SOURCE AND OBJECT >= TIME THEN 'OBJECT' WHEN SOURCE >= TIME THEN 'SOURCE' ELSE 'TIME' END AS role, greatest(OBJECT, SOURCE, TIME) AS fillers FROM c WHERE greatest(OBJECT, SOURCE, TIME) > 1")
def a6(spark, d):
    c = facts(spark, d).groupBy("subject").agg(*[F.countDistinct(x.lower()).alias(x) for x in ("OBJECT", "SOURCE", "TIME")])
    most = F.greatest("OBJECT", "SOURCE", "TIME")
    role = F.when(F.col("OBJECT") == most, "OBJECT").when(F.col("SOURCE") == most, "SOURCE").otherwise("TIME")
    return c.select("subject", role.alias("role"), most.alias("fillers")).filter("fillers > 1")


@query("a25_finite_average", "SELECT user_id, round(avg(1.0 / nullif(value, 0)), 6) AS mean FROM events GROUP BY user_id")
def a25(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when(F.col("value") != 0, 1.0 / F.col("value"))), 6).alias("mean"))


@query("a34_conflicting_rows", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def a34(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct(F.struct("l_partkey", "l_suppkey")).alias("n")).filter("n > 1").drop("n")


@query("h5_duplicate_properties", "SELECT p_partkey FROM part WHERE len(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) <> len(string_split(p_name || ' ' || lower(p_type), ' '))")
def h5(spark, d):
    names = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    return table(spark, d, "part").filter(F.size(names) != F.size(F.array_distinct(names))).select("p_partkey")


@query("h7_modality_overlap", "SELECT tok FROM (SELECT unnest(string_split(p_name, ' ')) AS tok, p_type FROM part) GROUP BY tok HAVING count(DISTINCT p_type) > 1")
def h7(spark, d):
    forms = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tok"), "p_type")
    return forms.groupBy("tok").agg(F.countDistinct("p_type").alias("n")).filter("n > 1").select("tok")


@query("v1_ngram_embed", "WITH g AS (SELECT p_partkey, n, substr(' ' || lower(p_name) || ' ', i, n) AS g FROM (SELECT p_partkey, p_name, n, unnest(range(1, CAST(length(p_name) + 4 - n AS BIGINT))) AS i FROM part, (SELECT unnest([2, 3, 4]) AS n)) WHERE i + n <= length(p_name) + 3), s AS (SELECT p_partkey, ('0x' || substr(md5(g), 1, 8))::UBIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(md5(g), 9, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM g GROUP BY 1, 2) SELECT p_partkey, CAST(slot AS BIGINT) AS slot, CAST(v AS BIGINT) AS v FROM s WHERE v <> 0")
def v1(spark, d):
    return text.hashed_ngrams(table(spark, d, "part"), "p_partkey", "p_name", (2, 3, 4), 64, apart=True)


@query("t22_epistemic_weight", "SELECT conv_id, turn, CAST(round(0.5 * CASE WHEN role = 'system' THEN 0.55 WHEN contains(text, '?') THEN 0.5 WHEN role = 'assistant' THEN 0.4 ELSE 1.0 END, 4) AS DOUBLE) AS w FROM conversations")
def t22(spark, d):
    w = F.when(F.col("role") == "system", 0.55).when(F.col("text").contains("?"), 0.5).when(F.col("role") == "assistant", 0.4).otherwise(1.0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(0.5 * w, 4).alias("w"))


@query("s7_state_stream", ORACLES["s2_fold_set_delete"])
def s7(spark, d):
    """Set and delete operations folded by a stream; same rows as the batch fold once the input is drained."""
    return state_stream.drain(spark, f"{d}/events.parquet")
