"""Registered queries of single kernels, signatures, role names, exact labels and catalogs of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import graph, ingest, propagation, vectors
from ..operators import resolution as er
from .purchase import FACTS, PARAMS, factors, facts, table
from .registered import members_of, query
from .resolution import _CAT, _REL, _SAY, label, mentions

_LINEAR = "least(1, greatest(0, x * f.w * f.confidence * CASE WHEN inc.pos = 0 THEN f.forward ELSE f.backward END))"
_SENT = {"linear": _LINEAR, "sigmoid": f"1 / (1 + exp(-8 * ({_LINEAR} - f.selectivity)))", "relu": f"least(1, greatest(0, {_LINEAR} - 0.25 * f.selectivity))"}


def _kernel(no: int, name: str):
    @query(f"r{no}_kernel_{name}", f"WITH {FACTS}, {PARAMS}, st AS (SELECT 'C' || c_custkey AS uid, least(1, greatest(0, c_acctbal / 10000)) AS x FROM customer) SELECT inc.fid, uid, round({_SENT[name]}, 12) AS sent FROM st JOIN inc USING (uid) JOIN fac f ON f.fid = inc.fid WHERE x > 0")
    def run(spark, d):
        x = fn.clip(F.col("c_acctbal") / 10000)
        state = table(spark, d, "customer").select(F.lit("r").alias("run_id"), F.concat(F.lit("C"), "c_custkey").alias("uid"), x.alias("x"))
        sent = propagation.messages(members_of(spark, d), factors(facts(spark, d)), state, name)
        return sent.select("fid", "uid", F.round("sent", 12).alias("sent"))


for _no, _name in enumerate(_SENT, 1):
    _kernel(_no, _name)


@query("r4_kernel_decay", f"WITH {FACTS}, {PARAMS}, st AS (SELECT 'C' || c_custkey AS uid, least(1, greatest(0, c_acctbal / 10000)) AS x FROM customer), goods AS (SELECT 'P' || p_partkey AS uid, p_size FROM part) SELECT facts.fid, facts.object AS uid, round(least(1, greatest(0, p_size / 50 * (1 - f.decay) + least(1, greatest(0, x * f.w * f.confidence * f.forward)))), 10) AS x FROM facts JOIN fac f ON f.fid = facts.fid JOIN st ON st.uid = facts.subject JOIN goods ON goods.uid = facts.object WHERE x > 0".replace("facts AS (", "facts AS MATERIALIZED (", 1))
def r4(spark, d):
    """Customers send, parts keep what their size gave them less the decay."""
    x = fn.clip(F.col("c_acctbal") / 10000)
    state = table(spark, d, "customer").select(F.lit("r").alias("run_id"), F.concat(F.lit("C"), "c_custkey").alias("uid"), x.alias("x"))
    rows = facts(spark, d)
    params = factors(rows)
    sent = propagation.messages(members_of(spark, d), params, state).select("fid", "sent")
    targets = rows.select("fid", F.col("object").alias("uid")).join(table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"), (F.col("p_size") / 50).alias("target")), "uid")
    met = sent.join(targets, "fid").join(params.select("fid", "decay"), "fid")
    return met.select("fid", "uid", F.round(propagation.decayed(F.col("target"), F.col("decay"), F.col("sent")), 10).alias("x"))


@query("g4_structural_signature", f"WITH {FACTS} SELECT source AS graph_id, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(inc.fid || '|' || uid || '|' || pos || '|' || role), 1, 8)) AS UBIGINT)) AS BIGINT) AS total FROM inc JOIN facts ON inc.fid = facts.fid GROUP BY 1")
def g4(spark, d):
    """Each supplier's purchases are a graph."""
    rows = facts(spark, d).withColumn("graph_id", F.col("source"))
    members = graph.incidence(rows, [("subject", "SUBJECT"), ("object", "OBJECT"), ("source", "SOURCE"), ("time", "TIME")], keep=("graph_id",))
    return graph.signature(members, ("graph_id",)).withColumnRenamed("signature", "total")


@query("e7_prefix_proximity", f"WITH {_CAT}, {_SAY}, p AS (SELECT mention_id, f, lower(p_brand || ' ' || p_name) AS key FROM fol JOIN part ON p_partkey = mention_id), q AS (SELECT *, greatest(length(f), length(key)) AS n, abs(length(f) - length(key)) AS gap FROM p) SELECT mention_id, CASE WHEN (starts_with(f, key) OR starts_with(key, f)) AND gap <= 3 THEN 0.9 WHEN gap <= 2 AND left(f, greatest(4, ceil(0.8 * n))::INT) = left(key, greatest(4, ceil(0.8 * n))::INT) THEN 0.85 ELSE 0 END::DOUBLE AS score FROM q")
def e7(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.lower(label()).alias("key"))
    return mentions(spark, d).join(names, "mention_id").select("mention_id", er.proximity(fn.fold(F.col("mention")), F.col("key")).alias("score"))


@query("n3_normalize_exact", f"WITH r AS (SELECT DISTINCT p_type || ' ' || p_name AS raw FROM part), k AS (SELECT raw, {_REL.format('raw')} AS key FROM r), a AS (SELECT DISTINCT {_REL.format(chr(39) + 'small ' + chr(39) + ' || p_name')} AS key, {_REL.format('p_name')} AS via FROM part), o AS (SELECT DISTINCT {_REL.format(chr(39) + 'large ' + chr(39) + ' || p_name')} AS key FROM part) SELECT raw, coalesce(via, k.key) AS canonical, 1.0::DOUBLE AS confidence FROM k LEFT JOIN a USING (key) LEFT JOIN o USING (key) WHERE via IS NOT NULL OR o.key IS NOT NULL")
def n3(spark, d):
    part = table(spark, d, "part")
    aliases = part.select(F.concat(F.lit("Small "), "p_name").alias("alias"), fn.canonical_label(F.col("p_name")).alias("canonical")).distinct()
    known = part.select(fn.canonical_label(F.concat(F.lit("Large "), "p_name")).alias("canonical")).distinct()
    return er.normalize_exact(part.select(F.concat("p_type", F.lit(" "), "p_name").alias("raw")), aliases, known)


@query("n8_similar_relations", "SELECT q, vec_id FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS k, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE k <= 5 AND s >= 0.3")
def n8(spark, d):
    """The relations most like each one."""
    near = vectors.knn_within(table(spark, d, "embeddings"), 5)
    return near.filter(F.round("similarity", 6) >= 0.3).select("q", "vec_id")


@query("t14_normalize_roles", "SELECT p_partkey AS cand_id, p_brand AS subject, p_name AS object, CASE WHEN p_size % 2 = 0 THEN p_type END AS beside FROM part WHERE p_size % 5 <> 0")
def t14(spark, d):
    """Names by alias, fillers with brackets on even sizes, compound fillers on sizes of five."""
    filler = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" and more"))).when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" (with "), "p_type", F.lit(")"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("cand_id"), F.create_map(F.lit("agent"), F.col("p_brand"), F.lit("Object"), filler, F.lit("junk"), F.lit("x")).alias("roles"))
    done = ingest.normalize_roles(rows, {"AGENT": "SUBJECT"}, ("SUBJECT", "OBJECT"))
    role = lambda name: F.try_element_at("roles", F.lit(name))
    return done.select("cand_id", role("SUBJECT").alias("subject"), role("OBJECT").alias("object"), role("WITH").alias("beside"))


@query("io9_graph_catalog", f"WITH {FACTS} SELECT source AS graph_id, count(*) AS facts, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, round(max(w), 6) AS strongest FROM facts GROUP BY 1")
def io9(spark, d):
    """One line of statistics for each supplier's graph."""
    return facts(spark, d).groupBy(F.col("source").alias("graph_id")).agg(F.count("*").alias("facts"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"), F.round(F.max("w"), 6).alias("strongest"))
