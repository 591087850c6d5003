"""The purchase hypergraph over the test tables, in DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..operators import graph

ROLES = [("subject", "SUBJECT"), ("object", "OBJECT"), ("source", "SOURCE"), ("time", "TIME")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, part and supplier, with its quantity and the order. Lines are dealt by order once, for their sums and for the join."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase per order, part and supplier, with its weight."""
    return lines(spark, sf_dir).select(
        F.concat(F.lit("F"), "l_orderkey", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey").alias("fid"),
        F.concat(F.lit("C"), "o_custkey").alias("subject"),
        F.concat(F.lit("P"), "l_partkey").alias("object"),
        F.concat(F.lit("S"), "l_suppkey").alias("source"),
        F.concat(F.lit("D"), F.date_format("o_orderdate", "yyyyMMdd")).alias("time"),
        F.least(F.lit(1.0), F.col("quantity") / 200.0).alias("w"),
    )


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`facts` with numbers for nodes, the day's for a time, in place of names (see :func:`node_name`)."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    number = lambda c: F.col(c).cast("long")
    return lines(spark, sf_dir).select(number("o_custkey").alias("subject"), number("l_partkey").alias("object"), number("l_suppkey").alias("source"), day.alias("time"), F.least(F.lit(1.0), F.col("quantity") / 200.0).alias("w"))


def node_name(role: Column, node: Column) -> Column:
    """The name of a node by its role's place in :data:`ROLES` and its number."""
    day = F.date_format(F.date_from_unix_date(node.cast("int")), "yyyyMMdd")
    return F.concat(kind_name(role), F.when(role == 3, day).otherwise(node.cast("string")))


def kind_name(role: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in "CPSD"]), role + 1)


def factors(rows: DataFrame, *keep: str) -> DataFrame:
    """Purchases as directional, temporal, state-changing factors with rule-based parameters, and columns to ``keep``."""
    return parameters(rows.select("fid", *keep, "w"))


def parameters(rows: DataFrame) -> DataFrame:
    flags = rows.select("*", F.lit(0.9).alias("confidence"), F.lit(True).alias("directional"), F.lit(False).alias("symmetric"), F.lit(True).alias("temporal"), F.lit(False).alias("causal"), F.lit(True).alias("state_changing"))
    params = graph.rule_params(*[F.col(c) for c in ("directional", "symmetric", "temporal", "causal", "state_changing")])
    return graph.with_transmission(flags.withColumns(params))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each region: all of its customers, each as active as its balance says."""
    return seeds(spark, sf_dir).select("run_id", F.concat(F.lit("C"), "node").alias("uid"), "x")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`evidence` with the role's place and the customer's number."""
    of = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("r_name").alias("run_id"), F.lit(0).alias("role"), F.col("c_custkey").cast("long").alias("node"), (clip(F.col("c_acctbal") / 10000) * 0.05).alias("x"))


def follow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of a customer: ``fid, e1, e2``."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("next")).filter("next is not null")
    return orders.select(F.concat(F.lit("L"), "o_orderkey").alias("fid"), F.concat(F.lit("O"), "o_orderkey").alias("e1"), F.concat(F.lit("O"), "next").alias("e2"))


FACTS = """facts AS (
  SELECT 'F' || l_orderkey || '_' || l_partkey || '_' || l_suppkey AS fid, 'C' || any_value(o_custkey) AS subject, 'P' || l_partkey AS object,
         'S' || l_suppkey AS source, 'D' || strftime(any_value(o_orderdate), '%Y%m%d') AS time, least(1.0::DOUBLE, sum(l_quantity) / 200.0::DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, l_suppkey
), inc AS (
  SELECT fid, subject AS uid, 0 AS pos, 'SUBJECT' AS role FROM facts UNION ALL SELECT fid, object, 1, 'OBJECT' FROM facts
  UNION ALL SELECT fid, source, 2, 'SOURCE' FROM facts UNION ALL SELECT fid, time, 3, 'TIME' FROM facts
)"""
# transmission 0.6 x (0.95 or 0.05) x bias 1.8, within [0, 1]; decay 0.05; selectivity 0.5
PARAMS = """fac AS (SELECT fid, w, 0.9::DOUBLE AS confidence, 1.0::DOUBLE AS forward, (0.6::DOUBLE * (0.5::DOUBLE * (1 - 0.9::DOUBLE)) * 1.8::DOUBLE) AS backward, 0.5::DOUBLE AS selectivity, 0.05::DOUBLE AS decay FROM facts
), ev AS (SELECT r_name AS run_id, 'C' || c_custkey AS uid, least(1, greatest(0, c_acctbal / 10000)) * 0.05::DOUBLE AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LINKS = """links AS (
  SELECT 'L' || o_orderkey AS fid, 'O' || o_orderkey AS e1, 'O' || next AS e2
  FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL
)"""


def steps_sql(kernel: str, steps: int = 3) -> str:
    """Unrolled steps s1..sN over pairs of members, from ev."""
    out = ["s0 AS (SELECT run_id, uid, x FROM ev)"]
    for k in range(1, steps + 1):
        linear = "least(1, greatest(0, s.x * f.w * f.confidence * CASE WHEN a.pos = 0 THEN f.forward ELSE f.backward END))"
        sent = {"linear": linear, "sigmoid": f"1 / (1 + exp(-8 * ({linear} - f.selectivity)))", "relu": f"least(1, greatest(0, {linear} - 0.25 * f.selectivity))"}[kernel]
        out.append(
            f"m{k} AS (SELECT s.run_id, b.uid, sum({sent}) AS z FROM s{k - 1} s JOIN inc a ON s.uid = a.uid JOIN fac f ON a.fid = f.fid JOIN inc b ON b.fid = a.fid AND b.uid <> a.uid WHERE s.x > 0 GROUP BY 1, 2)"
        )
        out.append(f"s{k} AS (SELECT run_id, uid, x FROM (SELECT coalesce(s.run_id, m.run_id) AS run_id, coalesce(s.uid, m.uid) AS uid, least(1, greatest(0, coalesce(s.x, 0) * 0.95::DOUBLE + coalesce(m.z, 0))) AS x FROM s{k - 1} s FULL JOIN m{k} m ON s.run_id = m.run_id AND s.uid = m.uid) WHERE x > 1e-15)")
    return ", ".join(out)
