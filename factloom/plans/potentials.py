"""Registered queries of a tick's single steps and of sweeps over belief parameters, over consecutive orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import logistic
from ..operators import belief, evaluation
from .inference import _STATES, states
from .purchase import LINKS, table
from .registered import first_orders, follow_members, query

_START = f"{LINKS}, mem AS (SELECT fid, e1 AS uid, 0 AS pos FROM links UNION ALL SELECT fid, e2, 1 FROM links), mid AS (SELECT fid, uid, pos, 0.5::DOUBLE AS v, (CAST(substr(uid, 2) AS BIGINT) * 37 % 97 + 1) / 98.0::DOUBLE AS f, CAST(substr(uid, 2) AS BIGINT) % 4 AS lam FROM mem)"


def midway(spark, d):
    """Messages as they may stand between ticks, and evidence, from the numbers in the names."""
    number = F.substring("uid", 2, 20).cast("long")
    messages = follow_members(spark, d).select(F.lit("r").alias("run_id"), "fid", "uid", "pos", "potential", "w", F.lit(0.5).alias("v2f"), ((number * 37 % 97 + 1) / F.lit(98.0)).alias("f2v"))
    nodes = messages.select("run_id", "uid", (number % 4).cast("double").alias("lam")).distinct()
    return messages, nodes


@query("b1_init", f"WITH {LINKS}, mem AS (SELECT fid, e1 AS uid, 0 AS pos FROM links UNION ALL SELECT fid, e2, 1 FROM links) SELECT run_id, fid, uid, pos, 0.5::DOUBLE AS v2f, 0.5::DOUBLE AS f2v FROM mem, (SELECT r_name AS run_id FROM region)")
def b1(spark, d):
    runs = table(spark, d, "region").select(F.col("r_name").alias("run_id"))
    return belief.init(follow_members(spark, d), runs).select("run_id", "fid", "uid", "pos", "v2f", "f2v")


@query("b2_var_to_factor", f"WITH {_START} SELECT fid, uid, round(0.6::DOUBLE / (1 + exp(-(lam + sum(ln(f / (1 - f))) OVER (PARTITION BY uid) - ln(f / (1 - f))))) + 0.4::DOUBLE * v, 6) AS v2f FROM mid")
def b2(spark, d):
    return belief.to_factor(*midway(spark, d)).select("fid", "uid", F.round("v2f", 6).alias("v2f"))


_KINDS = "CASE WHEN CAST(substr(fid, 2) AS BIGINT) % 3 = 0 THEN 'follow' WHEN CAST(substr(fid, 2) AS BIGINT) % 3 = 1 THEN 'is_a' ELSE 'other' END"


@query("b4_factor_to_var", f"WITH {_START}, k AS (SELECT *, {_KINDS} AS kind, CAST(substr(fid, 2) AS BIGINT) % 5 / 4.0::DOUBLE AS gate FROM mid), o AS (SELECT *, sum(f) OVER (PARTITION BY fid) - f AS other FROM k) SELECT fid, uid, round(0.6::DOUBLE * (0.5 + gate * (other - 0.5) * CASE kind WHEN 'follow' THEN CASE WHEN pos = 1 THEN 0.8 ELSE 0.1 END WHEN 'is_a' THEN CASE WHEN pos = 1 THEN 0.9 ELSE 0.2 END ELSE 0.4 END) + 0.4::DOUBLE * v, 6) AS f2v FROM o")
def b4(spark, d):
    """Every factor's own potential, an unknown one as an association, under gates."""
    number = F.substring("fid", 2, 20).cast("long")
    kind = F.when(number % 3 == 0, "follow").when(number % 3 == 1, "is_a").otherwise("other")
    messages = midway(spark, d)[0].withColumns({"v2f": F.col("f2v"), "f2v": F.lit(0.5), "potential": kind, "gate": number % 5 / F.lit(4.0)})
    return belief.to_member(messages).select("fid", "uid", F.round("f2v", 6).alias("f2v"))


@query("b6_prior", "SELECT c_custkey, round(greatest(1e-12, c_acctbal / 5000) / (1 + greatest(1e-12, c_acctbal / 5000)), 9) AS message FROM customer")
def b6(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(belief.prior(F.col("c_acctbal") / 5000), 9).alias("message"))


@query("b7_observed", "SELECT c_custkey, round(1 / (1 + exp(-least(50, c_acctbal / 100))), 9) AS message FROM customer")
def b7(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(belief.observed(F.col("c_acctbal") / 100), 9).alias("message"))


@query("b22_competition_modes", f"WITH {_STATES}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY x DESC, uid) AS k FROM st) SELECT 'top_k' AS kind, run_id, uid, round(CASE WHEN k <= 3 THEN x ELSE 0 END, 9) AS x FROM k UNION ALL SELECT 'none', run_id, uid, round(x, 9) FROM st")
def b22(spark, d):
    s = states(spark, d)
    kept = [belief.compete(s, kind, k=3).select(F.lit(kind).alias("kind"), "run_id", "uid", F.round("x", 9).alias("x")) for kind in ("top_k", "none")]
    return kept[0].unionByName(kept[1])


_HEARD = "hd AS (SELECT uid, any_value(lam) AS lam, sum(ln(f / (1 - f))) AS odds, sum(greatest(0, 2 * f - 1)) AS z FROM mid GROUP BY 1)"


def heard(spark, d):
    messages, nodes = midway(spark, d)
    return belief.received(messages).join(nodes, ["run_id", "uid"])


@query("b17_beliefs", f"WITH {_START}, {_HEARD} SELECT uid, round(1 / (1 + exp(-(lam + odds))), 6) AS belief FROM hd")
def b17(spark, d):
    return heard(spark, d).select("uid", F.round(logistic(F.col("lam") + F.col("odds")), 6).alias("belief"))


@query("b18_incoming_signal", f"WITH {_START}, {_HEARD} SELECT uid, round(z, 6) AS z FROM hd")
def b18(spark, d):
    return heard(spark, d).select("uid", F.round("z", 6).alias("z"))


@query("b19_activation_update", f"WITH {_START}, {_HEARD}, a AS (SELECT uid, z, 1 - exp(-lam) AS e, lam / 4.0::DOUBLE AS x FROM hd) SELECT uid, round(least(1, greatest(0, 0.9 * x + 0.5 * z + e)), 6) AS linear, round(1 / (1 + exp(-(x + z + e))), 6) AS sigmoid, round(least(1, greatest(0, 0.9 * x + 0.5 * greatest(0, z + e))), 6) AS relu FROM a")
def b19(spark, d):
    args = (F.col("lam") / 4, F.col("z"), 1 - F.exp(-F.col("lam")), F.lit(0.5), F.lit(0.1))
    return heard(spark, d).select("uid", *[F.round(belief.activate(F.lit(name), *args), 6).alias(name) for name in belief.ACTIVATIONS])


_GRID = "grid AS (SELECT activation || '_' || decay || '_' || association AS run_id, * FROM (SELECT unnest(['linear', 'sigmoid', 'relu']) AS activation), (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS decay), (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS association))"


def _sweep_sql(ticks: int) -> str:
    out = [
        "mem AS (SELECT fid, e1 AS uid, 0 AS pos FROM links UNION ALL SELECT fid, e2, 1 FROM links)",
        "seed AS (SELECT 'O' || arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS uid, 3.0::DOUBLE AS lam FROM orders GROUP BY o_custkey)",
        "m0 AS (SELECT run_id, association, fid, uid, pos, 0.5::DOUBLE AS v, 0.5::DOUBLE AS f FROM mem, grid)",
        "n0 AS (SELECT run_id, activation, decay, uid, coalesce(lam, 0.0) AS lam, 0.0::DOUBLE AS x FROM (SELECT DISTINCT uid FROM mem) CROSS JOIN grid LEFT JOIN seed USING (uid))",
    ]
    for k in range(1, ticks + 1):
        p = k - 1
        out += [
            f"d{k} AS (SELECT run_id, activation, decay, uid, x, CASE WHEN lam * 0.5 < 1e-6 THEN 0 ELSE lam * 0.5 END AS lam FROM n{p})",
            f"v{k} AS (SELECT m.run_id, association, fid, m.uid, pos, f, 0.6 / (1 + exp(-(lam + sum(ln(f / (1 - f))) OVER (PARTITION BY m.run_id, m.uid) - ln(f / (1 - f))))) + 0.4 * v AS v FROM m{p} m JOIN d{k} d ON m.uid = d.uid AND m.run_id = d.run_id)",
            f"m{k} AS (SELECT run_id, association, fid, uid, pos, v, 0.6 * (0.5 + (sum(v) OVER (PARTITION BY run_id, fid) - v - 0.5) * association) + 0.4 * f AS f FROM v{k})",
            f"z{k} AS (SELECT run_id, uid, sum(greatest(0, 2 * f - 1)) AS z FROM m{k} GROUP BY 1, 2)",
            f"n{k} AS (SELECT d.*, x AS x0, CASE activation WHEN 'linear' THEN least(1, greatest(0, (1 - decay) * x + 0.5 * z + 1 - exp(-lam))) WHEN 'sigmoid' THEN 1 / (1 + exp(-(x + z + 1 - exp(-lam)))) ELSE least(1, greatest(0, (1 - decay) * x + 0.5 * greatest(0, z + 1 - exp(-lam)))) END AS x1 FROM d{k} d JOIN z{k} USING (run_id, uid))",
        ]
        out[-1] = f"n{k} AS (SELECT * EXCLUDE (x0, x1, x), x1 AS x FROM ({out[-1][len(f'n{k} AS ('):-1]}))"
    return ", ".join(out)


_HISTORY = " UNION ALL ".join(f"SELECT run_id, {k} AS tick, uid, x FROM n{k}" for k in (1, 2))


@query("b31_belief_sweep", f"WITH {LINKS}, {_GRID}, {_sweep_sql(2)}, h AS ({_HISTORY}), t AS (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS threshold) SELECT run_id, threshold, round(max(x), 6) AS peak, min(tick) FILTER (round(x, 9) >= threshold) AS latency, count(*) FILTER (tick = 2 AND round(x, 9) >= threshold) AS spread FROM h, t GROUP BY 1, 2")
def b31_belief(spark, d):
    """81 settings of activation, decay, association and threshold: 27 runs in one job, three thresholds in one pass over their history."""
    import itertools

    names, rates, shares = ("linear", "sigmoid", "relu"), (0.01, 0.05, 0.1), (0.2, 0.5, 0.8)
    rows = [(f"{a}_{r}_{s}", a, r, s) for a, r, s in itertools.product(names, rates, shares)]
    grid = spark.createDataFrame(rows, "run_id string, activation string, decay double, association double")
    members = follow_members(spark, d).withColumn("potential", F.lit("assoc"))
    history = belief.sweep(members, first_orders(spark, d).select("uid", "lam"), grid, 2).withColumn("x", F.round("x", 9))
    return evaluation.outcomes(history, (0.5, 0.7, 0.9), 2).withColumn("peak", F.round("peak", 6)).select("run_id", "threshold", "peak", "latency", "spread")
