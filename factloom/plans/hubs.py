"""Registered queries over graphs with hubs: a node and a factor that hold a fifth of all rows each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..operators import belief, propagation
from ..runtime import cut_lineage
from .purchase import table
from .registered import bp_sql, first_orders, query

#: Rows above which the queries deal a key; far below the library's own, so that small tables have hubs as well.
HUB_ROWS = 500

_LINKS = "links AS (SELECT 'L' || o_orderkey AS fid, 'O' || o_orderkey AS e1, o_orderpriority AS e2 FROM orders)"


@query("b2_hub_beliefs", f"WITH {_LINKS}, {bp_sql(2)} SELECT uid, round(belief, 6) AS belief, round(x, 6) AS x FROM n2")
def b2(spark, d):
    """Every order is followed by its priority, a node that hears from a fifth of all orders."""
    ends = F.array(F.struct(F.concat(F.lit("O"), "o_orderkey").alias("uid"), F.lit(0).alias("pos")), F.struct(F.col("o_orderpriority").alias("uid"), F.lit(1).alias("pos")))
    links = table(spark, d, "orders").select(F.concat(F.lit("L"), "o_orderkey").alias("fid"), F.explode(ends).alias("m"))
    members = links.select("fid", "m.*", F.lit("follow").alias("potential"), F.lit(1.0).alias("w"))
    return belief.run(members, first_orders(spark, d), ticks=2, hub_rows=HUB_ROWS).select("uid", F.round("belief", 6).alias("belief"), F.round("x", 6).alias("x"))


def _steps(steps: int) -> str:
    out = ["s0 AS (SELECT 'C' || c_custkey AS uid, least(1, greatest(0, c_acctbal / 10000)) * 0.05::DOUBLE AS x FROM customer)"]
    for k in range(1, steps + 1):
        out += [
            f"a{k} AS (SELECT fid, uid, least(1, x * w * CASE WHEN pos = 0 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) AS sent FROM s{k - 1} JOIN inc USING (uid) WHERE x > 0)",
            f"t{k} AS (SELECT fid, sum(sent) AS total FROM a{k} GROUP BY 1)",
            f"z{k} AS (SELECT uid, sum(total - coalesce(sent, 0)) AS z FROM t{k} JOIN inc USING (fid) LEFT JOIN a{k} USING (fid, uid) GROUP BY 1)",
            f"s{k} AS (SELECT * FROM (SELECT uid, least(1, greatest(0, coalesce(x, 0) * 0.95::DOUBLE + greatest(0, coalesce(z, 0)))) AS x FROM s{k - 1} FULL JOIN z{k} USING (uid)) WHERE x > 1e-15)",
        ]
    return ", ".join(out)


@query("r5_hub_spread", f"WITH inc AS (SELECT 'L' || o_orderkey AS fid, 'C' || o_custkey AS uid, 0 AS pos, 1.0::DOUBLE AS w FROM orders UNION ALL SELECT 'L' || o_orderkey, 'O' || o_orderkey, 1, 1.0::DOUBLE FROM orders UNION ALL SELECT 'H' || o_orderpriority, 'O' || o_orderkey, 1, 0.0001::DOUBLE FROM orders UNION ALL SELECT DISTINCT 'H' || o_orderpriority, o_orderpriority, 0, 0.0001::DOUBLE FROM orders), {_steps(3)} SELECT uid, round(x, 9) AS x FROM s3")
def r5(spark, d):
    """Customers activate their orders, and these each other through one factor per priority, which has a fifth of all orders."""
    orders = table(spark, d, "orders")
    order, priority = F.concat(F.lit("O"), "o_orderkey"), F.col("o_orderpriority")
    link, hub = F.concat(F.lit("L"), "o_orderkey"), F.concat(F.lit("H"), priority)
    row = lambda fid, uid, pos, w: F.struct(fid.alias("fid"), uid.alias("uid"), F.lit(pos).alias("pos"), F.lit(w).alias("w"))
    rows = orders.select(F.explode(F.array(row(link, F.concat(F.lit("C"), "o_custkey"), 0, 1.0), row(link, order, 1, 1.0), row(hub, order, 1, 0.0001))).alias("m")).select("m.*")
    rows = cut_lineage(rows.unionByName(orders.select(hub.alias("fid"), priority.alias("uid"), F.lit(0).alias("pos"), F.lit(0.0001).alias("w")).distinct()))
    fixed = {"confidence": 1.0, "forward": 0.5, "backward": 0.1, "selectivity": 0.5, "decay": 0.05}
    factors = rows.select("fid", "w").distinct().withColumns({c: F.lit(v) for c, v in fixed.items()})
    start = table(spark, d, "customer").select(F.lit("all").alias("run_id"), F.concat(F.lit("C"), "c_custkey").alias("uid"), (clip(F.col("c_acctbal") / 10000) * 0.05).alias("x"))
    members = rows.drop("w")
    return propagation.propagate(members, factors, start, 3, hubs=propagation.hubs_of(members, HUB_ROWS)).select("uid", F.round("x", 9).alias("x"))
