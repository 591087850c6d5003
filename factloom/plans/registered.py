"""Registered queries of the operators over the test tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import analysis, belief, graph, propagation, ranking, state
from ..runtime import cut_lineage, written
from .purchase import FACTS, LINKS, PARAMS, ROLES, evidence, fact_rows, factors, facts, follow_links, node_name, parameters, seeds, steps_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def members_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.incidence(facts(spark, d), ROLES)


# --- factor graph -------------------------------------------------------------------------------------------------


@query("g3_incidence_degree", f"WITH {FACTS} SELECT uid, count(*) AS degree, count(DISTINCT role) AS roles FROM inc GROUP BY uid")
def g3(spark, d):
    return members_of(spark, d).groupBy("uid").agg(F.count("*").alias("degree"), F.countDistinct("role").alias("roles"))


@query("g5_transmission", f"WITH {FACTS}, {PARAMS} SELECT a.role AS source_role, b.role AS target_role, count(*) AS n, round(sum(f.w * CASE WHEN a.pos = 0 THEN f.forward ELSE f.backward END), 4) AS passed FROM inc a JOIN inc b ON a.fid = b.fid AND a.pos <> b.pos JOIN fac f ON f.fid = a.fid GROUP BY 1, 2")
def g5(spark, d):
    rows = facts(spark, d)
    m = graph.incidence(rows, ROLES).join(factors(rows), "fid")
    together = m.groupBy("fid", "w", "forward", "backward").agg(F.collect_list(F.struct("pos", "role")).alias("all"))
    pairs = together.select("*", F.explode("all").alias("a")).select("w", "forward", "backward", "a", F.explode("all").alias("b")).filter("a.pos <> b.pos")
    passed = F.col("w") * F.when(F.col("a.pos") == 0, F.col("forward")).otherwise(F.col("backward"))
    return pairs.groupBy(F.col("a.role").alias("source_role"), F.col("b.role").alias("target_role")).agg(F.count("*").alias("n"), F.round(F.sum(passed), 4).alias("passed"))


@query("g8_fact_mesh", f"WITH {FACTS} SELECT least(a.uid, b.uid) AS e1, greatest(a.uid, b.uid) AS e2, round(arg_min(w, f.fid), 6) AS w FROM inc a JOIN inc b ON a.fid = b.fid AND a.uid < b.uid JOIN facts f ON f.fid = a.fid GROUP BY 1, 2")
def g8(spark, d):
    rows = facts(spark, d)
    return graph.row_mesh(graph.together(rows, ROLES, keep=("w",))).select("e1", "e2", F.round("w", 6).alias("w"))


@query("j5_role_mesh", f"WITH {FACTS} SELECT DISTINCT a.fid, a.uid AS e1, b.uid AS e2 FROM inc a JOIN inc b ON a.fid = b.fid AND a.uid < b.uid")
def j5(spark, d):
    return graph.co_members(members_of(spark, d), most=len(ROLES))


@query("j5_wide_mesh", "WITH rm AS (SELECT DISTINCT p_brand AS fid, 'P' || p_partkey AS uid FROM part UNION SELECT 'all', 'N' || n_nationkey FROM nation) SELECT a.fid, a.uid AS e1, b.uid AS e2 FROM rm a JOIN rm b ON a.fid = b.fid AND a.uid < b.uid")
def j5_wide(spark, d):
    """A brand is a factor whose members are its parts, in tiles of some 512 members."""
    parts = table(spark, d, "part").select(F.col("p_brand").alias("fid"), F.concat(F.lit("P"), "p_partkey").alias("uid"))
    nations = table(spark, d, "nation").select(F.lit("all").alias("fid"), F.concat(F.lit("N"), "n_nationkey").alias("uid"))
    return graph.co_members(parts.unionByName(nations))


@query("g10_neighbours", f"WITH {FACTS} SELECT a.uid, count(DISTINCT b.uid) AS n FROM inc a JOIN inc b ON a.fid = b.fid AND a.uid <> b.uid GROUP BY 1")
def g10(spark, d):
    return graph.row_neighbours(graph.together(facts(spark, d), ROLES))


@query("g9_bind_edges", "SELECT DISTINCT 'T_' || tok AS e1, 'P' || p_partkey AS e2, 1.0::DOUBLE AS w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part)")
def g9(spark, d):
    tokens = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tok"))
    return tokens.select(F.concat(F.lit("T_"), "tok").alias("e1"), F.concat(F.lit("P"), "p_partkey").alias("e2"), F.lit(1.0).alias("w")).distinct()


# --- propagation --------------------------------------------------------------------------------------------------


def purchases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame | None, DataFrame | None]]:
    """Members, factors and hubs of the purchases, which are written once: every step reads them several times."""
    rows = written(factors(facts(spark, d), *[c for c, _ in ROLES]).select("fid", *[c for c, _ in ROLES], "w", "confidence", "forward", "backward", "selectivity", "decay"))
    members = graph.incidence(rows, ROLES)
    return members, rows, propagation.hubs_of(members, most=len(ROLES))


def purchase_rows(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as rows of numbered nodes, written once."""
    return written(parameters(fact_rows(spark, d)).select(*[c for c, _ in ROLES], "w", "confidence", "forward", "backward", "selectivity", "decay"))


def spread(spark: SparkSession, d: str, kernels: tuple[str, ...], steps: int = 3, wanted: list[str] | None = None, every: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """``kernel, run_id, step, uid, x`` of the purchases (see :func:`propagation.propagate_rows`); ``wanted`` roles after the last step."""
    start = seeds(spark, d)
    runs = [r.run_id for r in start.select("run_id").distinct().limit(propagation.WIDE + 1).collect()]
    if not 0 < len(runs) * len(kernels) <= propagation.WIDE:
        return _spread_members(spark, d, kernels, steps, every)
    rows = (purchase_rows(spark, d) if rows is None else rows).filter("object is not null and source is not null")  # others have no name
    out = propagation.propagate_rows(rows, [c for c, _ in ROLES], start, runs, steps, kernels, wanted, every)
    return out.select("kernel", "run_id", "step", node_name(F.col("role"), F.col("node")).alias("uid"), "x")


def _spread_members(spark: SparkSession, d: str, kernels: tuple[str, ...], steps: int, every: bool) -> DataFrame:
    """:func:`spread` for any number of runs, all roles, over members."""
    (members, params, hubs), out = purchases(spark, d), None
    for kernel in kernels:
        state = evidence(spark, d)
        for step in range(1, steps + 1):
            state = propagation.propagate(members, params, state, 1, kernel, hubs, apart=True)
            state = cut_lineage(state) if step < steps else state
            if every or step == steps:
                now = state.select(F.lit(kernel).alias("kernel"), "run_id", F.lit(step).alias("step"), "uid", "x")
                out = now if out is None else out.unionByName(now)
    return out


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parts that each region's customers activate most."""
    parts = spread(spark, d, ("linear",), wanted=["object"]).filter(F.col("uid").startswith("P"))
    return ranking.top_k(parts, ["run_id"], [F.round("x", 6).desc(), F.col("uid")], 10).select("run_id", "uid", F.round("x", 6).alias("x"), "rank")


QUERIES["r5_purchase_parts"] = flagship
ORACLES["r5_purchase_parts"] = f"WITH {FACTS}, {PARAMS}, {steps_sql('linear')} SELECT run_id, uid, x, rank FROM (SELECT run_id, uid, round(x, 6) AS x, row_number() OVER (PARTITION BY run_id ORDER BY round(x, 6) DESC, uid) AS rank FROM s3 WHERE uid LIKE 'P%') WHERE rank <= 10"
for _kernel in ("linear", "sigmoid", "relu"):
    QUERIES[f"r5_propagate_{_kernel}"] = lambda spark, d, k=_kernel: spread(spark, d, (k,), 2).select("run_id", "uid", F.round("x", 12).alias("x")).filter("x > 0")
    ORACLES[f"r5_propagate_{_kernel}"] = f"WITH {FACTS}, {PARAMS}, {steps_sql(_kernel, 2)} SELECT run_id, uid, round(x, 12) AS x FROM s2 WHERE round(x, 12) > 0"


@query("r6_mean_decay", f"WITH {FACTS}, {PARAMS} SELECT uid, round(avg(decay), 6) AS decay FROM inc JOIN fac USING (fid) GROUP BY uid")
def r6(spark, d):
    rows = facts(spark, d)
    return propagation.mean_decay(graph.incidence(rows, ROLES), factors(rows)).select("uid", F.round("decay", 6).alias("decay"))


@query("r8_activated", f"WITH {FACTS}, {PARAMS}, {steps_sql('linear', 2)} SELECT run_id, substr(uid, 1, 1) AS kind, count(*) AS n FROM s2 WHERE x >= 0.1 GROUP BY 1, 2")
def r8(spark, d):
    return spread(spark, d, ("linear",), 2).filter("x >= 0.1").groupBy("run_id", F.substring("uid", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


# --- belief propagation -------------------------------------------------------------------------------------------


def follow_members(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(F.struct(F.col("e1").alias("uid"), F.lit(0).alias("pos")), F.struct(F.col("e2").alias("uid"), F.lit(1).alias("pos")))
    return follow_links(spark, d).select("fid", F.explode(ends).alias("m"), F.lit("follow").alias("potential"), F.lit(1.0).alias("w")).select("fid", "m.*", "potential", "w")


def first_orders(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return firsts.select(F.lit("all").alias("run_id"), F.concat(F.lit("O"), "f.o_orderkey").alias("uid"), F.lit(3.0).alias("lam"))


def bp_sql(ticks: int) -> str:
    """Unrolled ticks of follow factors with damping 0.4; m: messages, n: nodes."""
    out = [
        "mem AS (SELECT fid, e1 AS uid, 0 AS pos FROM links UNION ALL SELECT fid, e2, 1 FROM links)",
        "seed AS (SELECT 'O' || arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS uid, 3.0::DOUBLE AS lam FROM orders GROUP BY o_custkey)",
        "m0 AS (SELECT fid, uid, pos, 0.5::DOUBLE AS v, 0.5::DOUBLE AS f FROM mem)",
        "n0 AS (SELECT uid, coalesce(lam, 0.0) AS lam, 0.5::DOUBLE AS belief, 0.0::DOUBLE AS x FROM (SELECT DISTINCT uid FROM mem) LEFT JOIN seed USING (uid))",
    ]
    for k in range(1, ticks + 1):
        p = k - 1
        out += [
            f"d{k} AS (SELECT uid, x, CASE WHEN lam * 0.5 < 1e-6 THEN 0 ELSE lam * 0.5 END AS lam FROM n{p})",
            f"v{k} AS (SELECT fid, m.uid, pos, f, 0.6 / (1 + exp(-(lam + sum(ln(f / (1 - f))) OVER (PARTITION BY m.uid) - ln(f / (1 - f))))) + 0.4 * v AS v FROM m{p} m JOIN d{k} d ON m.uid = d.uid)",
            f"m{k} AS (SELECT fid, uid, pos, v, 0.6 * (0.5 + (sum(v) OVER (PARTITION BY fid) - v - 0.5) * CASE WHEN pos = 1 THEN 0.8 ELSE 0.1 END) + 0.4 * f AS f FROM v{k})",
            f"n{k} AS (SELECT d.uid, lam, 1 / (1 + exp(-(lam + sum(ln(f / (1 - f)))))) AS belief, least(1, greatest(0, 0.9 * any_value(x) + 0.5 * sum(greatest(0, 2 * f - 1)) + (1 - exp(-lam)))) AS x FROM d{k} d JOIN m{k} m ON d.uid = m.uid GROUP BY d.uid, lam)",
        ]
    return ", ".join(out)


@query("b26_belief_follow", f"WITH {LINKS}, {bp_sql(3)} SELECT 'all' AS run_id, uid, round(belief, 6) AS belief, round(x, 6) AS x FROM n3")
def b26(spark, d):
    return belief.run(follow_members(spark, d), first_orders(spark, d), ticks=3, cut_every=2).select("run_id", "uid", F.round("belief", 6).alias("belief"), F.round("x", 6).alias("x"))


@query("b20_compete_global", "WITH t AS (SELECT n_name AS run_id, c_custkey AS uid, least(1, greatest(0, c_acctbal / 10000)) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT run_id, uid, round(least(1, greatest(0, x - 0.2 * (sum(x) OVER (PARTITION BY run_id) - x) / greatest(1, count(*) OVER (PARTITION BY run_id) - 1))), 13) AS x FROM t")
def b20(spark, d):
    t = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("run_id"), F.col("c_custkey").alias("uid"), fn.clip(F.col("c_acctbal") / 10000).alias("x"))
    return belief.compete_global(t).select("run_id", "uid", F.round("x", 13).alias("x"))


@query("b27_seed_evidence", "SELECT uid, round(sum(lam), 6) AS lam FROM (SELECT 'P' || l_partkey AS uid, 3 * least(1, greatest(0.1, l_discount)) AS lam FROM lineitem UNION ALL SELECT 'M_P' || l_partkey, 0.8 * 3 * least(1, greatest(0.1, l_discount)) FROM lineitem) GROUP BY uid HAVING sum(lam) >= 0.05")
def b27(spark, d):
    base = table(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("uid"), (3 * fn.clip(F.col("l_discount"), 0.1, 1.0)).alias("lam"))
    both = base.unionByName(base.select(F.concat(F.lit("M_"), "uid").alias("uid"), (0.8 * F.col("lam")).alias("lam")))
    return both.groupBy("uid").agg(F.round(F.sum("lam"), 6).alias("lam")).filter("lam >= 0.05")


@query("b29_hebb_update", f"WITH {LINKS} SELECT fid, round(CASE WHEN x1 * x2 > 0.1 THEN least(1, 0.5 + 0.1 * x1 * x2) ELSE 0.5 END, 6) AS w FROM (SELECT fid, least(1, a.o_totalprice / 500000) AS x1, least(1, b.o_totalprice / 500000) AS x2 FROM links JOIN orders a ON e1 = 'O' || a.o_orderkey JOIN orders b ON e2 = 'O' || b.o_orderkey)")
def b29(spark, d):
    x = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("uid"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("x"))
    both = follow_links(spark, d).join(x.select(F.col("uid").alias("e1"), F.col("x").alias("x1")), "e1").join(x.select(F.col("uid").alias("e2"), F.col("x").alias("x2")), "e2")
    product = F.col("x1") * F.col("x2")
    return both.select("fid", F.round(F.when(product > 0.1, fn.clip(0.5 + 0.1 * product)).otherwise(0.5), 6).alias("w"))


# --- graph analysis -----------------------------------------------------------------------------------------------


@query("h1_reachable", f"WITH RECURSIVE {LINKS}, e AS (SELECT e1, e2 FROM links UNION SELECT e2, e1 FROM links), r(uid, hops) AS (SELECT 'O' || o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e2, hops + 1 FROM r JOIN e ON uid = e1 WHERE hops < 4) SELECT uid, min(hops) AS hops FROM r GROUP BY uid")
def h1(spark, d):
    roots = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), "o_orderkey").alias("uid"))
    return analysis.reachable(follow_links(spark, d), roots, max_hops=4)


@query("h1_reachable_whole", f"WITH RECURSIVE {LINKS}, e AS (SELECT e1, e2 FROM links UNION SELECT e2, e1 FROM links), far AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)), r(uid, hops) AS (SELECT 'O' || min(o_orderkey), 0 FROM orders GROUP BY o_custkey UNION SELECT e2, hops + 1 FROM r JOIN e ON uid = e1 WHERE hops < (SELECT n FROM far)) SELECT uid, min(hops) AS hops FROM r GROUP BY uid")
def h1_whole(spark, d):
    """Chains are followed to their ends from one order of each customer."""
    roots = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("O"), F.min("o_orderkey")).alias("uid")).select("uid")
    return analysis.reachable(follow_links(spark, d), roots)


@query("h2_orphans", "SELECT 'P' || p_partkey AS uid FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND l_quantity >= 46)")
def h2(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    nodes = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("uid"))
    links = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey", "o_custkey").agg(F.max(F.when((F.col("l_returnflag") != "R") & (F.col("l_quantity") >= 46), 1.0).otherwise(0.0)).alias("w"))
    links = links.select(F.concat(F.lit("P"), "l_partkey").alias("e1"), F.concat(F.lit("C"), "o_custkey").alias("e2"), "w")
    roots = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("uid"))
    return analysis.orphans(nodes, links, roots)


@query("h4_has_cycle", f"WITH RECURSIVE {LINKS}, both_ways AS (SELECT e1, e2 FROM links UNION SELECT e2, e1 FROM links), r(a, b) AS (SELECT e1, e2 FROM links UNION SELECT a, e2 FROM r JOIN links ON b = e1), s(a, b) AS (SELECT e1, e2 FROM both_ways UNION SELECT a, e2 FROM s JOIN both_ways ON b = e1) SELECT 'follow' AS edges, EXISTS (SELECT 1 FROM r WHERE a = b) AS cyclic UNION ALL SELECT 'follow and back', EXISTS (SELECT 1 FROM s WHERE a = b)")
def h4(spark, d):
    links = follow_links(spark, d)
    return spark.createDataFrame([("follow", analysis.has_cycle(links)), ("follow and back", analysis.has_cycle(links.select("e1", "e2").unionByName(links.select(F.col("e2").alias("e1"), F.col("e1").alias("e2")))))], "edges string, cyclic boolean")


@query("h6_dangling", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def h6(spark, d):
    return analysis.dangling(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("h8_uniqueness", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def h8(spark, d):
    return analysis.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey")


@query("h10_is_a_closure", "WITH e AS (SELECT 'P' || p_partkey AS e1, p_brand || '/' || p_type AS e2 FROM part UNION SELECT p_brand || '/' || p_type, p_brand FROM part UNION SELECT p_brand, 'BRAND' FROM part) SELECT uid, ancestor, min(hops) AS hops FROM (SELECT e1 AS uid, e2 AS ancestor, 1 AS hops FROM e UNION ALL SELECT a.e1, b.e2, 2 FROM e a JOIN e b ON a.e2 = b.e1 UNION ALL SELECT a.e1, c.e2, 3 FROM e a JOIN e b ON a.e2 = b.e1 JOIN e c ON b.e2 = c.e1) GROUP BY 1, 2")
def h10(spark, d):
    part = table(spark, d, "part")
    kind = F.concat("p_brand", F.lit("/"), "p_type")
    edges = part.select(F.concat(F.lit("P"), "p_partkey").alias("e1"), kind.alias("e2")).union(part.select(kind, "p_brand")).union(part.select("p_brand", F.lit("BRAND"))).distinct()
    return analysis.closure(edges)


# --- ordered state ------------------------------------------------------------------------------------------------


def event_ops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type in ('purchase', 'signup', 'error')")
    return e.select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "value")


_OPS = "ops AS (SELECT 'u' || user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, value FROM events WHERE event_type IN ('purchase', 'signup', 'error'))"


@query("s2_fold_set_delete", f"WITH {_OPS} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM ops) WHERE k = 1 AND op = 'set'")
def s2(spark, d):
    return state.fold_set_delete(event_ops(spark, d))


@query("s3_fold_append", f"WITH {_OPS} SELECT key, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs, count(*) AS n FROM ops WHERE op = 'set' GROUP BY key")
def s3(spark, d):
    ops = event_ops(spark, d).filter("op = 'set'").withColumn("value", F.col("seq").cast("string"))
    return state.fold_append(ops).select("key", F.array_join("values", ",").alias("seqs"), F.size("values").cast("long").alias("n"))


@query("s4_transitions", f"WITH {_OPS}, a AS (SELECT *, CASE WHEN op = 'set' THEN value END AS after FROM ops) SELECT key, seq, op, lag(after) OVER (PARTITION BY key ORDER BY seq) AS before, after FROM a")
def s4(spark, d):
    return state.transitions(event_ops(spark, d))


@query("s6_world_state", "SELECT owner, item, since FROM (SELECT 'C' || o_custkey AS owner, p_brand AS item, max(l_orderkey) AS since, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE flag <> 'R'")
def s6(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ops = rows.select(F.concat(F.lit("C"), "o_custkey").alias("owner"), F.col("p_brand").alias("item"), F.when(F.col("l_returnflag") == "R", "give").otherwise("gain").alias("op"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("seq"))
    return state.holdings(ops).select("owner", "item", F.col("since.l_orderkey").alias("since"))


# --- ranking, joins, sets -----------------------------------------------------------------------------------------


@query("w1_rank_with_margin", "SELECT nation, uid, score, (score >= 0.9 AND score - coalesce(second, 0) >= 0.01) OR score >= 0.999 AS accepted FROM (SELECT c_nationkey AS nation, c_custkey AS uid, c_acctbal / 10000 AS score, row_number() OVER w AS k, lead(c_acctbal / 10000) OVER w AS second FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal / 10000 DESC, c_custkey)) WHERE k = 1")
def w1(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("uid"), (F.col("c_acctbal") / 10000).alias("score"))
    return ranking.rank_with_margin(t, "nation", "uid", "score", 0.9, 0.01)


@query("w2_top_k", "SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_acctbal > 0) WHERE rank <= 5")
def w2(spark, d):
    return ranking.top_k(table(spark, d, "customer").filter("c_acctbal > 0"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank")


@query("w3_top_k_mask", "SELECT p_brand, p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3 THEN p_retailprice ELSE 0.0 END AS p_retailprice FROM part")
def w3(spark, d):
    return ranking.mask_top_k(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 3)


@query("w7_carry_forward", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def w7(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ranking.carry_forward(e, "user_id", ["event_id"], "v", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("w8_round_robin", "SELECT p_type, p_partkey, row_number() OVER (ORDER BY k, p_type) AS no FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) ORDER BY k, p_type LIMIT 40")
def w8(spark, d):
    return ranking.interleave(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", [F.col("p_partkey")], 40).select("p_type", "p_partkey", "no")


@query("w10_dedupe_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def w10(spark, d):
    return ranking.keep_first(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], [F.col("p_partkey")])


@query("w12_best_by", "SELECT user_id, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY user_id")
def w12(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query("j3_touching", f"WITH {FACTS} SELECT DISTINCT fid FROM inc WHERE uid IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 45)")
def j3(spark, d):
    active = table(spark, d, "part").filter("p_size > 45").select(F.concat(F.lit("P"), "p_partkey").alias("uid"))
    return members_of(spark, d).join(active, "uid", "left_semi").select("fid").distinct()


@query("j8_multiset_overlap", "WITH a AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT item, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS both, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL JOIN b USING (item)")
def j8(spark, d):
    lines = table(spark, d, "lineitem")
    counts = lambda flag, name: lines.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts("A", "n_a").join(counts("N", "n_b"), "item", "full").select("item", F.least(zero("n_a"), zero("n_b")).alias("both"), zero("n_a").alias("n_a"), zero("n_b").alias("n_b"))


@query("u1_intersect", "SELECT l_partkey AS uid FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def u1(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("uid")).intersect(lines.filter("l_returnflag = 'N'").select("l_partkey"))


@query("u2_section_union", "SELECT uid, arg_max(name, section) AS name FROM (SELECT n_nationkey AS uid, n_name AS name, 1 AS section FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region) GROUP BY uid")
def u2(spark, d):
    both = table(spark, d, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("name"), F.lit(1).alias("section")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("uid"), F.col("r_name").alias("name"), F.lit(2).alias("section")))
    return both.groupBy("uid").agg(F.max_by("name", "section").alias("name"))


@query("u4_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def u4(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").filter("l_quantity > 40").select("l_partkey"))


# --- lookups and normalization ------------------------------------------------------------------------------------


@query("f2_find_nodes", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def f2(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@query("f5_find_roles", f"WITH {FACTS} SELECT DISTINCT fid FROM inc WHERE role = 'OBJECT' AND uid = 'P7'")
def f5(spark, d):
    return members_of(spark, d).filter("role = 'OBJECT' and uid = 'P7'").select("fid").distinct()


@query("n1_canonical_label", r"SELECT p_partkey, CASE WHEN k = '' THEN 'RELATED_TO' ELSE k END AS label FROM (SELECT p_partkey, trim(regexp_replace(upper(p_brand || ' - ' || p_type || ' ' || p_name), '[^A-Z0-9]+', '_', 'g'), '_') AS k FROM part)")
def n1(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.canonical_label(F.concat("p_brand", F.lit(" - "), "p_type", F.lit(" "), "p_name")).alias("label"))


# --- vectors ------------------------------------------------------------------------------------------------------


@query("v4_l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def v4(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(fn.norm(F.col("embedding")), 4).alias("norm"))


@query("v5_knn", "SELECT q, k.vec_id, rank FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) k WHERE rank <= 5")
def v5(spark, d):
    from ..operators import vectors

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.knn(e.filter("vec_id % 20 = 0"), e, 5).select("q", "vec_id", "rank")


# --- metrics ------------------------------------------------------------------------------------------------------

_PRED = "p AS (SELECT l.doc_id, d.lang, d.source, quality AS gold, CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END AS pred, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_RATES = "round(avg(CAST(pred = gold AS INT)), 6) AS accuracy, round(coalesce(sum(pred * gold) / nullif(sum(pred), 0), 0), 6) AS precision, round(coalesce(sum(pred * gold) / nullif(sum(gold), 0), 0), 6) AS recall, count(*) AS n"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("gold"), (F.col("n_chars") >= 800).cast("int").alias("pred"), "n_chars")


def rates() -> list:
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)), 6)
    hit = F.col("pred") * F.col("gold")
    return [F.round(F.avg((F.col("pred") == F.col("gold")).cast("int")), 6).alias("accuracy"), share(hit, F.col("pred")).alias("precision"), share(hit, F.col("gold")).alias("recall"), F.count("*").alias("n")]


@query("a8_metrics", f"WITH {_PRED} SELECT {_RATES} FROM p")
def a8(spark, d):
    return predictions(spark, d).agg(*rates())


@query("a9_metrics_by_type", f"WITH {_PRED} SELECT lang, source, {_RATES} FROM p GROUP BY GROUPING SETS ((lang), (lang, source))")
def a9(spark, d):
    return predictions(spark, d).groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(*rates())


@query("a10_threshold_sweep", f"WITH {_PRED}, t AS (SELECT unnest(range(1, 14)) * 200 AS threshold), s AS (SELECT threshold, gold, CASE WHEN n_chars >= threshold THEN 1 ELSE 0 END AS pred FROM p, t) SELECT threshold, {_RATES} FROM s GROUP BY threshold")
def a10(spark, d):
    swept = predictions(spark, d).withColumn("threshold", F.explode(F.sequence(F.lit(200).cast("long"), F.lit(2600).cast("long"), F.lit(200).cast("long")))).withColumn("pred", (F.col("n_chars") >= F.col("threshold")).cast("int"))
    return swept.groupBy("threshold").agg(*rates())


@query("a11_optimal_threshold", f"WITH {_PRED}, t AS (SELECT unnest(range(1, 14)) * 200 AS threshold), s AS (SELECT threshold, sum(CASE WHEN n_chars >= threshold THEN gold ELSE 0 END) AS hit, count(*) FILTER (n_chars >= threshold) AS said, sum(gold) AS gold FROM p, t GROUP BY threshold) SELECT threshold, round(2.0 * hit / (said + gold), 6) AS f1 FROM s ORDER BY round(2.0 * hit / (said + gold), 6) DESC, threshold LIMIT 1")
def a11(spark, d):
    swept = predictions(spark, d).withColumn("threshold", F.explode(F.sequence(F.lit(200).cast("long"), F.lit(2600).cast("long"), F.lit(200).cast("long"))))
    said = F.col("n_chars") >= F.col("threshold")
    f1 = swept.groupBy("threshold").agg(F.round(2.0 * F.sum(F.when(said, F.col("gold")).otherwise(0)) / (F.sum(said.cast("int")) + F.sum("gold")), 6).alias("f1"))
    return f1.orderBy(F.col("f1").desc(), "threshold").limit(1)


@query("a1_graph_stats", f"WITH {FACTS} SELECT 'facts' AS part, count(*) AS n FROM facts UNION ALL SELECT role, count(DISTINCT uid) FROM inc GROUP BY role")
def a1(spark, d):
    rows = facts(spark, d)
    by_role = graph.incidence(rows, ROLES).groupBy(F.col("role").alias("part")).agg(F.countDistinct("uid").alias("n"))
    return rows.agg(F.count("*").alias("n")).select(F.lit("facts").alias("part"), "n").unionByName(by_role)


@query("a4_role_coverage", f"WITH {FACTS} SELECT role, count(*) AS coverage, count(DISTINCT uid) AS distinct_fillers FROM inc GROUP BY role")
def a4(spark, d):
    return members_of(spark, d).groupBy("role").agg(F.count("*").alias("coverage"), F.countDistinct("uid").alias("distinct_fillers"))


@query("a29_top_factors", f"WITH {FACTS} SELECT object, fid, k FROM (SELECT object, fid, row_number() OVER (PARTITION BY object ORDER BY w DESC, fid) AS k FROM facts) WHERE k <= 3")
def a29(spark, d):
    return ranking.top_k(facts(spark, d), ["object"], [F.col("w").desc(), F.col("fid")], 3).select("object", "fid", F.col("rank").alias("k"))


# --- text ---------------------------------------------------------------------------------------------------------


@query("t1_chunks", r"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) SELECT doc_id, i // 80 AS chunk, md5(array_to_string(w[i + 1:i + 100], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 20), 80)) AS i FROM w WHERE len(w) > 0)")
def t1(spark, d):
    from ..operators import text

    return text.chunks(table(spark, d, "documents"), 100, 20).select("doc_id", "chunk", F.md5("body").alias("digest"))


@query("t2_token_counts", r"SELECT doc_id, count(*) AS n, count(DISTINCT t) AS distinct_n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM documents) GROUP BY doc_id")
def t2(spark, d):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.size(F.array_distinct(tokens)).cast("long").alias("distinct_n")).filter("n > 0")
