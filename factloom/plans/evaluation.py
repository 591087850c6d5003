"""Registered queries of the metrics over orders, labelled documents and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from .purchase import FACTS, facts, table
from .registered import members_of, query

# a mention is an order, resolved to its supplier by the largest line; the smallest supplier is expected, none for open orders
_CASES = """cases AS (SELECT o_orderkey AS id, o_orderpriority AS type, CASE WHEN o_orderstatus <> 'O' THEN lo END AS want, CASE WHEN q >= 20 THEN got END AS got, hi AS banned, n = 1 AS reject
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi, arg_max(l_suppkey, (l_quantity, l_suppkey)) AS got, max(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_NEG = "(type IN ('1-URGENT', '5-LOW'))"
_OUT = f"""o AS (SELECT *, CASE WHEN {_NEG} AND reject THEN got IS NULL ELSE want IS NOT DISTINCT FROM got AND NOT ({_NEG} AND coalesce(got = banned, false)) END AS correct,
  CASE WHEN {_NEG} AND reject THEN got IS NOT NULL ELSE ({_NEG} AND got IS NOT NULL AND want IS DISTINCT FROM got) OR ({_NEG} AND coalesce(got = banned, false)) END AS false_merge,
  got IS NOT NULL AND want IS DISTINCT FROM got AS false_positive, want IS NOT NULL AND got IS NULL AS false_negative FROM cases)"""


def outcomes(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("banned"), F.max_by("l_suppkey", F.struct("l_quantity", "l_suppkey")).alias("got"), F.max("l_quantity").alias("q"), F.count("*").alias("n")
    )
    rows = table(spark, d, "orders").join(lines, "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderstatus") != "O", F.col("lo")).alias("want"), F.when(F.col("q") >= 20, F.col("got")).alias("got"), "banned", (F.col("n") == 1).alias("reject")
    )
    return rows.withColumns(ev.outcome(F.col("want"), F.col("got"), F.col("type").isin("1-URGENT", "5-LOW"), F.col("banned"), F.col("reject")))


@query("a7_er_outcome", f"WITH {_CASES}, {_OUT} SELECT id, correct, false_merge, false_positive, false_negative FROM o")
def a7(spark, d):
    return outcomes(spark, d).select("id", "correct", "false_merge", "false_positive", "false_negative")


@query("a8_er_metrics_by_type", f"WITH {_CASES}, {_OUT} SELECT type, round(avg(correct::INT), 6) AS accuracy, round(avg(false_merge::INT), 6) AS false_merge_rate, round(avg(false_positive::INT), 6) AS false_positive_rate, round(avg(false_negative::INT), 6) AS false_negative_rate, count(*) AS n FROM o GROUP BY GROUPING SETS ((), (type))")
def a8(spark, d):
    r = lambda c, name: F.round(ev.share(F.col(c)), 6).alias(name)
    return outcomes(spark, d).groupingSets([[], ["type"]], "type").agg(r("correct", "accuracy"), r("false_merge", "false_merge_rate"), r("false_positive", "false_positive_rate"), r("false_negative", "false_negative_rate"), F.count("*").alias("n"))


_ROLES = "want AS (SELECT l_orderkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'SUBJECT' WHEN 1 THEN 'OBJECT' ELSE 'LOCATION' END AS role, l_suppkey AS value FROM lineitem), got AS (SELECT l_orderkey AS item, CASE (l_linenumber + CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'SUBJECT' WHEN 1 THEN 'OBJECT' ELSE 'LOCATION' END AS role, l_suppkey AS value FROM lineitem WHERE l_returnflag <> 'A'), c AS (SELECT role, sum(least(w, g)) AS hit, sum(w) AS w, sum(g) AS g FROM (SELECT coalesce(a.role, b.role) AS role, coalesce(a.n, 0) AS w, coalesce(b.n, 0) AS g FROM (SELECT item, role, value, count(*) AS n FROM want GROUP BY ALL) a FULL JOIN (SELECT item, role, value, count(*) AS n FROM got GROUP BY ALL) b ON a.item = b.item AND a.role = b.role AND a.value = b.value) GROUP BY role), f AS (SELECT role, hit / g AS precision, hit / w AS recall, 2 * hit / (w + g) AS f1, CASE WHEN role = 'LOCATION' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM c)"


def role_table(spark, d):
    lines = table(spark, d, "lineitem")

    def rows(df, shift):
        at = (F.col("l_linenumber") + shift) % 3
        return df.select(F.col("l_orderkey").alias("item"), F.when(at == 0, "SUBJECT").when(at == 1, "OBJECT").otherwise("LOCATION").alias("role"), F.col("l_suppkey").alias("value"))

    return ev.role_scores(rows(lines, F.lit(0)), rows(lines.filter("l_returnflag <> 'A'"), F.when(F.col("l_tax") > 0.06, 1).otherwise(0)))


@query("a12_role_scores", f"WITH {_ROLES} SELECT role, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def a12(spark, d):
    return role_table(spark, d).select("role", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a12_weighted_role_score", f"WITH {_ROLES} SELECT round(sum(f1 * weight), 6) AS weighted, round(sum(f1 * weight) / sum(weight), 6) AS normalized FROM f")
def a12_weighted(spark, d):
    return ev.weighted_role_score(role_table(spark, d)).select(F.round("weighted", 6).alias("weighted"), F.round("normalized", 6).alias("normalized"))


# an order's proof is its parts that were kept, by key; what was found are the parts of 10 or more, by date of shipment
_TRACE = """ln AS (SELECT l_orderkey, l_partkey, min(l_shipdate) AS shipped, max(l_returnflag) AS flag, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
tr AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) FILTER (flag <> 'R') AS want, list(l_partkey ORDER BY shipped, l_partkey) FILTER (q >= 10) AS got FROM ln GROUP BY 1),
t AS (SELECT l_orderkey, coalesce(want, []) AS want, coalesce(got, []) AS got FROM tr), q AS (SELECT *, list_transform(want, lambda x: list_position(got, x)) AS spot FROM t),
c AS (SELECT *, len(list_filter(spot, lambda x: x IS NULL OR x = 0)) = 0 AND list_sort(spot) = spot AS complete FROM q)"""


def traces(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_shipdate").alias("shipped"), F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    g = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(F.col("flag") != "R", F.col("l_partkey")))).alias("want"), F.array_sort(F.collect_list(F.when(F.col("q") >= 10, F.struct("shipped", "l_partkey")))).alias("got")
    )
    return g.withColumn("got", F.col("got.l_partkey")).withColumn("complete", ev.trace_complete(F.col("want"), F.col("got")))


@query("a14_trace_complete", f"WITH {_TRACE} SELECT l_orderkey, complete FROM c")
def a14(spark, d):
    return traces(spark, d).select("l_orderkey", "complete")


@query("a15_trace_contains", f"WITH {_TRACE} SELECT l_orderkey, CASE WHEN len(want) = 0 THEN len(got) > 0 ELSE list_has_all(got, want) END AS contained FROM t")
def a15(spark, d):
    ids = lambda c: F.transform(c, lambda x: F.concat(F.lit("M_"), x))
    return traces(spark, d).select("l_orderkey", ev.trace_contains(F.col("got").cast("array<string>"), ids("want")).alias("contained"))


@query("a13_explain_score", f"WITH {_TRACE} SELECT round(avg(CASE WHEN complete AND o_orderstatus = 'F' THEN len(want) / 7.0::DOUBLE ELSE 0 END), 6) AS score FROM c JOIN orders ON o_orderkey = l_orderkey")
def a13(spark, d):
    rows = traces(spark, d).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.agg(F.round(ev.explain_score(F.col("o_orderstatus") == "F", F.size("want"), 7, F.col("complete")), 6).alias("score"))


@query("a24_path_quality", f"WITH {_TRACE}, n AS (SELECT *, len(list_intersect(want, got)) AS k FROM t), p AS (SELECT *, coalesce(k / nullif(len(got), 0), 0) AS p, coalesce(k / nullif(len(want), 0), 0) AS r FROM n) SELECT l_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(CASE WHEN len(got) = 0 THEN 0 ELSE least(1, len(want) / len(got)) END, 6) AS hop_efficiency, len(want) - k AS missing, len(got) - k AS extra FROM p")
def a24(spark, d):
    q = ev.path_quality(F.col("got"), F.col("want"))
    whole = ("missing", "extra")
    return traces(spark, d).select("l_orderkey", *[(c.cast("long") if n in whole else F.round(c, 6)).alias(n) for n, c in q.items()])


@query("a28_benchmark_aggregate", f"WITH {_TRACE} SELECT o_orderpriority, round(avg(complete::INT), 6) AS answered, round(avg(len(list_intersect(want, got)) / greatest(1, len(want))), 6) AS recall FROM c JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def a28(spark, d):
    rows = traces(spark, d).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderpriority").agg(F.round(ev.share(F.col("complete")), 6).alias("answered"), F.round(F.avg(ev.path_quality(F.col("got"), F.col("want"))["recall"]), 6).alias("recall"))


@query("a16_gc_efficiency", "SELECT p_brand, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(1 - count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) / count(*), 6) END AS efficiency FROM part GROUP BY 1")
def a16(spark, d):
    kept = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("kept")).distinct()
    rows = table(spark, d, "part").join(kept, "p_partkey", "left")
    return rows.groupBy("p_brand").agg(F.round(ev.removal_efficiency(F.count("*"), F.count("kept")), 6).alias("efficiency"))


@query("a17_hallucination_rate", "SELECT p_brand, round(avg((k IS NULL)::INT), 6) AS rate FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) ON k = p_partkey GROUP BY 1")
def a17(spark, d):
    support = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("k")).distinct()
    return table(spark, d, "part").join(support, "p_partkey", "left").groupBy("p_brand").agg(F.round(ev.share(F.col("k").isNull()), 6).alias("rate"))


@query("a18_support_explainability", "WITH c AS (SELECT l_orderkey, count(*) FILTER (s_suppkey IS NULL) AS missing FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY 1) SELECT o_orderstatus, round(avg(coalesce(missing = 0, false)::INT), 6) AS share FROM orders LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1")
def a18(spark, d):
    good = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("ok"))
    cited = table(spark, d, "lineitem").join(good, "l_suppkey", "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("ok").isNull()).alias("missing"))
    return table(spark, d, "orders").join(cited, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.round(ev.share(F.col("missing") == 0), 6).alias("share"))


# two arms per part: mean quantity of returned and of kept lines
_ARMS = "arms AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS arm, round(avg(l_quantity) / 50, 9) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT l_partkey, max(CASE WHEN arm = 'a' THEN score END) AS a_score, max(CASE WHEN arm = 'b' THEN score END) AS b_score FROM arms GROUP BY 1)"


def arms(spark, d):
    arm = F.when(F.col("l_returnflag") == "R", "a").otherwise("b").alias("arm")
    rows = table(spark, d, "lineitem").groupBy("l_partkey", arm).agg(F.round(F.avg("l_quantity") / 50, 9).alias("score"))
    return ev.paired(rows, "l_partkey", "arm", ("a", "b"), ["score"])


@query("a19_comparison_deltas", f"WITH {_ARMS} SELECT l_partkey, a_score, b_score, round(a_score - b_score, 6) AS score_delta FROM w")
def a19(spark, d):
    return arms(spark, d).withColumn("score_delta", F.round("score_delta", 6))


@query("a19_total_score", "SELECT p_partkey, round(0.2::DOUBLE * p_size / 50 + 0.3::DOUBLE * (p_partkey % 7) / 6 + 0.15::DOUBLE * (p_partkey % 5) / 4 + 0.2::DOUBLE * (p_partkey % 3) / 2 + 0.15::DOUBLE * (p_partkey % 2), 6) AS total FROM part")
def a19_total(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, F.round(ev.total_score([F.col("p_size") / 50, k % 7 / 6, k % 5 / 4, k % 3 / 2, k % 2]), 6).alias("total"))


@query("a22_claim_verdict", f"WITH {_ARMS} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN abs(a_score - b_score) < 1e-12 THEN 'tied' WHEN a_score > b_score THEN 'supported' ELSE 'rejected' END AS verdict FROM w WHERE a_score IS NOT NULL AND b_score IS NOT NULL) GROUP BY 1")
def a22(spark, d):
    both = arms(spark, d).filter("score_delta is not null")
    return both.groupBy(ev.verdict(F.col("score_delta")).alias("verdict")).agg(F.count("*").alias("n"))


@query("a33_arm_pair", f"WITH {_ARMS} SELECT p_brand, round(avg(a_score), 6) AS a, round(avg(b_score), 6) AS b, round(avg(a_score) / avg(b_score), 6) AS gain FROM w JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a33(spark, d):
    rows = arms(spark, d).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    a, b = F.avg("a_score"), F.avg("b_score")
    return rows.groupBy("p_brand").agg(F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(F.try_divide(a, b), 6).alias("gain"))


_QA = "qa AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS context FROM conversations)"


@query("a20_unsupported_answers", rf"WITH {_QA}, t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]{{4,}}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[a-z0-9]{{4,}}')) AS c FROM qa) SELECT conv_id, turn, len(a) > 0 AND len(list_intersect(a, c)) < len(a) * 0.35::DOUBLE AS unsupported FROM t")
def a20(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").withColumn("context", before).select("conv_id", "turn", ev.unsupported_answer(F.col("text"), F.col("context")).alias("unsupported"))


# a user's k-th event is a tick of the one node of its type
_HIST = """h AS (SELECT user_id AS run_id, event_type AS uid, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS tick, least(1.0::DOUBLE, value / 100.0::DOUBLE) AS x FROM events),
s AS (SELECT *, x - lag(x) OVER w AS step FROM h WINDOW w AS (PARTITION BY run_id, uid ORDER BY tick)), g AS (SELECT *, CASE WHEN step > 1e-6 THEN 1 WHEN step < -1e-6 THEN -1 WHEN step IS NOT NULL THEN 0 END AS sign FROM s),
u AS (SELECT *, CASE WHEN sign * lag(sign) OVER (PARTITION BY run_id, uid ORDER BY tick) = -1 THEN 1 ELSE 0 END AS turn FROM g),
nd AS (SELECT run_id, uid, arg_max(x, tick) AS x, arg_max(abs(step), tick) AS change, max(x) AS peak, min(tick) FILTER (x >= 0.7) AS reached, CASE WHEN count(*) < 4 THEN 0 ELSE sum(turn) / greatest(1, count(*) - 2) END AS swing FROM u GROUP BY 1, 2),
top AS (SELECT run_id, tick, max(x) AS top FROM h GROUP BY 1, 2), pk AS (SELECT run_id, max(top) AS most, arg_min(tick, (-top, tick)) AS spot FROM top GROUP BY 1),
hl AS (SELECT t.run_id, min(tick - spot) AS half_life FROM top t JOIN pk USING (run_id) WHERE tick > spot AND top <= most / 2 AND most > 0 GROUP BY 1)"""


@query("a23_trajectory_metrics", f"WITH {_HIST} SELECT nd.run_id, min(reached)::DOUBLE AS latency, round(max(peak), 6) AS peak, count(*) FILTER (x >= 0.7) AS spread, round(1 - avg((x >= 0.7)::INT), 6) AS stability, round(coalesce(max(change), 0), 6) AS convergence, round(avg(swing), 6) AS oscillation, any_value(half_life)::DOUBLE AS half_life FROM nd LEFT JOIN hl ON hl.run_id = nd.run_id GROUP BY 1")
def a23(spark, d):
    tick = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long") - 1
    history = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("uid"), tick.alias("tick"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("x"))
    return ev.trajectories(history, 0.7).select("run_id", F.col("latency").cast("double").alias("latency"), *[F.round(c, 6).alias(c) for c in ("peak", "stability", "convergence", "oscillation")], "spread", F.col("half_life").cast("double").alias("half_life"))


@query("a27_state_accuracy", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS want, arg_max(event_type, event_id) FILTER (value > 20) AS got FROM events GROUP BY 1) SELECT want, round(avg(coalesce(want = got, false)::INT), 6) AS accuracy, count(*) AS n FROM l GROUP BY 1")
def a27(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("want"))
    seen = e.filter("value > 20").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("got"))
    return last.join(seen, "user_id", "left").groupBy("want").agg(F.round(ev.share(F.col("want") == F.col("got")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("a26_recall_at_k", "WITH r AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_suppkey, round(coalesce(count(*) FILTER (k <= 10 AND l_returnflag = 'R') / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 0), 6) AS recall FROM r GROUP BY 1")
def a26(spark, d):
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"))
    good = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").withColumn("k", k).groupBy("l_suppkey").agg(F.round(ev.ratio(F.count_if(good & (F.col("k") <= 10)), F.count_if(good)), 6).alias("recall"))


@query("a30_coverage_ratio", "SELECT source, round(avg(coalesce(n_chars >= 800, false)::INT), 6) AS covered, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (source))")
def a30(spark, d):
    return table(spark, d, "documents").groupingSets([[], ["source"]], "source").agg(F.round(ev.share(F.col("n_chars") >= 800), 6).alias("covered"), F.count("*").alias("n"))


@query("a31_exact_match", r"SELECT p_partkey, trim(regexp_replace(lower(upper(p_name) || '  '), '\s+', ' ', 'g')) = trim(regexp_replace(lower(replace(p_name, ' ', CASE WHEN p_size > 25 THEN '  ' ELSE '-' END)), '\s+', ' ', 'g')) AS same FROM part")
def a31(spark, d):
    other = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") > 25, "  ").otherwise("-"))
    return table(spark, d, "part").select("p_partkey", ev.exact_match(F.concat(F.upper("p_name"), F.lit("  ")), other).alias("same"))


@query("a32_fact_keys", f"WITH {FACTS} SELECT subject, count(DISTINCT 'PURCHASE:' || subject || ':' || object) AS keys, count(*) AS n FROM facts GROUP BY 1")
def a32(spark, d):
    key = F.concat_ws(":", F.lit("PURCHASE"), "subject", "object")
    return facts(spark, d).groupBy("subject").agg(F.countDistinct(key).alias("keys"), F.count("*").alias("n"))


@query("a35_dataset_stats", f"WITH {FACTS} SELECT 'facts' AS part, count(*) AS n FROM facts UNION ALL SELECT 'binary_relations', sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM inc GROUP BY fid) UNION ALL SELECT 'entities', count(DISTINCT uid) FROM inc UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'queries', count(*) FROM benchmark UNION ALL SELECT 'events', count(*) FROM events")
def a35(spark, d):
    by_fact = members_of(spark, d).groupBy("fid").agg(F.count("*").alias("k")).agg(F.count("*").alias("facts"), F.sum(F.col("k") - 1).alias("binary_relations"))
    out = by_fact.unpivot([], ["facts", "binary_relations"], "part", "n").unionByName(members_of(spark, d).agg(F.countDistinct("uid").alias("n")).select(F.lit("entities").alias("part"), "n"))
    for part, name in (("documents", "documents"), ("queries", "benchmark"), ("events", "events")):
        out = out.unionByName(table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n"))
    return out
