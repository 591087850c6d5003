"""Registered queries of questions answered by spreading, by believed facts and by retrieval, and of their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import questions, state_stream, vectors
from ..streaming import turns
from .purchase import FACTS, LINKS, PARAMS, evidence, factors, facts, follow_links, steps_sql, table
from .registered import follow_members, members_of, query, spread

DEEPEST = 3
_NTH = "nth AS (SELECT o_custkey, 'O' || o_orderkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, 'L' || o_orderkey AS fid FROM orders)"
_CASES = f"{LINKS}, {_NTH}, cs AS (SELECT a.o_custkey AS case_id, a.uid AS seed, b.uid AS target, a.o_custkey % 3 + 1 AS depth FROM nth a JOIN nth b ON a.o_custkey = b.o_custkey AND a.k = 1 AND b.k = a.o_custkey % 3 + 2), inc AS (SELECT fid, e1 AS uid, 0 AS pos FROM links UNION ALL SELECT fid, e2, 1 FROM links), fac AS (SELECT fid, 1.0::DOUBLE AS w, 1.0::DOUBLE AS confidence, 0.5::DOUBLE AS forward, 0.1::DOUBLE AS backward, 0.5::DOUBLE AS selectivity FROM links), ev AS (SELECT case_id AS run_id, seed AS uid, 1.0::DOUBLE AS x FROM cs), {steps_sql('linear', DEEPEST)}"
_ENDS = " UNION ALL ".join(f"SELECT case_id, x FROM cs JOIN s{k} s ON s.run_id = case_id AND s.uid = target WHERE depth = {k}" for k in range(1, DEEPEST + 1))
_SENT = " UNION ALL ".join(f"SELECT case_id, i.fid, {k} AS step FROM cs JOIN s{k - 1} s ON s.run_id = case_id JOIN inc i ON i.uid = s.uid WHERE depth >= {k} AND round(s.x * CASE WHEN i.pos = 0 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END, 9) >= 0.08" for k in range(1, DEEPEST + 1))
_HOPS = f"{_CASES}, en AS ({_ENDS}), se AS (SELECT case_id, fid, min(step) AS step FROM ({_SENT}) GROUP BY 1, 2), tr AS (SELECT case_id, list(fid ORDER BY step, fid) AS trace FROM se GROUP BY 1), hop AS (SELECT cs.case_id, depth, target, coalesce(x, 0) AS x, coalesce(x, 0) >= 0.08 AS answered, coalesce(trace, []) AS trace FROM cs LEFT JOIN en USING (case_id) LEFT JOIN tr USING (case_id)), gold AS (SELECT case_id, list(fid ORDER BY k) AS path FROM cs JOIN nth ON o_custkey = case_id AND k <= depth GROUP BY 1)"


def cases(spark, d):
    """One to three orders ahead of each customer's first order; the links between are the proof."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    nth = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("O"), "o_orderkey").alias("uid"), F.concat(F.lit("L"), "o_orderkey").alias("fid"), k.alias("k"), (F.col("o_custkey") % 3 + 1).alias("depth"))
    at = lambda place: F.max(F.when(F.col("k") == place, F.col("uid")))
    path = F.array_sort(F.collect_list(F.when(F.col("k") <= F.col("depth"), F.struct("k", "fid"))))
    rows = nth.filter("k <= depth + 1").groupBy("case_id", "depth").agg(at(F.lit(1)).alias("seed"), at(F.col("depth") + 1).alias("target"), path.alias("path"))
    return rows.filter("target is not null").select("case_id", "depth", "seed", "target", F.col("path.fid").alias("path"))


def hops(spark, d):
    links = follow_links(spark, d).select("fid", *[F.lit(v).alias(c) for c, v in (("w", 1.0), ("confidence", 1.0), ("forward", 0.5), ("backward", 0.1), ("selectivity", 0.5), ("decay", 0.05))])
    asked = cases(spark, d)
    return questions.multi_hop(follow_members(spark, d).select("fid", "uid", "pos"), links, asked, DEEPEST, 0.08).join(asked, "case_id")


@query("r9_multi_hop", f"WITH {_HOPS} SELECT case_id, round(x, 6) AS x, answered, array_to_string(trace, ' ') AS trace FROM hop")
def r9(spark, d):
    return hops(spark, d).select("case_id", F.round("x", 6).alias("x"), "answered", F.array_join("trace", " ").alias("trace"))


@query("q11_inference_eval", f"WITH {_HOPS} SELECT hop.depth, count(*) AS n, round(avg(answered::INT), 6) AS accuracy, round(avg(CASE WHEN answered AND trace[1:len(path)] = path THEN hop.depth / 3.0::DOUBLE ELSE 0 END), 6) AS explained FROM hop JOIN gold USING (case_id) GROUP BY 1")
def q11(spark, d):
    complete = ev.trace_complete(F.col("path"), F.col("trace"))
    return hops(spark, d).groupBy("depth").agg(F.count("*").alias("n"), F.round(ev.share(F.col("answered")), 6).alias("accuracy"), F.round(ev.explain_score(F.col("answered"), F.col("depth"), DEEPEST, complete), 6).alias("explained"))


@query("q10_gold_eval", f"WITH {_HOPS}, an AS (SELECT case_id, depth, CASE WHEN answered THEN 'it is ' || target ELSE 'unknown' END AS answer, target, case_id % 7 = 0 AS trap, trace, path FROM hop JOIN gold USING (case_id)) SELECT depth, count(*) AS n, round(avg((CASE WHEN trap THEN answer = 'unknown' ELSE contains(lower(answer), lower(target)) END)::INT), 6) AS hit, round(avg(list_has_all(trace, path)::INT), 6) AS explained, round(avg((answer <> 'unknown' AND (trap OR len(trace) = 0))::INT), 6) AS hallucinated FROM an GROUP BY 1")
def q10(spark, d):
    """Each case on its own chain; every seventh is a trap."""
    answer = F.when(F.col("answered"), F.concat(F.lit("it is "), "target")).otherwise("unknown")
    rows = hops(spark, d).select("case_id", "depth", answer.alias("answer"), "trace", F.col("target").alias("keyword"), F.col("path").alias("gold_trace"), (F.col("case_id") % 7 == 0).alias("trap"))
    return ev.gold_eval(rows).groupBy("depth").agg(F.count("*").alias("n"), *[F.round(ev.share(F.col(c)), 6).alias(c) for c in ("hit", "explained", "hallucinated")])


@query("q10_sequential_cases", "WITH cs AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey AS fid, o_orderpriority AS object, o_orderkey % 3 = 0 AS tells, o_orderkey % 7 = 0 AS trap FROM orders), kn AS (SELECT a.session, a.seq, a.trap, p.protocol, count(b.fid) AS n, arg_max(b.object, b.seq) AS answer, max(b.seq) AS last FROM cs a JOIN (VALUES ('isolated'), ('sequential')) p(protocol) ON true LEFT JOIN cs b ON b.session = a.session AND b.tells AND NOT a.trap AND (b.seq = a.seq OR (p.protocol = 'sequential' AND b.seq < a.seq)) GROUP BY 1, 2, 3, 4) SELECT protocol, count(*) AS n, sum(n)::BIGINT AS known, round(avg((CASE WHEN trap THEN answer IS NULL ELSE answer IS NOT NULL END)::INT), 6) AS hit, round(avg((answer IS NOT NULL AND trap)::INT), 6) AS hallucinated FROM kn GROUP BY 1")
def q10_sequential(spark, d):
    """Each order is a case of its customer's session: every third tells its priority, all ask for it, traps for what nobody tells."""
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), seq.alias("seq"), F.col("o_orderkey").alias("fid"), F.concat(F.lit("C"), "o_custkey").alias("subject"), F.lit("PRIORITY").alias("relation"), F.col("o_orderpriority").alias("object"))
    trap = F.col("fid") % 7 == 0
    asked = rows.select("session", "seq", "subject", F.when(trap, "COLOUR").otherwise(F.col("relation")).alias("relation"), trap.alias("trap"))
    told, out = rows.filter("fid % 3 = 0"), None
    for protocol in ("isolated", "sequential"):
        got = ev.answer_cases(asked, told, protocol).withColumn("keyword", F.when(F.col("n_known") > 0, F.col("answer")).otherwise("something"))
        judged = ev.gold_eval(got.withColumn("gold_trace", F.col("trace"))).withColumn("protocol", F.lit(protocol))
        out = judged if out is None else out.unionByName(judged)
    return out.groupBy("protocol").agg(F.count("*").alias("n"), F.sum("n_known").alias("known"), *[F.round(ev.share(F.col(c)), 6).alias(c) for c in ("hit", "hallucinated")])


@query("q10_sequential_answers", "WITH cs AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey AS fid, o_orderpriority AS object, o_orderkey % 3 = 0 AS tells FROM orders) SELECT session, seq, coalesce(last_value(CASE WHEN tells THEN object END IGNORE NULLS) OVER w, 'unknown') AS answer, coalesce(CAST(last_value(CASE WHEN tells THEN fid END IGNORE NULLS) OVER w AS VARCHAR), '') AS trace FROM cs WINDOW w AS (PARTITION BY session ORDER BY seq)")
def q10_answers(spark, d):
    """What each case of a session answers when it knows the facts of those before."""
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), seq.alias("seq"), F.col("o_orderkey").alias("fid"), F.concat(F.lit("C"), "o_custkey").alias("subject"), F.lit("PRIORITY").alias("relation"), F.col("o_orderpriority").alias("object"))
    got = ev.answer_cases(rows.select("session", "seq", "subject", "relation", "fid"), rows.filter("fid % 3 = 0"), "sequential")
    return got.select("session", "seq", "answer", F.array_join(F.col("trace").cast("array<string>"), " ").alias("trace"))


_TICKS = " UNION ALL ".join(f"SELECT run_id, {k} AS tick, uid, x FROM s{k}" for k in (1, 2))


@query("r11_activation_probe", f"WITH {FACTS}, {PARAMS}, {steps_sql('linear', 2)} SELECT run_id, tick, uid, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, tick ORDER BY round(x, 9) DESC, uid) AS rank FROM ({_TICKS}) WHERE x >= 0.05) WHERE rank <= 8")
def r11(spark, d):
    return questions.most_active(spread(spark, d, ("linear",), 2, every=True).withColumnRenamed("step", "tick")).select("run_id", "tick", "uid", "rank")


_NAMES = "cn AS (SELECT c_custkey, substr(c_name, 10) AS number, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def customers(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("C"), "c_custkey").alias("uid"), F.expr("substring(c_name, 10)").alias("label"), "n_name")


def asked(spark, d):
    """Where is it, of even customers; what did it purchase, of odd ones."""
    even = F.col("question_id") % 2 == 0
    said = F.when(even, F.concat(F.lit("Where is located "), "label", F.lit("?"))).otherwise(F.concat(F.lit("Which parts has purchased "), "label", F.lit("?")))
    return customers(spark, d).select("question_id", said.alias("question"))


def answers(spark, d):
    home = customers(spark, d).select(F.concat(F.lit("H"), "question_id").alias("fid"), F.lit("LOCATED").alias("relation"), F.col("uid").alias("subject"), F.col("n_name").alias("filler"), F.lit("LOCATION").alias("role"))
    bought = facts(spark, d).select("fid", F.lit("PURCHASED").alias("relation"), "subject", F.col("object").alias("filler"), F.lit("OBJECT").alias("role"))
    known = home.unionByName(bought)
    end = lambda uid, pos, role: F.struct(F.col(uid).alias("uid"), F.lit(pos).alias("pos"), role.alias("role"), F.lit("bind").alias("potential"), F.lit(1.0).alias("w"))
    ends = F.array(end("subject", 0, F.lit("SUBJECT")), end("filler", 1, F.col("role")))
    return questions.ask(asked(spark, d), customers(spark, d).select("question_id", "uid", "label"), known.select("fid", "relation", ends.alias("members")), None, ["where", "is", "which", "parts", "has"])


_ANSWERS = f"{FACTS}, {_NAMES}, bo AS (SELECT subject, string_agg(DISTINCT object, ', ' ORDER BY object) AS answer, count(DISTINCT fid) AS n FROM facts GROUP BY 1), ans AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE coalesce(answer, 'unknown') END AS answer, CASE WHEN c_custkey % 2 = 0 THEN 'LOCATED' WHEN answer IS NOT NULL THEN 'PURCHASED' END AS relation, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE coalesce(n, 0) END AS n_factors FROM cn LEFT JOIN bo ON subject = 'C' || c_custkey)"


@query("q7_ask", f"WITH {_ANSWERS} SELECT question_id, answer, relation, n_factors FROM ans")
def q7(spark, d):
    return answers(spark, d)


@query("q8_compare_arms", f"WITH {_ANSWERS} SELECT question_id, answer AS graph_answer, number || ' is in ' || n_name || '.' AS retrieval_answer, contains(lower(number || ' is in ' || n_name || '.'), lower(answer)) AS agree FROM ans JOIN cn ON c_custkey = question_id")
def q8(spark, d):
    """Retrieval finds the customer's own line, which tells where it is and nothing else."""
    lines = customers(spark, d).select(F.col("question_id").alias("chunk_id"), F.concat("label", F.lit(" is in "), "n_name", F.lit(". End.")).alias("body"))
    number = customers(spark, d).select("question_id", F.col("label").alias("question"))
    found = questions.best_chunks(number, lines, 1, 1, repeated=True).join(lines, "chunk_id").select("question_id", "rank", "body")
    return questions.compare_arms(answers(spark, d), questions.extract_answer(number, found))


_TURNS = "tu AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS context FROM conversations)"


@query("t28_extract_answer", r"WITH w AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS w FROM conversations), q AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1), qw AS (SELECT conv_id, turn, w AS q, list_filter(w, lambda t: length(t) > 3) AS content FROM w JOIN q USING (conv_id, turn)), h AS (SELECT q.conv_id, w.turn, text, len(list_intersect(q, w)) AS overlap, list_intersect(content, w) AS said, content FROM qw q JOIN w ON w.conv_id = q.conv_id AND w.turn < q.turn), b AS (SELECT conv_id, arg_max(text, (overlap, -turn)) AS body, max(overlap) AS overlap, len(list_distinct(flatten(list(said)))) AS found FROM h GROUP BY 1) SELECT q.conv_id, CASE WHEN (len(content) = 0 OR found >= greatest(1, len(content) // 3)) AND overlap > 0 THEN CASE WHEN regexp_extract(body, '(?s)^(.*?[.!?])(\s|$)', 1) <> '' THEN regexp_extract(body, '(?s)^(.*?[.!?])(\s|$)', 1) ELSE body END ELSE 'unknown' END AS answer FROM qw q LEFT JOIN b USING (conv_id)")
def t28(spark, d):
    """The last turn of a conversation asks, the turns before are what was retrieved."""
    said = table(spark, d, "conversations")
    last = said.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    asks = said.join(last, ["conv_id", "turn"]).select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    held = said.join(last.withColumnRenamed("turn", "last"), "conv_id").filter("turn < last").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.col("text").alias("body"))
    return questions.extract_answer(asks, held).withColumnRenamed("question_id", "conv_id")


@query("a20_hallucinated_arms", rf"WITH {_TURNS}, t AS (SELECT *, turn % 5 = 4 AS trap, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{4,}}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[a-z0-9]{{4,}}')) AS c FROM tu) SELECT conv_id, turn, trap OR turn % 3 = 0 AS graph, trap OR NOT contains(lower(coalesce(context, '')), 'die') OR (len(a) > 0 AND len(list_intersect(a, c)) < len(a) * 0.35::DOUBLE) AS retrieval FROM t")
def a20_arms(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, d, "conversations").withColumn("context", before).withColumn("trap", F.col("turn") % 5 == 4)
    trace = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("role"))
    return rows.select("conv_id", "turn", ev.hallucinated(F.col("text"), F.col("trap"), trace).alias("graph"), ev.retrieval_hallucinated(F.col("text"), F.col("trap"), F.array(F.lit("die")), F.col("context")).alias("retrieval"))


@query("st5_stream_gc", "SELECT 'u' || user_id AS uid, max(event_id) AS last FROM events GROUP BY 1 HAVING (SELECT max(event_id) FROM events) - max(event_id) < 200")
def st5(spark, d):
    """Users are live for 200 events after their last one."""
    now = table(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    rows = state_stream.source(spark, f"{d}/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("uid"), F.col("event_id").alias("tick"))
    return state_stream.run(turns.live_nodes(rows, now, 200), "complete")


@query("v6_knn_approximate")
def v6(spark, d):
    """Recall against the exact neighbours is tested."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.knn_approximate(e.filter("vec_id % 20 = 0"), e, 10).select("q", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")
