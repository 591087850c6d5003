"""Plans and batches whose cost must not grow faster than their input; results against plain forms."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import analysis, belief, graph, hubs, ingest, nary, phrases, questions, resolution, text
from factloom.plans import asking, lookups, registered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_many_texts_come_in_few_batches(spark):
    """each text with a hit was a data frame of its own."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["\na\nb\nc\n"] * 3000)], names=["text_id", "body"])
    out = list(phrases._find(["\na\nb\n", "\nc\n"])(iter([batch])))
    assert len(out) == 1 and out[0].num_rows == 6000
    assert out[0].slice(0, 2).to_pylist() == [{"text_id": 0, "start": 0, "width": 2, "run": "\na\nb\n"}, {"text_id": 0, "start": 2, "width": 1, "run": "\nc\n"}]


def test_texts_of_one_small_file_are_dealt_among_tasks(spark):
    """a table that one task reads was searched by one task."""
    t = spark.range(1000).coalesce(1).selectExpr("id as text_id", "'a b' as text")
    p = spark.createDataFrame([(1, "a b")], "uid long, phrase string")
    assert "REPARTITION_BY_NUM" in plan_of(phrases.phrase_matches(t, p))


@pytest.mark.parametrize("signed", [True, False])
def test_rows_counted_by_themselves_equal_grouped_rows(spark, signed):
    """no row of an n-gram is shuffled or grouped."""
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("abÄ\U0001f600 c") for _ in range(draw.randint(0, 40)))) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    for slots in (4, 64):
        apart = text.hashed_ngrams(df, "id", "t", (2, 3, 4), slots, signed, apart=True)
        assert "Aggregate" not in plan_of(apart)
        assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, text.hashed_ngrams(df, "id", "t", (2, 3, 4), slots, signed).collect()))


def test_role_map_reads_facts_once_and_shuffles_none_of_their_roles(spark):
    """the map was found among all members, which then met it by four keys."""
    plan = plan_of(lookups.j11(spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"FileScan", plan)) == 2 and "hashpartitioning(role" not in plan


def test_vector_scores_broadcast_nothing_of_the_questions_size(spark):
    """lengths and kinds, one row a question, were broadcast where their file is small."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.col("p_partkey").alias("question_id"), F.lit(1).cast("long").alias("slot"), F.lit(1).cast("long").alias("v"))
    few = spark.createDataFrame([("r", 1, 1)], "relation string, slot long, v long")
    kinds = part.select("question_id", F.lit("r").alias("relation"), F.lit(2).alias("n"))
    made = questions.score_relations_by_vectors(part, few, few, kinds)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan
    assert {round(r.score, 9) for r in made.collect()} == {1.04}


def test_equal_mentions_in_equal_contexts_are_resolved_once(spark):
    """each mention met the cues of all its candidates."""
    said = [(i, m, c) for i, (m, c) in enumerate([("Ring", "by A now"), ("ring", "by B now"), ("Ring", None), (None, "by A"), ("bolt", None), ("", "A"), ("nut", "by C")] * 3)]
    mentions = spark.createDataFrame(said, "mention_id long, mention string, context string")
    keys = spark.createDataFrame([(1, "ring"), (2, "ring"), (3, "bolt")], "uid long, key string")
    cues = spark.createDataFrame([(1, "A "), (2, "B "), (3, "x")], "uid long, cue string")
    got = sorted(map(tuple, resolution.resolve_in_context(mentions, keys, cues).collect()))
    want = resolution.settle(resolution.by_context(resolution.resolve_exact(mentions, keys), mentions.select("mention_id", "context"), cues))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 9


def test_opposite_edges_and_short_chains_need_no_search(spark, monkeypatch):
    """both went through chains, labels and components."""
    monkeypatch.setattr(analysis, "cycle_nodes", None)
    frame = lambda edges: spark.createDataFrame(edges, "e1 string, e2 string")
    chains = [(f"{c}-{k}", f"{c}-{k + 1}") for c in range(5) for k in range(c + 3)] + [("x", None), (None, "y")]
    assert not analysis.has_cycle(frame(chains)) and not analysis.has_cycle(frame(chains).limit(0))
    assert analysis.has_cycle(frame([*chains, ("0-1", "0-0")])) and analysis.has_cycle(frame([*chains, ("z", "z")]))


def test_rings_and_long_chains_are_still_told_apart(spark):
    ring = [(k, (k + 1) % 40) for k in range(40)]
    frame = lambda edges: spark.createDataFrame(edges, "e1 long, e2 long")
    assert analysis.has_cycle(frame(ring + [(100, 3), (7, 101)])) and not analysis.has_cycle(frame([e for e in ring if e[1]] + [(39, 102)]))


def test_pairs_of_wide_rows_equal_those_of_members(spark):
    """facts were taken apart and gathered again before their pairs were made."""
    draw = random.Random(5)
    rows = [(f"f{i}", *[draw.choice(["a", "b", "c", "d", "e", None]) for _ in range(3)], draw.random()) for i in range(40)]
    facts, roles = spark.createDataFrame(rows, "fid string, x string, y string, z string, w double"), [(c, c.upper()) for c in "xyz"]
    members, wide = graph.incidence(facts, roles), graph.together(facts, roles, keep=("w",))
    assert "Exchange" not in plan_of(wide)
    assert sorted(map(tuple, graph.row_mesh(wide).collect())) == sorted(map(tuple, graph.mesh(members, facts).collect()))
    assert sorted(map(tuple, graph.row_neighbours(wide).collect())) == sorted(map(tuple, graph.neighbours(members).groupBy("uid").count().collect()))


def test_contributions_shuffle_members_once(spark):
    """members met their former messages and two tables of senders."""
    after = spark.createDataFrame([("r", "f", u, i, v, v) for i, (u, v) in enumerate([("a", 0.9), ("b", 0.2), ("c", 0.5)])] + [("r", "g", "a", 0, 0.8, 0.8)], "run_id string, fid string, uid string, pos int, v2f double, f2v double")
    got = belief.contributions(F.lit(0.5), after, 0.05)
    rows = belief.contributions(after.withColumn("f2v", F.lit(0.5)), after, 0.05)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and {(r.fid, r.uid): r.source for r in got.collect()} == {("f", "a"): "c", ("f", "b"): "a", ("g", "a"): None}


def test_bounded_hypernodes_are_read_once(spark):
    """members were counted by a window, and read again for the arities beyond the exact ones."""
    rows = spark.createDataFrame([("r", f, f"{f}{i}", 0.2 * i if i else None, w) for f, n, w in (("f", 3, 0.7), ("g", 4, None), ("h", 1, 0.5)) for i in range(n)], "run_id string, fid string, uid string, p double, w double")
    some = nary.hypernode(rows, most=4)
    assert plan_of(some).count("Exchange") == 1
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, nary.hypernode(rows).collect())) and some.count() == 8


def test_fillers_are_computed_once(spark):
    """F32: a filter behind the roles computed every filler again, and each step of a key its words."""
    said = spark.createDataFrame([(1, "buys", {"SUBJECT": "the Red car", "OBJECT": "of the"}), (2, "buys", {"SUBJECT": "red Car", "WITH": "the"}), (3, "buys", {"OBJECT": "x1"}), (4, "Buys", {"SUBJECT": "red_car"}), (5, "buys", None)], "cand_id long, relation string, roles map<string,string>")
    done = ingest.finalize(said, ["the", "of"])
    assert [(r.cand_id, r.relation, r.roles) for r in done.collect()] == [(2, "BUYS", {"SUBJECT": "RED_CAR"})]
    assert plan_of(done).count("transform_values") <= 2


def test_open_facts_are_dealt_by_question_once(spark):
    """messages and nodes were dealt by node and by factor in every tick, and facts met their members twice."""
    plan = plan_of(asking.q7(spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Exchange hashpartitioning\(run_id", plan)) == 0 and len(re.findall(r"Exchange hashpartitioning\(fid", plan)) == 0
    assert len(re.findall(r"Exchange hashpartitioning\(question_id", plan)) <= 3


def test_answers_from_wide_facts_equal_those_from_members(spark):
    """wide facts had no way of their own. Questions with several anchors in a fact, none, and an unknown relation; facts of one and more members."""
    draw = random.Random(7)
    people = list("abcdefgh")
    facts = [(f"f{i}", draw.choice(["KNOWS", "OWNS"]), [(u, p, r, "bind", 1.0) for p, (u, r) in enumerate(zip(draw.sample(people, n), ["SUBJECT", "OBJECT", "LOCATION"], strict=False))]) for i, n in enumerate([2] * 20 + [3, 1])]
    wide = spark.createDataFrame(facts, "fid string, relation string, members array<struct<uid:string,pos:int,role:string,potential:string,w:double>>")
    rows = wide.select("fid", F.explode("members").alias("m")).select("fid", "m.*")
    asked = spark.createDataFrame([(1, "who knows a"), (2, "where owns b"), (3, "what owns c d"), (4, "what sells a"), (5, None), (6, "what knows")], "question_id long, question string")
    anchors = spark.createDataFrame([(1, "a", "a"), (2, "b", "b"), (3, "c", "c"), (3, "d", "d"), (3, "d", "dd"), (4, "a", "a"), (6, None, "x")], "question_id long, uid string, label string")
    said = lambda f, m: {r.question_id: (r.answer, r.relation, r.n_factors) for r in questions.ask(asked, anchors, f, m, ["what", "who", "where"]).collect()}
    got = said(wide, None)
    assert got == said(wide.select("fid", "relation"), rows) and len(got) == 6
    fills = lambda of, relation: sorted({u for _, r, ms in facts if r == relation and of & {m[0] for m in ms} for u, _, role, *_ in ms if role == "OBJECT" and u not in of})
    assert got[3][0] == ", ".join(fills({"c", "d"}, "OWNS")) != "" and {got[k] for k in (4, 5, 6)} == {("unknown", None, 0)}


def test_belief_in_place_equals_ticks(spark):
    """three ticks of two runs by windows and by tables of nodes."""
    draw = random.Random(9)
    rows = [(r, f"f{i}", f"n{u}", p, draw.choice(["bind", "is_a", "x"]), 0.9) for r in "pq" for i in range(12) for p, u in enumerate(draw.sample(range(6), 2))]
    m = spark.createDataFrame(rows, "run_id string, fid string, uid string, pos int, potential string, w double").withColumn("lam", F.when(F.col("uid") == "n1", 3.0).otherwise(0.0))
    got = {(r.run_id, r.uid): r.belief for r in belief.spread_in_place(m, 3).collect()}
    nodes = m.select("run_id", "uid", "lam").distinct().select("run_id", "uid", "lam", F.lit(0.5).alias("belief"), F.lit(0.0).alias("x"))
    messages = m.drop("lam").withColumns({"v2f": F.lit(0.5), "f2v": F.lit(0.5)})
    for _ in range(3):
        messages, nodes = belief.tick(messages, belief.fade(nodes))
    assert got == pytest.approx({(r.run_id, r.uid): r.belief for r in nodes.collect()}, abs=1e-9) and len(got) == 12


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_a_sieve_keeps_all_partners_and_few_others(spark, most):
    """all members were shuffled to meet the few that are anchors."""
    rows = spark.range(200_000).selectExpr("concat('u', id) as uid", "id % 2 as k").unionByName(spark.sql("select cast(null as string) as uid, 0L as k"))
    one = rows.filter("uid like '%77' and k = 1")
    left = hubs.sieve(rows, one, ["uid", "k"], most)
    assert left.columns == ["uid", "k"] and left.join(one, ["uid", "k"], "left_semi").count() == one.count() == 2000
    assert left.count() < 2000 + 200_000 * 0.1 and hubs.sieve(rows, one.limit(0), ["uid", "k"]).count() == 0


def test_equal_questions_meet_equal_chunks_once(spark):
    """a name that n customers have made n squared pairs of questions and lines."""
    draw, words = random.Random(11), ["alpha1", "bravo2", "charlie", "delta4", "echo55", "abc"]
    say = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(0, 4)))
    asked = spark.createDataFrame([*((i, say()) for i in range(40)), (90, None)], "question_id long, question string")
    held = spark.createDataFrame([*((i, say()) for i in range(60)), (90, None)], "chunk_id long, body string")
    for k, least in ((1, 1), (3, 1), (4, 2)):
        got, want = (sorted(map(tuple, questions.best_chunks(asked, held, k, least, repeated=r).collect())) for r in (True, False))
        assert got == want and got
    same = lambda key, text: spark.range(300).select(F.col("id").alias(key), F.lit("number alpha1").alias(text))
    made = [max(_joined_rows(questions.best_chunks(same("question_id", "question"), same("chunk_id", "body"), 1, 1, repeated=r))) for r in (True, False)]
    assert made[0] <= 600 and made[1] == 2 * 90_000


def test_runs_that_converge_are_columns_of_a_message(spark, monkeypatch):
    """each run had its own messages and nodes, which met in every tick."""
    draw = random.Random(13)
    links = [(f"f{i}", f"n{u}", p, draw.choice(["follow", "is_a", "x"]), draw.random()) for i in range(15) for p, u in enumerate(draw.sample(range(8), 2))]
    links += [("p", "n1", 0, "prior", 2.0), ("o", "n2", 0, "obs", 1.5), ("twice", "n3", 0, "bind", 0.7), ("twice", "n3", 1, "bind", 0.7)]
    members = spark.createDataFrame(links, "fid string, uid string, pos int, potential string, w double")
    evidence = spark.createDataFrame([("weak", "n0", 0.001), ("middle", "n0", 0.05), ("middle", "n5", 1.0), ("strong", "n4", 3.0), ("strong", "elsewhere", 3.0)], "run_id string, uid string, lam double")
    found = lambda ticks, epsilon: {(r.run_id, r.uid): (r.ticks, pytest.approx(r.belief, abs=1e-9), pytest.approx(r.x, abs=1e-9)) for r in belief.converge(members, evidence, ticks, epsilon).collect()}
    cases = [(9, 0.05), (4, 0.12), (1, 1.0), (3, 0.0)]
    with monkeypatch.context() as m:
        m.setattr(belief, "WIDE", 0)
        want = [found(*c) for c in cases]
    monkeypatch.setattr(belief, "tick", None)
    assert [found(*c) for c in cases] == want and all(len(w) == 24 for w in want)
    assert len({t for t, *_ in want[0].values()}) > 1


def test_wide_factors_meet_in_few_large_tiles(spark, tmp_path):
    """a pair of tiles of 16 members was a row, some 100 million of them, and could be broadcast."""
    spark.range(1100).selectExpr("id as p_partkey", "'one' as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3).selectExpr("id as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    pairs = registered.j5_wide(spark, str(tmp_path))
    assert max(_joined_rows(pairs)) <= 1103 and "SortMergeJoin" in plan_of(pairs)
    assert pairs.count() == pairs.filter("e1 < e2").distinct().count() == 1100 * 1099 // 2 + 3


def _joined_rows(df):
    """Numbers of rows that the joins of a plan make."""
    df.collect()
    out, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        nodes += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    return out
