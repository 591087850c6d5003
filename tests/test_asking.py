"""Phrases, plug-ins, sweeps, several hops and approximate neighbours on small inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import belief, evaluation, ingest, plugins, questions, resolution, vectors


def test_longest_phrases_against_a_loop(spark):
    rng = random.Random(1)
    letters = "a b c d".split()
    phrases = sorted({" ".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(20)})
    texts = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))) for i in range(25)] + [(90, None), (91, "A,  b!")]
    got = resolution.longest_phrases(resolution.phrase_matches(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(list(enumerate(phrases)), "uid long, phrase string"))).collect()
    found = {}
    for r in got:
        found.setdefault(r.text_id, []).append((r["rank"], r.start, r.width, r.uid))
    for uid, text in texts:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        hits = sorted((-len(p.split()), s, k) for k, p in enumerate(phrases) for s in range(len(words)) if words[s : s + len(p.split())] == p.split())
        kept = []
        for wide, start, k in hits:
            if len(kept) < 8 and all(start >= s + w or start - wide <= s for s, w, _ in kept):
                kept.append((start, -wide, k))
        assert [t[1:] for t in sorted(found.get(uid, []))] == kept


def test_sweep_agrees_with_single_runs(spark):
    members = spark.createDataFrame([(f"f{i}", f"n{i + p}", p, "assoc", 1.0) for i in range(3) for p in (0, 1)], "fid string, uid string, pos int, potential string, w double")
    start = spark.createDataFrame([("n0", 3.0)], "uid string, lam double")
    grid = spark.createDataFrame([("a", "linear", 0.1, 0.4), ("b", "relu", 0.05, 0.8)], "run_id string, activation string, decay double, association double")
    swept = {(r.run_id, r.uid): r.x for r in belief.sweep(members, start, grid, 3).filter("tick = 3").collect()}
    alone = {r.uid: r.x for r in belief.run(members, start.withColumn("run_id", F.lit("a")), 3).collect()}
    assert len(swept) == 8 and all(swept["a", uid] == pytest.approx(x, abs=1e-12) for uid, x in alone.items())
    assert swept["b", "n1"] > swept["a", "n1"]


def test_activations_and_gates(spark):
    row = spark.range(1).select(F.lit(0.5).alias("x"), F.lit(-1.0).alias("z"), F.lit(0.2).alias("e"))
    at = lambda name: row.select(belief.activate(F.lit(name), F.col("x"), F.col("z"), F.col("e"), F.lit(0.5), F.lit(0.1)).alias("v")).first().v
    assert at("linear") == pytest.approx(0.15) and at("relu") == pytest.approx(0.45) and at("sigmoid") == pytest.approx(1 / (1 + np.exp(0.3))) and at("other") is None
    messages = spark.createDataFrame([("r", "f", "a", 0, "bind", 1.0, 0.9, 0.5, g) for g in (None,)] + [("r", "f", "b", 1, "bind", 1.0, 0.5, 0.5, 1.0)], "run_id string, fid string, uid string, pos int, potential string, w double, v2f double, f2v double, gate double")
    got = {r.uid: r.f2v for r in belief.to_member(messages, 0.0).collect()}
    assert got["a"] == 0.5 and got["b"] == pytest.approx(0.5 + 0.8 * 0.4)
    with pytest.raises(ValueError):
        belief.compete(messages, "local")


def extractor(batch):
    if (batch["text"] == "bad").any():
        raise KeyError("no")
    return batch[["text_id"]].assign(relation="R", roles=[{"SUBJECT": t} for t in batch["text"]], kind="assertion", confidence=1.5)


def embedder(batch):
    return batch.assign(embedding=[[float(len(t))] for t in batch["text"]])


def test_plugins(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "a")], "text_id long, text string")
    rows = {r.text_id: r for r in plugins.extract_or_report(texts, extractor).collect()}
    assert set(rows) == {1, 2, 4} and rows[2].error.startswith("KeyError") and rows[1].roles == {"SUBJECT": "a"} and rows[1].error is None
    vectors_ = {r.text_id: r.embedding for r in plugins.embed(texts.withColumn("embedding", F.lit("clash")), embedder).collect()}
    assert vectors_ == {1: [1.0], 2: [3.0], 3: None, 4: [1.0]}
    labels = spark.createDataFrame([("x",), ("x",), (None,)], "raw string")
    sure = plugins.normalize_external(labels, lambda b: pd.DataFrame({"raw": b["raw"], "canonical": "X", "confidence": 7.0})).collect()
    assert [(r.raw, r.canonical, r.confidence) for r in sure] == [("x", "X", 1.0)]
    assert plugins.extract_facts(texts.limit(0), extractor).count() == 0
    asked = spark.createDataFrame([(1, "q"), (2, "p")], "question_id long, question string")
    context = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "question_id long, rank int, body string")
    said = {r.question_id: r.answer for r in plugins.answer(asked, context, lambda b: pd.DataFrame({"question_id": b["question_id"], "answer": b["context"]})).collect()}
    assert said == {1: "first\n\nsecond", 2: ""}


def test_payloads(spark):
    rows = [(1, '{"kind": "question", "candidates": [{"relation": "r"}, {"relation": "a_b_c_d_e_f", "kind": "topic", "roles": {"SUBJECT": "x"}}]}'), (2, "not json"), (3, None), (4, '{"candidates": [{"relation": " ", "kind": "topic"}, {"relation": "r", "kind": "guess"}, {"relation": "r", "confidence": 0.1}]}')]
    got = [(r.text_id, r.no, r.relation, r.kind, r.confidence) for r in ingest.from_payload(spark.createDataFrame(rows, "text_id long, payload string")).orderBy("text_id", "no").collect()]
    assert got == [(1, 1, "DISCUSSES", "topic", 0.8), (4, 2, "R", "assertion", 0.1)]


def test_heads(spark):
    words = spark.createDataFrame([("the red car",), ("slowly",), ("",), (None,), ("one two three four five",), ("x",), ("7",)], "w string")
    assert [r.h for r in words.select(ingest.head_entity(F.col("w"), ["the"]).alias("h")).collect()] == ["RED_CAR", None, None, None, "TWO_THREE_FOUR_FIVE", None, "7"]


def test_hops_of_half_reach_four(spark):
    """Each hop halves; five hops fall below the threshold."""
    links = [(f"{c}l{i}", f"{c}n{i + p}", p) for c in range(1, 6) for i in range(6) for p in (0, 1)]
    members = spark.createDataFrame(links, "fid string, uid string, pos int")
    factors = members.select("fid").distinct().select("fid", *[F.lit(v).alias(k) for k, v in (("w", 1.0), ("confidence", 1.0), ("forward", 0.5), ("backward", 0.0), ("selectivity", 0.5), ("decay", 0.0))])
    cases = spark.createDataFrame([(c, f"{c}n0", f"{c}n{c}", c) for c in range(1, 6)], "case_id long, seed string, target string, depth long")
    got = {r.case_id: r for r in questions.multi_hop(members, factors, cases, 5, 0.05).collect()}
    assert [got[c].answered for c in range(1, 6)] == [True, True, True, True, False]
    assert list(got[3].trace) == ["3l0", "3l1", "3l2"]


def test_extract_answer(spark):
    asked = spark.createDataFrame([(1, "Where is the red harbour?"), (2, "Who?"), (3, "Which planet orbits backwards?"), (4, None)], "question_id long, question string")
    held = spark.createDataFrame([(1, 1, "Ships. Many."), (1, 2, "The red harbour is in Oslo. It is old."), (3, 1, "Nothing fits"), (4, 1, "x")], "question_id long, rank int, body string")
    got = {r.question_id: r.answer for r in questions.extract_answer(asked, held).collect()}
    assert got == {1: "The red harbour is in Oslo.", 2: "unknown", 3: "unknown", 4: "unknown"}


def test_gold_eval(spark):
    rows = [(1, "It is Oslo", ["a"], "oslo", ["a"], False), (2, "unknown", [], "x", ["a"], True), (3, "Rome", [], "oslo", ["a"], False), (4, None, [], "oslo", [], False)]
    got = evaluation.gold_eval(spark.createDataFrame(rows, "case_id long, answer string, trace array<string>, keyword string, gold_trace array<string>, trap boolean")).orderBy("case_id").collect()
    assert [(r.hit, r.explained, r.hallucinated) for r in got] == [(True, True, False), (True, False, False), (False, False, True), (False, False, False)]


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    points = [(i, (centres[i % 30] + 0.3 * rng.normal(size=32)).tolist()) for i in range(600)]
    rows = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 20 = 0")
    exact = {(r.q, r.vec_id) for r in vectors.knn(asked, rows, 5).collect()}
    near = {(r.q, r.vec_id) for r in vectors.knn_approximate(asked, rows, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_cells_find_neighbours_of_scattered_and_equal_vectors(spark):
    """Half the rows have no close neighbour; 1,000 are one vector, of which the smallest ids come first. Cells hold parts of the rows."""
    rng = np.random.default_rng(4)
    scattered = rng.normal(size=(3000, 16))
    points = np.vstack([scattered, np.tile(scattered[:1], (1000, 1))])
    rows = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(points)), (9000, [0.0] * 16), (9001, None)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 20 = 0")
    pairs = lambda found: {(r.q, r.vec_id) for r in found.collect()}
    exact, found = pairs(vectors.knn(asked.filter("vec_id < 9000"), rows.filter("vec_id < 9000"), 10)), vectors.knn_approximate(asked, rows, 10)
    near = pairs(found)
    assert len(exact & near) >= 0.9 * len(exact)
    assert sorted(v for q, v in near if q == 0) == list(range(3000, 3010)) and not any(9000 in p for p in near)
    assert "BroadcastExchange" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan
    assert vectors.knn_approximate(asked, rows.limit(0), 10).count() == 0


def test_nearest_ties_and_blocks(spark, monkeypatch):
    """Equal rows in several blocks and batches: those of smallest ids, as the SQL's order has it."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(5000, 0, -1)] + [(0, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vectors.knn(rows.filter("vec_id % 300 = 0"), rows, 4).collect():
        got.setdefault(r.q, []).append((r["rank"], r.vec_id))
    assert len(got) == 16
    for q, found in got.items():
        assert [v for _, v in sorted(found)] == [v for v in range(1, 5001) if v % 3 == q % 3 and v != q][:4]


def test_a_product_is_bounded_by_its_blocks():
    """Whatever a batch holds: the products that a task makes have a block's rows at most."""
    rng = np.random.default_rng(5)
    own, rows = np.arange(vectors.ROW_BLOCK), vectors._normal(rng.normal(size=(vectors.ROW_BLOCK, 8)))
    ids, near = vectors._nearest(own[:5], rows[:5], own, rows, 3)
    want = rows[:5] @ rows.T
    want[np.arange(5), np.arange(5)] = -2
    assert [sorted(x) for x in ids.tolist()] == [sorted(np.argsort(-w)[:3].tolist()) for w in want] and near.shape == (5, 3)
