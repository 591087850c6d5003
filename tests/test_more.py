"""N-ary potentials, metrics, resolution, ingest, sources, paths and streams against loops and known answers."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation, ingest, nary, paths, questions, resolution, state_stream
from factloom.sources import files
from factloom.streaming import turns


def brute_exact(ps, target, w, mode, lam=0.5, strength=0.6):
    n, sides = len(ps), [0.0, 0.0]
    for bits in itertools.product((0, 1), repeat=n):
        chance = math.prod(p if b else 1 - p for i, (p, b) in enumerate(zip(ps, bits)) if i != target)
        k, full = sum(bits), float(all(bits))
        worth = {"and": full, "pairwise": k * (k - 1) / (n * (n - 1)) if n > 1 else float(k), "soft_and": k / n + lam * full}[mode]
        sides[bits[target]] += chance * math.exp(min(50.0, w * strength * worth))
    return sides[1] / sum(sides)


@pytest.mark.parametrize("mode", ["and", "pairwise", "soft_and"])
def test_exact_hypernode_equals_all_assignments(spark, mode):
    groups = {"a": [0.2, 0.9, 0.5, 0.7], "b": [0.3], "c": [1.0, 0.0], "d": [0.1 * k for k in range(1, 8)]}
    rows = [("r", f, f"{f}{i}", i, "X", p, 0.8) for f, ps in groups.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "run_id string, fid string, uid string, pos int, role string, p double, w double")
    got = {r.uid: r.message for r in nary.hypernode(df, mode).collect()}
    assert len(got) == len(rows)
    for f, ps in groups.items():
        for i in range(len(ps)):
            assert got[f"{f}{i}"] == pytest.approx(brute_exact(ps, i, 0.8, mode), abs=1e-9)


def test_large_hypernodes_are_approximate_and_nulls_count_as_half(spark):
    rows = [("r", "f", f"u{i}", i, "X", None if i == 0 else 0.5, 1.0) for i in range(15)]
    df = spark.createDataFrame(rows, "run_id string, fid string, uid string, pos int, role string, p double, w double")
    assert nary.hypernode(df, "pairwise").count() == 15
    assert nary.cause(df.filter("pos = 0")).collect()[0].message == 0.5


def test_trajectories_of_a_known_run(spark):
    xs = [0.0, 0.8, 0.2, 0.6, 0.3]
    h = spark.createDataFrame([("r", t, "a", x) for t, x in enumerate(xs)] + [("r", t, "b", 0.1) for t in range(5)], "run_id string, tick int, uid string, x double")
    r = evaluation.trajectories(h, 0.5, spark.createDataFrame([("a",)], "uid string")).collect()[0]
    assert (r.latency, r.peak, r.half_life, r.spread) == (1, 0.8, 1, 0)
    assert r.oscillation == pytest.approx((3 / 3 + 0) / 2)
    assert r.selectivity == pytest.approx(3.0) and r.convergence == pytest.approx(0.3)


def test_role_scores_of_the_known_example(spark):
    schema = "item int, role string, value string"
    want = spark.createDataFrame([(1, "SUBJECT", "a"), (1, "OBJECT", "b"), (2, "SUBJECT", "c"), (2, "OBJECT", "d")], schema)
    got = spark.createDataFrame([(1, "SUBJECT", "a"), (1, "OBJECT", "b"), (2, "SUBJECT", "x"), (2, "OBJECT", "d")], schema)
    rows = {r.role: r for r in evaluation.role_scores(want, got).collect()}
    assert rows["SUBJECT"].f1 == 0.5 and rows["OBJECT"].f1 == 1.0 and rows["LOCATION"].f1 == 0.0
    assert evaluation.weighted_role_score(evaluation.role_scores(want, got)).collect()[0].normalized == pytest.approx(3 / 5)


def test_trace_is_a_subsequence(spark):
    cases = [(["a", "b"], ["a", "x", "b"], True), (["b", "a"], ["a", "b"], False), ([], ["a"], True), (["a", "a"], ["a"], False), (["a", "a"], ["a", "c", "a"], True)]
    df = spark.createDataFrame([(w, g, e) for w, g, e in cases], "w array<string>, g array<string>, e boolean")
    assert all(r.got == r.e for r in df.select(evaluation.trace_complete(F.col("w"), F.col("g")).alias("got"), "e").collect())


def test_outcomes_follow_the_directives(spark):
    rows = [("u", "u", True, None, False), ("u", "v", True, None, False), (None, "v", False, None, False), ("u", "u", True, "u", False), ("u", "u", True, None, True), ("u", None, False, None, False)]
    df = spark.createDataFrame(rows, "want string, got string, neg boolean, banned string, reject boolean")
    out = [tuple(r) for r in df.select([c.alias(n) for n, c in evaluation.outcome(*[F.col(c) for c in ("want", "got", "neg", "banned", "reject")]).items()]).collect()]
    assert out == [(True, False, False, False), (False, True, True, False), (False, False, True, False), (False, True, False, False), (False, True, False, False), (False, False, False, True)]


def test_resolution_cascade_and_blank_mentions(spark):
    catalog = spark.createDataFrame([(1, "Julia Stone", ["JS"]), (2, "Moscow", None), (3, "Julian", [])], "uid int, name string, aliases array<string>")
    said = spark.createDataFrame([(1, "julia-stone"), (2, "Moscows"), (3, ""), (4, None), (5, "capital"), (6, "js")], "mention_id int, mention string")
    keys = resolution.catalog_keys(catalog)
    lexicon = spark.createDataFrame([("capital", "Moscow")], "surface string, canonical string")
    out = resolution.cascade(said, [("exact", lambda m: resolution.resolve_exact(m, keys)), ("inflected", lambda m: resolution.resolve_inflected(m, keys)), ("synonym", lambda m: resolution.resolve_synonym(m, lexicon, keys))])
    assert {(r.mention_id, r.uid, r.method) for r in out.collect()} == {(1, 1, "exact"), (2, 2, "inflected"), (5, 2, "synonym"), (6, 1, "exact")}


def test_ties_need_context(spark):
    hits = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0)], "mention_id int, uid int, score double")
    assert resolution.settle(hits).count() == 0
    cues = spark.createDataFrame([(10, "river"), (11, "money")], "uid int, cue string")
    said = spark.createDataFrame([(1, "the RIVER bank")], "mention_id int, context string")
    assert resolution.settle(resolution.by_context(hits, said, cues)).collect()[0].uid == 10


def test_segments_of_a_known_text():
    text = "Plain one. She bought: apples, pears (red, green); and figs.\nA; b (x; y)."
    got = [(kind, text[a:b]) for kind, a, b, _ in ingest.segment_text(text)]
    assert got == [("sentence", "Plain one"), ("list_item", "apples"), ("list_item", "pears (red, green)"), ("list_item", "and figs"), ("clause", "A"), ("clause", "b (x; y)")]


def test_segments_and_batches_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n. "), (4, "a" * 2000 + "\nb\n\nc")], "doc_id long, text string")
    assert {(r.doc_id, r.stop - r.start) for r in ingest.segments(docs).collect()} == {(4, 2000), (4, 1)}
    assert [(r.batch, len(r.body)) for r in ingest.paragraph_batches(docs.filter("doc_id <> 3")).orderBy("batch").collect()] == [(0, 2000), (1, 3)]
    assert ingest.segments(docs.limit(0)).count() == 0


def test_ingest_keeps_new_well_formed_facts(spark):
    rows = [(1, "has", {"SUBJECT": "a", "OBJECT": "b"}, "assertion", 0.9), (2, "HAS", {"OBJECT": "b", "SUBJECT": "a"}, "assertion", 0.8), (3, "has", {"SUBJECT": "a"}, "assertion", 0.9), (4, "has", {"SUBJECT": "a", "OBJECT": "c"}, "topic", 0.4), (5, None, {"SUBJECT": "a", "OBJECT": "c"}, "topic", 0.9)]
    c = spark.createDataFrame(rows, "cand_id int, relation string, roles map<string,string>, kind string, confidence double")
    out = ingest.ingest(c, c.limit(0), ["SUBJECT", "OBJECT"]).collect()
    assert [(r.relation, r.w) for r in out] == [("HAS", 0.5)]
    assert ingest.ingest(c, c.filter("cand_id = 2"), ["SUBJECT", "OBJECT"]).count() == 0


def test_ids_are_consecutive(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    out = ingest.assign_ids(df, ["k"], "E").orderBy("k").collect()
    assert [r.uid for r in out] == [f"E_{i:05d}" for i in range(1, 1001)]


def test_snapshot_defaults_and_round_trip(spark, tmp_path):
    doc = {"id": "g1", "name": "n", "kind": "fixture", "store": {"tau": 3, "S": {"s1": {"forms": ["x"]}}, "C": {"M_1": {"label": "X"}}, "L": {"l1": {"e1": "s1", "e2": "M_1"}}, "semantic_factors": [{"fid": "f1", "kind": "odd", "roles": {"SUBJECT": "M_1"}}], "state": {"k": "v"}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.json").write_text(json.dumps(doc, indent=1))
    parts = files.read_snapshots(spark, str(tmp_path / "in"))
    assert parts["factors"].collect()[0].kind == "hyper" and parts["links"].collect()[0].w == 1.0
    files.write_tables(parts, str(tmp_path / "out"))
    row = files.graph_catalog(files.read_tables(spark, str(tmp_path / "out"), ("graphs", "nodes", "links", "factors"))).collect()[0]
    assert (row.nodes, row.links, row.factors, row["size"]) == (2, 1, 1, 4)


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n{"id": "2"}\n{"id": "3", "text": " "}\n{"id": "4", "text": "x", "more": 1}\nnot json\n\n')
    from pyspark.sql.types import StructType

    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), StructType.fromDDL("id string, text string"), ["id", "text"])
    assert [r.id for r in good.collect()] == ["1"]
    assert sorted(r.reason for r in bad.collect()) == ["blank value", "missing key", "not an object", "unknown key"]


def test_redact_at_any_depth(spark):
    df = spark.sql("SELECT named_struct('Token', 'a', 'keep', array(map('token', 'b', 'x', 'c'))) AS s, 'd' AS token")
    r = files.redact(df, ["token"]).collect()[0]
    assert r.s.Token == "***" and r.s.keep == [{"token": "***", "x": "c"}] and r.token == "***"


def test_paths_prefer_fewer_hops(spark):
    m = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "b"), ("f2", "c"), ("f3", "c"), ("f3", "z")], "fid string, uid string")
    w = spark.createDataFrame([("f1", 1.0), ("f2", 1.0), ("f3", 1.0)], "fid string, w double")
    b = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5), ("z", 0.01)], "uid string, belief double")
    out = {r.uid: r for r in paths.explain(m, w, b, spark.createDataFrame([("a",)], "uid string")).collect()}
    assert out["c"].path == "a > b > c" and "z" not in out


def test_chains_and_answers(spark):
    steps = spark.createDataFrame([(1, 1, "a", "R", "b"), (1, 2, "b", "R", "c"), (2, 1, "a", "R", "b"), (2, 2, "x", "Q", "c")], "case_id int, pos int, subject string, relation string, object string")
    out = paths.chain_check(steps, spark.createDataFrame([(1, "c"), (2, "d")], "case_id int, answer string")).orderBy("case_id").collect()
    assert [tuple(r)[1:] for r in out] == [(True, True, True), (False, False, False)]
    q = spark.createDataFrame([(1, "Where is it?"), (2, None)], "question_id int, question string")
    assert [r.r for r in q.orderBy("question_id").select(questions.target_role(F.col("question")).alias("r")).collect()] == ["LOCATION", "OBJECT"]


def test_stream_of_a_folder_equals_the_batch(spark, tmp_path):
    spark.range(100).select((F.col("id") % 7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")).repartition(4).write.parquet(str(tmp_path / "t.parquet"))
    rows = state_stream.run(turns.recent_history(state_stream.source(spark, str(tmp_path / "t.parquet")), 3), "complete").collect()
    assert {r.conv_id: [h.turn for h in r.history] for r in rows} == {k: [i for i in range(100) if i % 7 == k][-3:] for k in range(7)}


def test_lemmas_rank_below_forms_and_above_first_words(spark):
    said = spark.createDataFrame([(1, "Mice"), (2, "mouse"), (3, "mouses"), (4, "house"), (5, " "), (6, None)], "mention_id long, mention string")
    keys = spark.createDataFrame([(10, "mouse"), (11, "house mouse")], "uid long, key string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("mouse", "mouse"), ("mouses", "mous"), ("mouses", "mouse"), (None, "x")], "form string, lemma string")
    got = {(r.mention_id, r.uid): r.score for r in resolution.resolve_by_lemma(said, keys, lemmas).collect()}
    assert got == {(1, 10): 0.95, (2, 10): 0.98, (3, 10): 0.93, (4, 11): 0.92}
    both = {(r.mention_id, r.uid): r.score for r in resolution.resolve_inflected(said, keys, lemmas).collect()}
    assert both == {**got, (4, 11): 0.92}


def test_kernels_and_potentials_can_be_added(spark, monkeypatch):
    from factloom.operators import belief, propagation

    monkeypatch.setitem(propagation.KERNELS, "half", lambda x, selectivity: x / 2)
    monkeypatch.setitem(belief.POTENTIALS, "strong", lambda later: F.lit(1.0))
    row = spark.range(1).select(propagation.kernel("half", F.lit(3.0), F.lit(0.5)).alias("k"), *[belief.strength(F.lit(p), F.lit(0.5), F.lit(1)).alias(p) for p in ("strong", "is_a", "other")]).first()
    assert (row.k, row.strong, row.is_a, row.other) == (0.5, 0.5, 0.45, 0.2)
    with pytest.raises(ValueError):
        propagation.kernel("none of these", F.lit(1.0), F.lit(0.5))


def test_vector_scores_weigh_labels_over_documents(spark):
    from factloom.operators import questions

    asked = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0), (2, 9, 1.0)], "question_id long, slot long, v double")
    labels = spark.createDataFrame([("A", 0, 2.0), ("B", 1, 1.0)], "relation string, slot long, v double")
    docs = spark.createDataFrame([("A", 1, 5.0), ("B", 1, 1.0)], "relation string, slot long, v double")
    kinds = spark.createDataFrame([(1, "A", 4), (1, "B", 0)], "question_id long, relation string, n long")
    got = {(r.question_id, r.relation): round(r.score, 9) for r in questions.score_relations_by_vectors(asked, labels, docs, kinds).collect()}
    assert got == {(1, "A"): round(0.7 * 0.6 + 0.3 * 0.8 + 0.08 * 0.75, 9), (1, "B"): 0.8}
