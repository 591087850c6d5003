"""Core operators against small hand-made cases and plain-Python references."""

import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as fn
from factloom.operators import analysis, belief, graph, paths, propagation, ranking, state, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, fn.logistic(F.lit(-800.0))) == 0.0
    assert one(spark, fn.logistic(F.lit(800.0))) == 1.0
    assert one(spark, fn.canonical_label(F.lit(" buys -- from "))) == "BUYS_FROM"
    assert one(spark, fn.canonical_label(F.lit(None).cast("string"))) == "RELATED_TO"
    assert one(spark, fn.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0
    assert one(spark, fn.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx(1.0)


def test_propagate_two_nodes(spark):
    members = spark.createDataFrame([("f", "a", 0), ("f", "b", 1)], "fid string, uid string, pos int")
    factors = spark.createDataFrame([("f", 1.0, 1.0, 0.5, 0.1, 0.5, 0.1)], "fid string, w double, confidence double, forward double, backward double, selectivity double, decay double")
    evidence = spark.createDataFrame([("r", "a", 1.0)], "run_id string, uid string, x double")
    got = {r.uid: r.x for r in propagation.propagate(members, factors, evidence, steps=2).collect()}
    a, b = 1.0, 0.0
    for _ in range(2):
        a, b = min(1, a * 0.9 + b * 0.1), min(1, b * 0.9 + a * 0.5)
    assert got["a"] == pytest.approx(a) and got["b"] == pytest.approx(b)


def test_union_of_runs_is_separate_runs(spark):
    members = spark.createDataFrame([("f", "a", 0), ("f", "b", 1), ("g", "b", 0), ("g", "c", 1)], "fid string, uid string, pos int")
    factors = spark.createDataFrame([("f", 0.7, 1.0, 0.5, 0.1, 0.5, 0.1), ("g", 0.4, 1.0, 0.6, 0.2, 0.5, 0.2)], "fid string, w double, confidence double, forward double, backward double, selectivity double, decay double")
    rows = [("r1", "a", 1.0), ("r2", "c", 0.5)]
    schema = "run_id string, uid string, x double"
    together = sorted(map(tuple, propagation.propagate(members, factors, spark.createDataFrame(rows, schema), 3).collect()))
    apart = sorted(tuple(r) for row in rows for r in propagation.propagate(members, factors, spark.createDataFrame([row], schema), 3).collect())
    assert [x[:2] for x in together] == [x[:2] for x in apart]
    assert [x[2] for x in together] == pytest.approx([x[2] for x in apart])


def chain(ticks):
    """Plain-Python chain A-B-C-D of follow factors, evidence 3 on A."""
    names, links = "ABCD", [(0, 1), (1, 2), (2, 3)]
    v = {(k, i): 0.5 for k, ends in enumerate(links) for i in ends}
    f, x, lam = dict(v), [0.0] * 4, [3.0, 0, 0, 0]
    for _ in range(ticks):
        lam = [y * 0.5 if y * 0.5 >= 1e-6 else 0.0 for y in lam]
        new_v = {}
        for k, i in v:
            one_, zero = math.exp(lam[i]), 1.0
            for (m, j), p in f.items():
                if j == i and m != k:
                    one_, zero = one_ * p, zero * (1 - p)
            new_v[k, i] = 0.6 * one_ / (one_ + zero) + 0.4 * v[k, i]
        v = new_v
        f = {(k, i): 0.6 * (0.5 + (v[k, sum(links[k]) - i] - 0.5) * (0.8 if i == links[k][1] else 0.1)) + 0.4 * f[k, i] for k, i in v}
        x = [min(1, max(0, 0.9 * x[i] + 0.5 * sum(max(0, 2 * p - 1) for (_, j), p in f.items() if j == i) + 1 - math.exp(-lam[i]))) for i in range(4)]
    return dict(zip(names, x, strict=True))


def test_belief_chain(spark):
    rows = [("l1", "A", 0), ("l1", "B", 1), ("l2", "B", 0), ("l2", "C", 1), ("l3", "C", 0), ("l3", "D", 1)]
    members = spark.createDataFrame(rows, "fid string, uid string, pos int").withColumns({"potential": F.lit("follow"), "w": F.lit(1.0)})
    evidence = spark.createDataFrame([("r", "A", 3.0)], "run_id string, uid string, lam double")
    got = {r.uid: r.x for r in belief.run(members, evidence, ticks=4).collect()}
    assert got == pytest.approx(chain(4))


def test_graph_helpers(spark):
    members = spark.createDataFrame([("f", "a", 0, "S"), ("f", "b", 1, "O"), ("g", "b", 0, "S"), ("g", "a", 1, "O"), ("g", "c", 2, "X")], "fid string, uid string, pos int, role string")
    weights = spark.createDataFrame([("f", 0.5), ("g", 0.9)], "fid string, w double")
    assert sorted(map(tuple, graph.mesh(members, weights).collect())) == [("a", "b", 0.5), ("a", "c", 0.9), ("b", "c", 0.9)]
    assert graph.neighbours(members).count() == 6
    assert graph.signature(members).first().signature == graph.signature(members.orderBy(F.rand(1))).first().signature


def test_analysis(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0), ("z", "a", 0.0)], "e1 string, e2 string, w double")
    roots = spark.createDataFrame([("a",)], "uid string")
    assert {r.uid: r.hops for r in analysis.reachable(edges, roots).collect()} == {"a": 0, "b": 1, "c": 2, "z": 1}
    nodes = spark.createDataFrame([(c,) for c in "bcxyzq"], "uid string")
    assert sorted(r.uid for r in analysis.orphans(nodes, edges, roots).collect()) == ["q", "x", "y", "z"]
    assert not analysis.has_cycle(edges)
    assert analysis.has_cycle(edges.union(spark.createDataFrame([("c", "a", 1.0)], edges.schema)))
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(59)], "e1 string, e2 string, w double")
    nodes = spark.createDataFrame([(f"n{i:02d}", 0) for i in range(60)] + [("far", 0)], "uid string, added_at int")
    kept, _, fate = paths.collect_garbage(nodes, chain, nodes.filter("uid = 'n00'"), 100, 10)
    assert [tuple(r) for r in fate.collect()] == [("far", "removed")] and kept.count() == 60
    assert analysis.reachable(chain, nodes.filter("uid = 'n00'")).agg(F.max("hops")).first()[0] == 59
    assert sorted(map(tuple, analysis.closure(edges.filter("w > 0")).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("x", "y", 1)]


def test_state_and_ranking(spark):
    ops = spark.createDataFrame([("k", 1, "set", "u"), ("k", 2, "delete", None), ("k", 3, "set", "v"), ("j", 1, "set", "w"), ("j", 2, "delete", None)], "key string, seq int, op string, value string")
    assert [tuple(r) for r in state.fold_set_delete(ops).collect()] == [("k", "v")]
    assert [(r.before, r.after) for r in state.transitions(ops).filter("key = 'k'").orderBy("seq").collect()] == [(None, "u"), ("u", None), (None, "v")]
    gains = spark.createDataFrame([("p", "x", "gain", 1), ("p", "y", "gain", 2), ("p", "x", "give", 3), ("p", "x", "gain", 4), ("p", "y", "give", 5)], "owner string, item string, op string, seq int")
    assert [tuple(r) for r in state.holdings(gains).collect()] == [("p", "x", 4)]
    scores = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.49), ("r", "c", 1.0), ("r", "d", 1.0)], "g string, k string, s double")
    assert {r.g: (r.k, r.accepted) for r in ranking.rank_with_margin(scores, "g", "k", "s", 0.1, 0.05).collect()} == {"q": ("a", False), "r": ("c", True)}


def test_text_and_vectors(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " x ")], "doc_id long, text string")
    assert sorted(map(tuple, text.chunks(docs, 3, 1).collect())) == [(1, 0, "a b c"), (1, 1, "c d e"), (3, 0, "x")]
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.q, r.vec_id) for r in vectors.knn(rows.filter("vec_id = 0"), rows, 1).collect()] == [(0, 1)]


def test_large_factors_are_dealt_into_tiles(spark):
    """A third of all memberships in one factor: pairs as without tiles, and no array beyond some tiles' size."""
    rows = [("big", f"u{i:03d}") for i in range(200)] + [("big", "u000"), ("one", "u000")] + [(f"f{i % 80}", f"u{i % 170:03d}") for i in range(400)]
    members = spark.createDataFrame(rows, "fid string, uid string")
    sets = {}
    for f, u in rows:
        sets.setdefault(f, set()).add(u)
    want = sorted((f, a, b) for f, s in sets.items() for a in s for b in s if a < b)
    got = sorted(tuple(r) for r in graph.co_members(members, size=16).collect())
    assert got == want == sorted(tuple(r) for r in graph.co_members(members).collect())
    assert got == sorted(tuple(r) for r in graph.co_members(members, most=200).collect())
    sizes = [len(r.all) for r in graph.tiles(members, 16).filter("fid = 'big'").collect()]
    assert sum(sizes) == 200 and len(sizes) == 13 and max(sizes) < 40
    weights = spark.createDataFrame([(f, 1.0 + len(f)) for f in sets], "fid string, w double")
    first = {}
    for f, a, b in want:
        first[a, b] = min(first.get((a, b), "z"), f)
    assert {(r.e1, r.e2): r.w for r in graph.mesh(members, weights, 16).collect()} == {p: 1.0 + len(f) for p, f in first.items()}
    assert graph.neighbours(members, 16).count() == 2 * len(first)
    assert graph.co_members(members.limit(0)).count() == 0


def test_a_factor_of_many_members_is_spread_over_tasks(spark):
    members = spark.range(100_000).select(F.lit("f").alias("fid"), F.col("id").alias("uid"))
    sizes = graph.tiles(members).select(F.size("all").alias("n")).collect()
    assert len(sizes) == 196 and max(r.n for r in sizes) < 1024 and sum(r.n for r in sizes) == 100_000


def test_more_runs_than_are_broadcast_give_the_same_rows(spark, monkeypatch):
    members = spark.createDataFrame([("l1", "A", 0), ("l1", "B", 1), ("l2", "B", 0), ("l2", "C", 1)], "fid string, uid string, pos int").withColumns({"potential": F.lit("follow"), "w": F.lit(1.0)})
    evidence = spark.createDataFrame([(f"r{i}", "ABC"[i % 3], 1.0 + i / 10) for i in range(25)], "run_id string, uid string, lam double")
    rows = lambda: sorted((r.run_id, r.uid, round(r.x, 9)) for r in belief.run(members, evidence, ticks=2).collect())
    few = rows()
    monkeypatch.setattr(belief, "MAX_RUNS", 4)
    assert rows() == few and len(few) == 75
