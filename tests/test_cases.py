"""Cases told and asked in order, and reports of explained paths, against loops."""

import random
from collections import deque

import pytest

from factloom.operators import evaluation, paths


@pytest.mark.parametrize("protocol", ["isolated", "sequential"])
def test_cases_equal_a_fold(spark, protocol):
    draw = random.Random(5)
    cases, told = [], []
    for session in (1, 2, 3):
        for seq in range(1, 9):
            cases.append((session, seq, draw.choice(["a", "b", None]), draw.choice(["R", "Q"])))
            told += [(session, seq, len(told) + k, draw.choice(["a", "b", None]), draw.choice(["R", "Q"]), draw.choice(["x", "y", None])) for k in range(draw.randint(0, 2))]
    a = spark.createDataFrame(cases, "session long, seq long, subject string, relation string")
    b = spark.createDataFrame(told, "session long, seq long, fid long, subject string, relation string, object string")
    want = {}
    for session, seq, subject, relation in cases:
        held = sorted((n, f, o) for s, n, f, u, r, o in told if s == session and (n == seq or (protocol == "sequential" and n < seq)) and u is not None and (u, r) == (subject, relation) and o is not None)
        want[session, seq] = (held[-1][2], [held[-1][1]], len(held)) if held else ("unknown", [], 0)
    got = {(r.session, r.seq): (r.answer, r.trace, r.n_known) for r in evaluation.answer_cases(a, b, protocol).collect()}
    assert got == want
    assert evaluation.answer_cases(a, b.limit(0), protocol).filter("answer <> 'unknown'").count() == 0 == evaluation.answer_cases(a.limit(0), b, protocol).count()


def test_protocols_differ_and_others_are_refused(spark):
    a = spark.createDataFrame([(1, 1, "a", "R", "extra"), (1, 2, "a", "R", "more")], "session long, seq long, subject string, relation string, note string")
    b = spark.createDataFrame([(1, 1, 7, "a", "R", "x")], "session long, seq long, fid long, subject string, relation string, object string")
    one, two = ([(r.note, r.answer) for r in evaluation.answer_cases(a, b, p).orderBy("seq").collect()] for p in ("isolated", "sequential"))
    assert one == [("extra", "x"), ("more", "unknown")] and two == [("extra", "x"), ("more", "x")]
    with pytest.raises(ValueError):
        evaluation.answer_cases(a, b, "other")


def test_report_of_paths_and_isolated_seeds(spark):
    draw = random.Random(6)
    uids = [f"n{i:02d}" for i in range(40)]
    belief = {u: draw.randint(0, 99) / 100 for u in uids}
    factors = {f"f{i:02d}": draw.sample(uids, draw.choice([2, 2, 3])) for i in range(24)}
    seeds = draw.sample(uids, 6)
    depth, queue = dict.fromkeys(seeds, 0), deque(seeds)
    while queue:
        u = queue.popleft()
        if depth[u] < 4:
            for v in {v for f in factors.values() if u in f for v in f} - depth.keys():
                if belief[v] >= 0.2:
                    depth[v] = depth[u] + 1
                    queue.append(v)
    m = spark.createDataFrame([(f, u) for f, us in factors.items() for u in us], "fid string, uid string")
    w = spark.createDataFrame([(f, draw.random()) for f in factors], "fid string, w double")
    b = spark.createDataFrame(list(belief.items()), "uid string, belief double")
    s = spark.createDataFrame([(u,) for u in seeds], "uid string")
    reached = paths.explain(m, w, b, s, 4, 0.2)
    rows = {r.uid: r for r in reached.collect()}
    assert {u: r.depth for u, r in rows.items()} == depth
    for u, r in rows.items():
        assert len(r.nodes) == r.depth + 1 and r.nodes[0] in seeds and r.nodes[-1] == u and r.path == " > ".join(r.nodes)
        assert all(any({x, y} <= set(f) for f in factors.values()) for x, y in zip(r.nodes, r.nodes[1:], strict=False))
    for most in (3, 100):
        shown = [u for u in sorted(depth, key=lambda u: (-belief[u], u)) if belief[u] > 0.6][:most]
        on = {n for u in shown for n in rows[u].nodes}
        alone = [u for u in sorted(seeds, key=lambda u: (-belief[u], u)) if u not in on]
        got = [(r.uid, r.isolated) for r in paths.explanations(reached, b, s, 0.6, most).orderBy("rank").collect()]
        assert got == [*((u, False) for u in shown), *((u, True) for u in alone)][:most]
    top = paths.explanations(reached, b, s, 2.0, 12, 3)  # nothing is believed so much: the three most believed
    best = sorted(belief, key=lambda u: (-belief[u], u))[:3]
    assert [r.uid for r in top.filter("not isolated").orderBy("rank").collect()] == [u for u in best if u in depth]
