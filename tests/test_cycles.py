"""Nodes on cycles against search from every node, and runs that end when they have converged."""

import random

import pytest

from factloom.operators import analysis, belief


def on_cycles(edges):
    nodes, reach = {x for e in edges for x in e}, {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    on = {n for n in nodes if n in reach[n]}
    return on, {frozenset(m for m in on if m in reach[n] and n in reach[m]) for n in on}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycle_nodes(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(13)]
    for base in (100, 200, 300):  # chains and rings, some joined to the rest
        length = rng.randrange(2, 9)
        edges += [(base + k, base + k + 1) for k in range(length)]
        edges += [(base + length, base)] if rng.random() < 0.6 else [(base + length, rng.randrange(12)), (rng.randrange(12), base)]
    rows = analysis.cycle_nodes(spark.createDataFrame(edges + [(1, None), (None, 2)], "e1 long, e2 long")).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.component, set()).add(r.uid)
    on, expected = on_cycles(edges)
    assert sorted(r.uid for r in rows) == sorted(on) and {frozenset(p) for p in parts.values()} == expected


def test_a_long_path_has_no_cycle_and_a_long_ring_has(spark):
    path = spark.range(5000).selectExpr("id as e1", "id + 1 as e2")
    assert not analysis.has_cycle(path) and not analysis.has_cycle(path.limit(0))
    ring = path.selectExpr("e1", "e2 % 5000 as e2")
    assert analysis.cycle_nodes(ring).selectExpr("count(*)", "max(component)").first() == (5000, 0)


def test_runs_end_when_they_have_converged(spark):
    pairs = [("f0", "a", 0), ("f0", "b", 1), ("f1", "b", 0), ("f1", "c", 1)]
    members = spark.createDataFrame([(*p, "assoc", 1.0) for p in pairs], "fid string, uid string, pos int, potential string, w double")
    evidence = spark.createDataFrame([("still", "a", 0.0), ("soon", "a", 0.2), ("late", "a", 5.0), ("never", "a", 40.0)], "run_id string, uid string, lam double")
    rows = belief.converge(members, evidence, 9, 0.02).collect()
    ticks = {r.run_id: r.ticks for r in rows}
    assert len(rows) == 12 and ticks["still"] == 2 and ticks["still"] < ticks["soon"] < ticks["never"]
    # each run has what as many ticks give without a stop, and an earlier tick still moved
    for run_id, n in ticks.items():
        alone = evidence.filter(f"run_id = '{run_id}'")
        whole = {k: {r.uid: r.x for r in belief.run(members, alone, k).collect()} for k in (n - 1, n)}
        assert {r.uid: pytest.approx(r.x) for r in rows if r.run_id == run_id} == whole[n]
        if n < 9:
            assert max(abs(whole[n][u] - whole[n - 1][u]) for u in whole[n]) <= 0.02
    assert {r.ticks for r in belief.converge(members, evidence, 1, 1.0).collect()} == {1}


def test_a_sweep_ends_with_its_runs(spark):
    members = spark.createDataFrame([("f", "a", 0, "assoc", 1.0), ("f", "b", 1, "assoc", 1.0)], "fid string, uid string, pos int, potential string, w double")
    grid = spark.createDataFrame([("g", "linear", 0.1, 0.5)], "run_id string, activation string, decay double, association double")
    evidence = spark.createDataFrame([("a", 0.0)], "uid string, lam double")
    assert belief.sweep(members, evidence, grid, 4).agg({"tick": "max"}).first()[0] == 4
    assert belief.sweep(members, evidence, grid, 4, epsilon=0.01).agg({"tick": "max"}).first()[0] == 2


def test_runs_of_a_sweep_share_messages(spark):
    """Six runs of two associations: their history equals that of runs of their own, and no tick writes a row per run."""
    members = spark.createDataFrame([(f"f{i}", f"n{i + j}", j, "assoc", 1.0) for i in range(6) for j in (0, 1)], "fid string, uid string, pos int, potential string, w double")
    evidence = spark.createDataFrame([("n0", 3.0)], "uid string, lam double")
    grid = spark.createDataFrame([(f"{a}{s}", a, 0.1, s) for a in ("linear", "sigmoid", "relu") for s in (0.2, 0.8)], "run_id string, activation string, decay double, association double")
    rows = lambda df: {(r.run_id, r.tick, r.uid): r.x for r in df.collect()}
    shared = belief.sweep(members, evidence, grid, 3)
    got, apart = rows(shared), rows(belief.sweep(members, evidence, grid, 3, epsilon=-1.0))
    assert len(got) == 6 * 3 * 7 and got == pytest.approx(apart, rel=1e-9)
    heard = [spark.read.parquet(f).count() for f in {f.rsplit("/", 1)[0] for f in shared.inputFiles()}]
    assert heard == [2 * 7] * 3
