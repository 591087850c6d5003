"""Propagation over factors that are rows: the states of propagation over their members."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, propagation

ROLES = ["subject", "object", "source"]
FIELDS = "fid string, subject long, object long, source long, w double, confidence double, forward double, backward double, selectivity double, decay double"


def purchases(spark, alike=False):
    draw = random.Random(4)
    rows = [(f"f{i}", draw.choice([None, *range(12)]), draw.randrange(40), 0 if i % 2 else draw.randrange(5), draw.random() / 4, 0.9, 0.5, 0.1, 0.5, 0.05 if alike or i % 3 else 0.2) for i in range(120)]
    rows = spark.createDataFrame(rows, FIELDS)
    start = spark.createDataFrame([("a", 0, k, k / 30) for k in range(12)] + [("b", 1, 3, 0.5), ("b", 0, 99, 0.4), (None, 2, 0, 0.3)], "run_id string, role int, node long, x double")
    return rows, start


def by_members(rows, start, steps, kernel):
    """Nodes of a role are named for it, so that no two roles have one."""
    name = lambda role, node: F.concat(F.element_at(F.array(*[F.lit(r) for r in ROLES]), role + 1), node)
    members = graph.incidence(rows.select("fid", *[name(F.lit(i), F.col(r)).alias(r) for i, r in enumerate(ROLES)]), [(r, r) for r in ROLES])
    got = propagation.propagate(members, rows.drop(*ROLES), start.select("run_id", name(F.col("role"), F.col("node")).alias("uid"), "x"), steps, kernel)
    return {(kernel, r.run_id, r.uid): r.x for r in got.collect()}


def of(rows):
    return {(r.kernel, r.run_id, f"{ROLES[r.role]}{r.node}"): r.x for r in rows.collect()}


@pytest.mark.parametrize("alike, told, hub_rows", [(False, 0, 20), (True, 0, 100_000), (True, 100, 100_000), (False, 4_000_000, 100_000)])
def test_rows_equal_members(spark, alike, told, hub_rows):
    """With roles dealt, in parts for hubs and not, and told; with decays alike and not; of several kernels at once."""
    rows, start = purchases(spark, alike)
    kernels = ("linear", "sigmoid")
    want = {k: x for kernel in kernels for k, x in by_members(rows, start, 2, kernel).items()}
    got = of(propagation.propagate_rows(rows, ROLES, start, ["a", "b", None], 2, kernels, told=told, hub_rows=hub_rows))
    assert len(got) > 200 and got == pytest.approx(want, rel=1e-9)


def test_steps_and_wanted_roles(spark):
    rows, start = purchases(spark)
    every = propagation.propagate_rows(rows, ROLES, start, ["a", "b"], 3, every=True)
    assert of(every.filter("step = 2")) == pytest.approx({k: x for k, x in by_members(rows, start, 2, "linear").items() if k[1]}, rel=1e-9)
    parts = of(propagation.propagate_rows(rows, ROLES, start, ["a", "b"], 3, wanted=["object"], told=0))
    assert parts and parts == pytest.approx(of(every.filter("step = 3 and role = 1")), rel=1e-9)
    assert not of(propagation.propagate_rows(rows, ROLES, start.limit(0), ["a"], 2)) and not of(propagation.propagate_rows(rows.limit(0), ROLES, start.limit(0), ["a"], 2))
    with pytest.raises(ValueError):
        propagation.propagate_rows(rows, ROLES, start, list(range(17)), 1)


def test_a_step_deals_rows_by_large_roles_only(spark):
    """A row goes once to the states that are not told, never to its factor, and no member is dealt by itself."""
    rows, start = purchases(spark, True)
    every_role = start.filter("role = 0").unionByName(rows.select(F.lit("a").alias("run_id"), F.lit(1).alias("role"), F.col("object").alias("node"), F.lit(0.1).alias("x")))
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda told: propagation.propagate_rows(rows, ROLES, every_role, ["a", "b"], 1, told=told)._jdf.queryExecution().executedPlan().toString()
        dealt, small = plan(0), plan(1000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert "hashpartitioning(fid" not in dealt and dealt.count("REPARTITION_BY_NUM") == 2
    assert small.count("REPARTITION_BY_NUM") == 0 and small.count("BroadcastHashJoin") == 2


def test_the_purchase_queries_spread_over_rows(spark, monkeypatch):
    """Up to WIDE runs go over rows; more go over members and tell the same."""
    from factloom.plans import registered

    d = "/root/testdata/sf0.001"
    tell = lambda: {(r.run_id, r.step, r.uid): r.x for r in registered.spread(spark, d, ("linear",), 2, every=True).collect()}
    monkeypatch.setattr(registered, "_spread_members", None)
    rows = tell()
    monkeypatch.undo()
    monkeypatch.setattr(propagation, "WIDE", 2)
    assert {s for _, s, _ in rows} == {1, 2} and rows == pytest.approx(tell(), rel=1e-9)
