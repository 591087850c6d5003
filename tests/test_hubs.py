"""Hubs: dealt among tasks, with the rows of plain joins."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import belief, hubs, propagation


def star(spark, n=400):
    """A node and a factor that hold half of all members each, and pairs of others."""
    pairs = [(f"p{i}", u, pos) for i in range(n) for u, pos in ((f"n{i}", 0), ("hub", 1))]
    return spark.createDataFrame(pairs + [("all", f"n{i}", 1) for i in range(n)], "fid string, uid string, pos int")


def test_measure(spark):
    members = star(spark).unionByName(spark.createDataFrame([("x", None, 0)] * 900, "fid string, uid string, pos int"))
    assert [tuple(r) for r in hubs.measure(members, "uid", 100).collect()] == [("hub", 4)]
    assert hubs.measure(members, "uid", 400) is None and hubs.measure(members.limit(0), "uid") is None
    # more hubs than may be broadcast: only those with more than their share stay
    some = hubs.measure(members.filter("uid is not null"), "uid", 1, max_hubs=4).collect()
    assert [r.uid for r in some] == ["hub"]


def test_join_deals_a_hub_and_keeps_every_row(spark):
    members = star(spark)
    told = hubs.measure(members, "uid", 50)
    one = members.select("uid").distinct().withColumn("x", F.xxhash64("uid")).unionByName(spark.createDataFrame([(None, 1)], "uid string, x long"))
    got = hubs.join(members.unionByName(spark.createDataFrame([("y", None, 0)], members.schema)), one, ["uid"], told, "fid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, members.join(one, ["uid"]).collect()))
    # no part holds much more than a hub's share, and the join's key has the part
    part = F.pmod(F.xxhash64("fid"), F.lit(told.first().parts))
    assert members.filter("uid = 'hub'").groupBy(part).count().agg(F.max("count")).first()[0] < 100
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_propagation_with_hubs(spark):
    members = star(spark)
    factors = members.select("fid").distinct().select("fid", F.when(F.col("fid") == "all", 1e-4).otherwise(0.02).alias("w"), *[F.lit(v).alias(c) for c, v in (("confidence", 1.0), ("forward", 0.5), ("backward", 0.1), ("selectivity", 0.5), ("decay", 0.1))])
    start = spark.createDataFrame([("a", f"n{i}", i / 400) for i in range(0, 400, 3)] + [("b", "hub", 1.0)], "run_id string, uid string, x double")
    rows = lambda limit: {(r.run_id, r.uid): r.x for r in propagation.propagate(members, factors, start, 2, hubs=propagation.hubs_of(members, limit)).collect()}
    dealt, plain = rows(50), rows(10_000)
    assert all(h is not None for h in propagation.hubs_of(members, 50)) and propagation.hubs_of(members) == (None, None)
    assert propagation.hubs_of(members, 50, most=50)[1] is None
    assert len(plain) > 800 and dealt == pytest.approx(plain, rel=1e-9)


def test_belief_with_hubs(spark):
    members = star(spark).filter("fid <> 'all'").withColumn("potential", F.lit("follow")).withColumn("w", F.lit(1.0))
    start = spark.createDataFrame([("a", "n1", 3.0), ("b", "hub", 2.0), ("b", "n7", 1.0)], "run_id string, uid string, lam double")
    rows = lambda run, **more: {(r.run_id, r.uid): r.x for r in run(members, start, 3, **more).collect()}
    assert rows(belief.run, hub_rows=50) == pytest.approx(rows(belief.run), rel=1e-9)
    assert rows(belief.converge, hub_rows=50) == pytest.approx(rows(belief.converge), rel=1e-9)


@pytest.mark.parametrize("kernel", ["linear", "sigmoid"])
def test_runs_as_columns_equal_runs_as_rows(spark, monkeypatch, kernel):
    members = star(spark).filter("fid <> 'all'")
    factors = members.select("fid").distinct().select("fid", *[F.lit(v).alias(c) for c, v in (("w", 0.4), ("confidence", 1.0), ("forward", 0.5), ("backward", 0.1), ("selectivity", 0.5), ("decay", 0.1))])
    start = spark.createDataFrame([("a", "n1", 1.0), ("b", "hub", 0.5), (None, "n7", 0.2), ("b", "alone", 0.3)], "run_id string, uid string, x double")
    rows = lambda **more: {(r.run_id, r.uid): r.x for r in propagation.propagate(members, factors, start, 2, kernel, **more).collect()}
    known = [rows(), rows(apart=True), rows(hubs=propagation.hubs_of(members, 50))]
    monkeypatch.setattr(propagation, "WIDE", 2)
    # rows of a run without a name meet nothing, as nulls do; they are left out
    many = {k: x for k, x in rows().items() if k[0] is not None}
    assert len(many) > 400 and all({k: x for k, x in one.items() if k[0] is not None} == pytest.approx(many, rel=1e-9) for one in known)


def test_a_node_twice_in_a_factor_sends_nothing_to_itself(spark):
    """As the SQL has it: every place of a node hears the other nodes' places."""
    members = spark.createDataFrame([("f", "a", 0), ("f", "a", 1), ("f", "b", 2)], "fid string, uid string, pos int")
    factors = spark.createDataFrame([("f", 1.0, 1.0, 0.2, 0.1, 0.5, 0.0)], "fid string, w double, confidence double, forward double, backward double, selectivity double, decay double")
    start = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.1)], "run_id string, uid string, x double")
    got = {r.uid: r.x for r in propagation.propagate(members, factors, start, 1).collect()}
    assert got == pytest.approx({"a": 0.5 + 2 * 0.01, "b": 0.1 + 0.1 + 0.05})


def test_a_step_shuffles_members_once_for_all_runs(spark):
    """Members go to their nodes and to their factors; no run has rows of its own before the end."""
    members = star(spark)
    factors = members.select("fid").distinct().select("fid", *[F.lit(v).alias(c) for c, v in (("w", 0.4), ("confidence", 1.0), ("forward", 0.5), ("backward", 0.1), ("selectivity", 0.5), ("decay", 0.1))])
    start = members.select(F.concat(F.lit("r"), F.pmod(F.xxhash64("uid"), F.lit(5))).alias("run_id"), "uid", F.lit(0.5).alias("x")).distinct()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = propagation.propagate(members, factors, start, 1, apart=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    assert "hashpartitioning(fid#" in plan and not re.search(r"hashpartitioning\(run_id#\d+, (pos|fid)#", plan)
