"""Similarity joins against comparisons of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import resolution, similar


def runs(text, size=3):
    padded = f" {text} "
    return {padded[i : i + size] for i in range(max(1, len(padded) - size + 1))}


def names(seed, n):
    draw = random.Random(seed)
    ends = ["steel", "tin", "copper", "zz"]
    return ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 9))) + draw.choice(["", " " + draw.choice(ends)]) for _ in range(n)]


@pytest.mark.parametrize("tile", [1, 7, 20_000])
def test_most_similar_name_equals_all_pairs(spark, tile):
    said, known = names(1, 60) + ["", "steel", "steel", "qqqqq"], names(2, 50) + ["steel", "tin"]
    m = spark.createDataFrame([*enumerate(said), (999, None)], "mention_id long, mention string")
    c = spark.createDataFrame([(i, x) for i, x in enumerate(known)] + [(77, None)], "uid long, name string")
    want = {}
    for i, a in enumerate(said):
        scored = [(-2 * len(runs(a) & runs(b)) / (len(runs(a)) + len(runs(b))), u) for u, b in enumerate(known) if runs(a) & runs(b)]
        if a and scored:
            want[i] = (min(scored)[1], round(-min(scored)[0], 9))
    got = {r.mention_id: (r.uid, round(r.score, 9)) for r in resolution.similar_names(m, c, tile=tile).collect()}
    assert got == want and 63 not in got
    assert resolution.similar_names(m, c.limit(0)).count() == 0 == resolution.similar_names(m.limit(0), c).count()


@pytest.mark.parametrize("least", [0.8, 0.5, 0.2, 0.0])
def test_dice_pairs_lose_nothing_and_come_once(spark, least):
    sets = {i: runs(x) for i, x in enumerate(names(3, 80))}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string")
    frequent = similar.frequent_tokens(rows, rows)
    a, b = similar.ordered(rows.withColumnRenamed("id", "a"), ["a"], frequent), similar.ordered(rows.withColumnRenamed("id", "b"), ["b"], frequent)
    got = [(r.a, r.b) for r in similar.dice_pairs(a, b, least, tile=3).collect()]
    want = {(x, y) for x in sets for y in sets if sets[x] & sets[y] and 2 * len(sets[x] & sets[y]) / (len(sets[x]) + len(sets[y])) >= least}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("least", [0.9, 0.55, 0.1])
def test_nearest_relation_equals_all_pairs(spark, least):
    draw = random.Random(4)
    vectors = lambda n: {f"r{i:02d}": {s: draw.choice([-2, -1, 1, 1, 2, 5]) for s in draw.sample(range(12), draw.randint(1, 8))} for i in range(n)}
    a, b = vectors(40), vectors(30)
    frame = lambda vs, key: spark.createDataFrame([(k, s, v) for k, w in vs.items() for s, v in w.items()], f"{key} string, slot long, v long")
    want = {}
    for x, u in a.items():
        scored = [(-round(sum(v * w.get(s, 0) for s, v in u.items()) / math.sqrt(sum(v * v for v in u.values()) * sum(v * v for v in w.values())), 9), y) for y, w in b.items()]
        if -min(scored)[0] >= least:
            want[x] = (min(scored)[1], -min(scored)[0])
    got = {r.raw: (r.canonical, r.confidence) for r in resolution.nearest_relations(frame(a, "raw"), frame(b, "canonical"), least, tile=5).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)


def test_starts_leave_frequent_tokens_out(spark):
    """A token in all of 2,000 sets is in no start at 0.8, so its list is never paired."""
    rows = spark.range(2000).select("id", F.explode(F.concat(F.array(F.lit("all")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat_ws("-", "id", i)))).alias("token"))
    frequent = similar.frequent_tokens(rows)
    assert [tuple(r) for r in frequent.collect() if r.token == "all"] == [("all", 2000)]
    one = similar.ordered(rows, ["id"], frequent)
    assert one.filter(F.element_at("all", -1)["token"] != "all").count() == 0
    assert similar.dice_pairs(one.withColumnRenamed("id", "a"), one.withColumnRenamed("id", "b"), 0.8).filter("a <> b").count() == 0
