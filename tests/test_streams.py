"""Keyed state over restarts, fading by timers, and an ingest that adds nothing twice."""

import random
from collections import defaultdict

from factloom.streaming import keyed, sink

OPS = "key string, seq long, op string, value double"
HITS = "run_id string, uid string, tick long, lam double"


def fed(spark, path, schema, rows):
    """One more file of a folder that is read as a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def folded(rows, cap=None):
    last, items = {}, defaultdict(list)
    for key, seq, op, value in sorted(rows, key=lambda r: r[1]):
        if op == "append":
            items[key].append(value)
        else:
            last[key] = (op, value)
    keys = {r[0] for r in rows}
    return {k: (last[k][1] if last.get(k, ("",))[0] == "set" else None, items[k][-cap:] if cap else items[k]) for k in keys}


def test_operations_are_folded_over_restarts(spark, tmp_path):
    rng, rows = random.Random(4), []
    order = rng.sample(range(300), 300)  # numbers come in any order, so late ones too
    for cap in (None, 3):
        rows, home = [], str(tmp_path / f"cap{cap}")
        for part in range(3):
            more = [(f"k{rng.randrange(7)}", order[part * 100 + k], rng.choice(["set", "delete", "append"]), rng.choice([None, 1.5, 2.0, float(k)])) for k in range(100)]
            rows += more
            stream = fed(spark, f"{home}/in", OPS, more)
            got = keyed.latest(keyed.fold_operations(stream, cap), ["key"], f"{home}/state").collect()
            if cap is None or part == 0:
                assert {r.key: (r.value, r["items"]) for r in got} == folded(rows, cap)
    # a run without new input keeps what is there
    assert keyed.latest(keyed.fold_operations(stream, cap), ["key"], f"{home}/state").count() == len(got)


def test_capped_list_keeps_the_latest_numbers(spark, tmp_path):
    home, rows = str(tmp_path), [("a", k, "append", float(k)) for k in (5, 1, 9, 3)]
    for part in (rows[:2], rows[2:]):
        got = keyed.latest(keyed.fold_operations(fed(spark, f"{home}/in", OPS, part), 2), ["key"], f"{home}/state").first()
    assert got["items"] == [5.0, 9.0] and got.value is None and not got.is_set


def test_history_holds_n_messages(spark, tmp_path):
    kind, home = "conv_id long, turn long, role string, text string", str(tmp_path)
    for turns in ([3, 1, 2], [5, 4], [0]):
        stream = fed(spark, f"{home}/in", kind, [(1, t, "user", None if t == 4 else f"t{t}") for t in turns])
        got = keyed.latest(keyed.history(stream, 3), ["conv_id"], f"{home}/state").first()
    assert [(m.turn, m.text) for m in got.history] == [(3, "t3"), (4, None), (5, "t5")]


def faded(hits, upto, share=0.5, least=0.05):
    out = {}
    for uid in {h[1] for h in hits}:
        lam = 0.0
        for tick in range(upto + 1):
            lam = lam * share if lam * share >= least else 0.0
            lam += sum(h[3] for h in hits if h[1] == uid and h[2] == tick)
        if lam > 0:
            out[uid] = lam
    return out


def test_evidence_fades_by_timers_and_state_is_freed(spark, tmp_path):
    rng, home, hits = random.Random(5), str(tmp_path), []
    for part, (low, high) in enumerate([(0, 5), (5, 12), (30, 33)]):
        more = [("r", f"n{rng.randrange(6)}", rng.randrange(low, high), rng.choice([0.03125, 0.25, 1.0])) for _ in range(25)]
        more.append(("clock", "", high, 0.0))  # all ticks below are over
        hits += more
        stream = fed(spark, f"{home}/in", HITS, more)
        rows = keyed.latest(keyed.fading_evidence(stream), ["run_id", "uid"], f"{home}/state").filter("run_id = 'r' and lam > 0").collect()
        got, expected = {r.uid: round(r.lam, 9) for r in rows}, faded([h for h in hits if h[0] == "r"], high - 1)
        assert got == {k: round(v, 9) for k, v in expected.items()}, part
    # long after the last hit nothing is left, and every node has said so
    stream = fed(spark, f"{home}/in", HITS, [("clock", "", 90, 0.0)])
    rows = keyed.latest(keyed.fading_evidence(stream), ["run_id", "uid"], f"{home}/state").filter("run_id = 'r'").collect()
    assert {r.lam for r in rows} == {0.0} and len(rows) == len({h[1] for h in hits if h[0] == "r"})


def said(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, text string, ts string").selectExpr("conv_id", "turn", "text", "cast(ts as timestamp) ts")


def test_ingest_adds_nothing_twice(spark, tmp_path):
    home, roles = str(tmp_path), ["SUBJECT", "OBJECT"]
    write = lambda batch, rows, stream="s", horizon=None: sink.write_batch(sink.candidates_of(said(spark, rows), ["is"]), home, roles, stream, batch, horizon)
    known = lambda: sorted((r.roles["SUBJECT"], r.roles["OBJECT"]) for r in sink.known_facts(spark, home).collect())
    first = [(1, 1, "snow is white. grass is green", "2024-01-01"), (1, 2, "snow is white", "2024-01-01"), (1, 3, None, "2024-01-01")]
    second = [(2, 1, "grass is green! coal is black", "2024-01-02")]
    write(0, first)
    write(1, second)
    expected = [("coal", "black"), ("grass", "green"), ("snow", "white")]
    assert known() == expected
    write(0, first)  # run again
    write(1, second)
    write(0, first + second, "another")
    write(2, [])
    assert known() == expected
    # behind the horizon a fact may come again, within it not
    write(3, [(3, 1, "coal is black", "2024-01-03")], horizon="2 days")
    assert known() == expected
    write(3, [(3, 1, "coal is black", "2024-03-01")], horizon="2 days")
    assert known() == sorted([*expected, ("coal", "black")])


def test_stream_of_utterances_is_ingested_once(spark, tmp_path):
    home, kind = str(tmp_path), "conv_id long, turn long, text string, ts timestamp"
    for name in ("a", "a", "b"):
        rows = [(1, 1, f"{name} is here", None), (1, 2, "all is well", None)]
        sink.ingest_stream(fed(spark, f"{home}/in", kind, rows), home, ["is"], ["SUBJECT", "OBJECT"]).awaitTermination()
        assert sink.known_facts(spark, home).count() == (3 if name == "b" else 2)
    sink.ingest_stream(spark.readStream.schema(kind).parquet(f"{home}/in"), home, ["is"], ["SUBJECT", "OBJECT"], "replay").awaitTermination()
    assert sink.known_facts(spark, home).count() == 3
