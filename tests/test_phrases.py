"""Phrase matching against a loop over all phrases and places."""

import random
import re

import pytest

from factloom.operators import phrases, resolution


def places(texts, known, own):
    words = lambda t: [own.get(w, w) for w in re.findall(r"[^\W_]+", (t or "").lower())]
    split, wanted = [(i, words(t)) for i, t in texts], [(u, words(q)) for u, q in known]
    return {(i, s, len(p), u) for i, w in split for u, p in wanted if len(p) >= 2 for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p}


@pytest.mark.parametrize("block", [5, 150_000])
@pytest.mark.parametrize("with_lemmas", [False, True])
def test_matches_equal_a_loop(spark, block, with_lemmas):
    draw = random.Random(7)
    say = lambda n: " ".join(draw.choice(["a", "b", "bs", "Ä", "saw", "saws", "\U0001f600", "see"]) for _ in range(n))
    texts = [(i, say(draw.randint(0, 30))) for i in range(25)] + [(50, None), (51, ""), (52, " ".join(["a", "b"] * 2000))]
    known = [(u, say(draw.randint(1, 4))) for u in range(20)] + [(30, None), (31, ""), (32, "a b"), (33, "A, b!"), (34, " ".join(["a", "b"] * 6))]
    table = {"bs": "b", "saw": "see", "saws": "saw"} if with_lemmas else {}
    lemmas = spark.createDataFrame([*table.items(), ("bs", "bz"), (None, "x"), ("y", "")], "form string, lemma string") if with_lemmas else None
    t, p = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(known, "uid long, phrase string")
    got = [(r.text_id, r.start, r.width, r.uid) for r in phrases.phrase_matches(t, p, lemmas=lemmas, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == places(texts, known, table)


def test_no_phrases_and_greedy_choice(spark):
    t = spark.createDataFrame([("x", "a b c d e a b")], "text_id string, text string")
    p = spark.createDataFrame([(1, "a b"), (2, "b c d"), (3, "d e"), (4, "e a")], "uid long, phrase string")
    assert phrases.phrase_matches(t, p.limit(0)).count() == 0 == phrases.phrase_matches(t.limit(0), p).count()
    rows = resolution.longest_phrases(phrases.phrase_matches(t, p)).orderBy("rank").collect()
    assert [(r.uid, r.start, r.width) for r in rows] == [(2, 1, 3), (4, 4, 2)]
