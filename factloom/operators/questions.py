"""Questions over facts, for all questions at once: target role, relation, plan, answer; and answers by retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage, written
from . import belief, propagation
from . import hubs as hub_joins

#: Weights of relations (one a slot) that are broadcast, at most.
WEIGHTS = 500_000

# What a question word asks for.
CUES = [("where", "LOCATION"), ("when", "TIME"), ("why", "CAUSE"), ("with what", "INSTRUMENT"), ("who", "SUBJECT")]


def target_role(question: Column, explicit: Column | None = None) -> Column:
    """The role named, else that of the first cue in the list that occurs, else OBJECT."""
    text = F.lower(F.coalesce(question, F.lit("")))
    cued = F.lit(None).cast("string")
    for word, role in reversed(CUES):
        cued = F.when(text.rlike(rf"\b{word}\b"), role).otherwise(cued)
    return F.coalesce(cued, F.lit("OBJECT")) if explicit is None else F.coalesce(explicit, cued, F.lit("OBJECT"))


def query_terms(questions: DataFrame, anchors: DataFrame, stop: list[str]) -> DataFrame:
    """``question_id, pos, term`` of distinct words that are no stop words and in no anchor label (``question_id, label``)."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}#]{2,}"), F.lit(0))
    said = questions.select("question_id", F.posexplode(split("question")).alias("pos", "term")).filter(~F.col("term").isin(*stop))
    known = anchors.select("question_id", F.explode(split("label")).alias("term")).distinct()
    return said.join(known, ["question_id", "term"], "left_anti").groupBy("question_id", "term").agg(F.min("pos").alias("pos"))


def score_relations(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """``question_id, relation, score``: share of a question's terms in the relation's own words (``relation, term, label``), where words of
    the label count .7 and words of its facts .3."""
    total = terms.groupBy("question_id").agg(F.count("*").alias("n"))
    hit = terms.join(docs, "term").groupBy("question_id", "relation").agg(F.sum(F.when(F.col("label"), 0.7).otherwise(0.3)).alias("hits"))
    return hit.join(total, "question_id").select("question_id", "relation", (F.col("hits") / F.col("n")).alias("score"))


def score_relations_by_vectors(asked: DataFrame, labels: DataFrame, docs: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``question_id, relation, score``: 0.7 of the cosine of a question and a relation's label, and 0.3 of that with its document.

    Vectors are sparse, ``question_id, slot, v`` and ``relation, slot, v``, and meet on their slots; a pair without a
    common slot has no row. ``kinds`` (``question_id, relation, n``) are the distinct fillers that a list question would
    get from a relation, and add 0.08 (1 - 1 / n).
    """

    def unit(df: DataFrame, key: str, name: str) -> DataFrame:
        size = F.sqrt(F.sum(F.col("v").cast("double") * F.col("v")).over(Window.partitionBy(key)))
        return df.select(key, "slot", (F.col("v") / size).alias(name))

    of = unit(labels, "relation", "u").withColumn("share", F.lit(0.7)).unionByName(unit(docs, "relation", "u").withColumn("share", F.lit(0.3)))
    weights = of.groupBy("relation", "slot").agg(F.sum(F.col("share") * F.col("u")).alias("u"))
    # the sides are told apart here, since the planner knows neither's size; rows stay dealt by question where relations are broadcast
    weights = written(weights)
    weights = F.broadcast(weights) if weights.count() <= WEIGHTS else weights.hint("merge")
    scores = unit(asked, "question_id", "q").join(weights, "slot").groupBy("question_id", "relation").agg(F.sum(F.col("q") * F.col("u")).alias("score"))
    if kinds is None:
        return scores
    more = F.coalesce(0.08 * (1 - 1 / F.col("n")), F.lit(0.0))
    # as many rows as questions, which a small file does not tell the planner: never broadcast
    return scores.join(kinds.select("question_id", "relation", "n").filter("n > 0").hint("merge"), ["question_id", "relation"], "left").withColumn("score", F.col("score") + more).drop("n")


def choose(scores: DataFrame, least: float = 0.12, margin: float = 0.025) -> DataFrame:
    """``question_id, relation, score``: the best relation if good enough and clear of the second."""
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "relation")
    best = scores.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter("rank = 1")
    return best.filter((F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin)).select("question_id", "relation", "score")


def decode(plans: DataFrame, members: DataFrame) -> DataFrame:
    """``question_id, answer, n``: distinct fillers of the target role in facts of the anchor (``question_id, anchor, role``), joined in order."""
    anchored = plans.join(members.select("fid", F.col("uid").alias("anchor")), "anchor")
    fillers = anchored.join(members.select("fid", F.col("uid").alias("filler"), "role"), ["fid", "role"]).filter("filler <> anchor")
    found = fillers.groupBy("question_id").agg(F.array_sort(F.collect_set("filler")).alias("all"))
    return found.select("question_id", F.array_join("all", ", ").alias("answer"), F.size("all").cast("long").alias("n"))


def compose(questions: DataFrame, tiers: list[DataFrame], unknown: str = "unknown") -> DataFrame:
    """``question_id, answer, tier``: the answer of the first tier (``question_id, answer``) that has one."""
    both = None
    for no, tier in enumerate(tiers):
        rows = tier.select("question_id", F.lit(no).alias("tier"), "answer").filter("answer <> ''")
        both = rows if both is None else both.unionByName(rows)
    best = both.groupBy("question_id").agg(F.min(F.struct("tier", "answer")).alias("best"))
    return questions.select("question_id").join(best, "question_id", "left").select("question_id", F.coalesce("best.answer", F.lit(unknown)).alias("answer"), F.coalesce("best.tier", F.lit(-1)).alias("tier"))


def best_chunks(questions: DataFrame, chunks: DataFrame, k: int = 1, least: int = 2, repeated: bool = False) -> DataFrame:
    """``question_id, chunk_id, overlap, rank``: chunks by the number of distinct words that they share with a question.

    Both sides are inverted to words, so that only chunks with a common word meet; counts are combined before the shuffle.
    With ``repeated``, questions of equal words meet chunks of equal words once for all of them: of such chunks the ``k`` of
    smallest id are all that can be found, and the questions get what was found for one of them.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]{5,}"), F.lit(0)))
    order = [F.col("overlap").desc(), "chunk_id"]
    if repeated:
        said = questions.select("question_id", F.array_sort(words("question")).alias("words")).withColumn("kind", F.md5(F.array_join("words", " "))).filter("size(words) > 0")
        asked = said.select("kind", "words").distinct().select("kind", F.explode("words").alias("word"))
        place = F.row_number().over(Window.partitionBy("words").orderBy("chunk_id"))
        firsts = chunks.select("chunk_id", F.array_sort(words("body")).alias("words")).withColumn("place", place).filter((F.col("place") <= k) & (F.size("words") > 0))
        held = firsts.groupBy("words").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids")).select("ids", F.explode("words").alias("word"))
        shared = held.join(asked, "word").groupBy("kind", "ids").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= least)
        best = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("rank") <= k)
        found = best(best(shared.withColumn("chunk_id", F.col("ids")[0])).select("kind", "overlap", F.explode("ids").alias("chunk_id")))
        return said.select("question_id", "kind").join(found.hint("merge"), "kind").select("question_id", "chunk_id", "overlap", "rank")
    asked = questions.select("question_id", F.explode(words("question")).alias("word"))
    held = chunks.select("chunk_id", F.explode(words("body")).alias("word"))
    shared = held.join(asked, "word").groupBy("question_id", "chunk_id").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= least)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return shared.withColumn("rank", rank).filter(F.col("rank") <= k)


def marked_answer(retrieved: DataFrame, marker: str) -> DataFrame:
    """``question_id, answer, cited``: what follows a marker in the lowest-ranked retrieved text that holds it (``question_id, rank, id, body``)."""
    found = retrieved.withColumn("answer", F.trim(F.regexp_extract("body", rf"{marker}\s+([^\s.,;:!?]+)", 1))).filter("answer <> ''")
    return found.groupBy("question_id").agg(F.max_by("answer", "rank").alias("answer"), F.max_by("id", "rank").alias("cited"))


def extract_answer(questions: DataFrame, retrieved: DataFrame, unknown: str = "unknown") -> DataFrame:
    """``question_id, answer``: first sentence of the retrieved text (``question_id, rank, body``) that shares most words with the question.

    Unknown when a third of the question's words of 4 letters or more (one at least) is nowhere in what was retrieved,
    when no text shares a word, and when nothing was retrieved. Equal texts go by rank.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    asked = questions.select("question_id", words(F.col("question")).alias("q"))
    asked = asked.withColumn("content", F.filter("q", lambda w: F.length(w) > 3))
    held = retrieved.join(asked, "question_id").withColumn("w", words(F.col("body")))
    held = held.withColumn("overlap", F.size(F.array_intersect("q", "w"))).withColumn("said", F.array_intersect("content", "w"))
    best = held.groupBy("question_id").agg(
        F.max_by("body", F.struct("overlap", (-F.col("rank")).alias("back"))).alias("body"),
        F.max("overlap").alias("overlap"),
        F.size(F.array_distinct(F.flatten(F.collect_list("said")))).alias("found"),
    )
    enough = (F.size("content") == 0) | (F.col("found") >= F.greatest(F.lit(1), F.floor(F.size("content") / 3)))
    sentence = F.regexp_extract("body", r"(?s)^(.*?[.!?])(\s|$)", 1)
    first = F.when(sentence != "", sentence).otherwise(F.col("body"))
    return asked.join(best, "question_id", "left").select("question_id", F.when(enough & (F.col("overlap") > 0), first).otherwise(F.lit(unknown)).alias("answer"))


def multi_hop(members: DataFrame, factors: DataFrame, cases: DataFrame, deepest: int, least: float = 0.05) -> DataFrame:
    """``case_id, x, answered, trace`` of cases ``case_id, seed, target, depth``, all cases in one job per step.

    A case spreads activation from its seed for ``depth`` steps; it is answered if the target then has ``least``.
    ``trace`` are the factors with a message of ``least`` or more, in order of first step and name. Depths above
    ``deepest`` are not answered.
    """
    state = cases.select(F.col("case_id").alias("run_id"), F.col("seed").alias("uid"), F.lit(1.0).alias("x"))
    depths = cases.select(F.col("case_id").alias("run_id"), "depth")
    ends = cases.select(F.col("case_id").alias("run_id"), F.col("target").alias("uid"), "depth")
    sent = reached = None
    hubs = propagation.hubs_of(members)
    for step in range(1, deepest + 1):
        live = state.join(depths.filter(F.col("depth") >= step).select("run_id"), "run_id")
        seen = propagation.messages(members, factors, live, "linear", *hubs).filter(F.col("sent") >= least).select("run_id", "fid", F.lit(step).alias("step"))
        state = cut_lineage(propagation.propagate(members, factors, live, 1, hubs=hubs))
        at_end = state.join(ends.filter(F.col("depth") == step), ["run_id", "uid"]).select("run_id", "x")
        sent = seen if sent is None else sent.unionByName(seen)
        reached = at_end if reached is None else reached.unionByName(at_end)
    first = sent.groupBy("run_id", "fid").agg(F.min("step").alias("step"))
    traces = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step", "fid"))).alias("all"))
    out = depths.select("run_id").join(reached, "run_id", "left").join(traces, "run_id", "left")
    x = F.coalesce("x", F.lit(0.0))
    return out.select(F.col("run_id").alias("case_id"), x.alias("x"), (x >= least).alias("answered"), F.coalesce(F.col("all.fid"), F.array().cast("array<string>")).alias("trace"))


def probe(members: DataFrame, factors: DataFrame, seeds: DataFrame, steps: int = 3, least: float = 0.05, top: int = 8, hubs: tuple[DataFrame | None, DataFrame | None] | None = None, apart: bool = False) -> DataFrame:
    """``run_id, tick, uid, x, rank``: the most active nodes after each step from seeds ``run_id, uid`` (and ``x``, else 1); a run without rows did not light up."""
    state, out = seeds.select("run_id", "uid", F.col("x") if "x" in seeds.columns else F.lit(1.0).alias("x")), None
    hubs = propagation.hubs_of(members) if hubs is None else hubs
    for step in range(1, steps + 1):
        state = cut_lineage(propagation.propagate(members, factors, state, 1, hubs=hubs, apart=apart))
        now = most_active(state.withColumn("tick", F.lit(step)), least, top)
        out = now if out is None else out.unionByName(now)
    return out


def most_active(states: DataFrame, least: float = 0.05, top: int = 8) -> DataFrame:
    """``run_id, tick, uid, x, rank`` of each run's most active nodes at each tick."""
    rank = F.row_number().over(Window.partitionBy("run_id", "tick").orderBy(F.round("x", 9).desc(), "uid"))
    return states.filter(F.col("x") >= least).withColumn("rank", rank).filter(F.col("rank") <= top).select("run_id", "tick", "uid", "x", "rank")


def opened_of(asked: DataFrame, facts: DataFrame, members: DataFrame | None) -> DataFrame:
    """``question_id, fid, members`` of the facts of a question's relation that an anchor is in (``question_id, relation, uid``), once each.

    Where a fact's row holds its members as an array, it goes once to each of them that may be an anchor, and to no other table.
    """
    if members is None:
        at = facts.select("relation", "fid", "members", F.explode(F.array_distinct(F.col("members.uid"))).alias("uid"))
        return hub_joins.sieve(at, asked, ["uid", "relation"]).join(asked.hint("merge"), ["uid", "relation"]).select("question_id", "fid", "members")
    touched = asked.join(members.select("fid", "uid"), "uid").join(facts.select("fid", "relation"), ["fid", "relation"]).select("question_id", "fid").distinct()
    held = touched.join(members, "fid").groupBy("question_id", "fid")
    return held.agg(F.collect_list(F.struct("uid", "pos", "role", "potential", "w")).alias("members"))


def ask(questions: DataFrame, anchors: DataFrame, facts: DataFrame, members: DataFrame | None, stop: list[str], ticks: int = 2) -> DataFrame:
    """``question_id, answer, relation, n_factors`` of questions ``question_id, question``.

    Anchors (``question_id, uid, label``) and the best relation open factors: those of the relation that an anchor is
    in. Belief spreads from the anchors through the open factors of each question; a shut factor's messages would all
    be one half and change nothing, so only open ones are there. The answer is what believed members fill the role
    that the question asks for. Facts are ``fid, relation``, members ``fid, uid, pos, role, potential, w``; or facts hold
    their ``members`` as an array of the same fields, and there is no table of them.

    Open factors are dealt by question once; belief spreads and answers are put together where they lie.
    """
    docs = facts.select("relation", F.lower("relation").alias("term"), F.lit(True).alias("label")).distinct()
    plan = choose(score_relations(query_terms(questions, anchors.select("question_id", "label"), stop), docs)).select("question_id", "relation")
    of = anchors.filter("uid is not null").groupBy("question_id").agg(F.collect_set("uid").alias("anchors"))
    asked = written(questions.select("question_id", target_role(F.col("question")).alias("wanted")).join(plan, "question_id").join(of, "question_id"))
    opened = opened_of(asked.select("question_id", "relation", F.explode("anchors").alias("uid")), facts, members)
    # one row per question, which a small file does not tell the planner: both sides are dealt by question
    dealt = opened.join(asked.hint("merge"), "question_id").dropDuplicates(["question_id", "fid"])
    rows = dealt.select(F.col("question_id").alias("run_id"), "fid", "relation", "wanted", "anchors", F.explode("members").alias("m")).select("*", "m.*").drop("m")
    rows = rows.withColumn("anchor", F.array_contains("anchors", F.col("uid"))).drop("anchors")
    rows = belief.spread_in_place(rows.withColumn("lam", F.when(F.col("anchor"), 3.0).otherwise(0.0)), ticks)
    fillers = rows.filter("role = wanted and belief > 0.5 and not anchor")
    said = fillers.groupBy(F.col("run_id").alias("question_id")).agg(F.array_join(F.array_sort(F.collect_set("uid")), ", ").alias("answer"), F.first("relation").alias("relation"), F.countDistinct("fid").alias("n_factors"))
    out = questions.select("question_id").join(said.hint("merge"), "question_id", "left")
    return out.select("question_id", F.coalesce("answer", F.lit("unknown")).alias("answer"), "relation", F.coalesce("n_factors", F.lit(0)).alias("n_factors"))


def compare_arms(graph: DataFrame, retrieval: DataFrame) -> DataFrame:
    """``question_id, graph_answer, retrieval_answer, agree``: both arms' answers; they agree when one holds the other."""
    both = graph.select("question_id", F.col("answer").alias("graph_answer")).join(retrieval.select("question_id", F.col("answer").alias("retrieval_answer")), "question_id", "full")
    a, b = F.lower("graph_answer"), F.lower("retrieval_answer")
    return both.withColumn("agree", F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False)))
