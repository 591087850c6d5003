"""Metrics of answers, traces, roles, paths, trajectories and arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold

# The weight of a role in the overall score, and of the parts of a total score.
ROLE_WEIGHTS = {"SUBJECT": 2.0, "OBJECT": 2.0}
TOTAL_WEIGHTS = [0.20, 0.30, 0.15, 0.20, 0.15]


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole; ``empty`` where the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def share(flag: Column) -> Column:
    """Share of rows where a flag holds; null does not hold."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def outcome(expected: Column, predicted: Column, negative_type: Column, banned: Column, must_reject: Column) -> dict[str, Column]:
    """Flags of a resolved mention: null is "no entity".

    ``negative_type``: a case where a wrong entity is an identity error; ``banned``: an entity that must never be
    chosen; ``must_reject``: nothing may be chosen. The last two matter in negative types only.
    """
    said, equal = predicted.isNotNull(), expected.eqNullSafe(predicted)
    bad = negative_type & F.coalesce(predicted == banned, F.lit(False))
    reject = negative_type & must_reject
    return {
        "correct": F.when(reject, ~said).otherwise(equal & ~bad),
        "false_merge": F.when(reject, said).otherwise((negative_type & said & ~equal) | bad),
        "false_positive": said & ~equal,
        "false_negative": expected.isNotNull() & ~said,
    }


def trace_complete(expected: Column, actual: Column) -> Column:
    """Whether ``expected`` is a subsequence of ``actual``: one walk over actual with the next item wanted."""
    walked = F.aggregate(actual, F.lit(0), lambda at, x: F.when(F.coalesce(F.try_element_at(expected, at + 1) == x, F.lit(False)), at + 1).otherwise(at))
    return walked == F.size(expected)


def trace_contains(trace: Column, gold: Column, prefix: str = "M_") -> Column:
    """All gold ids are in the trace, with or without prefix; without gold any trace will do."""
    bare = lambda ids: F.transform(ids, lambda x: F.regexp_replace(x, f"^{prefix}", ""))
    return F.when(F.size(gold) == 0, F.size(trace) > 0).otherwise(F.size(F.array_except(bare(gold), bare(trace))) == 0)


def explain_score(correct: Column, depth: Column, deepest: int, complete: Column) -> Column:
    """Mean of depth share over rows that are right and fully explained."""
    return F.avg(F.when(correct & complete, depth / F.lit(float(deepest))).otherwise(0.0))


def removal_efficiency(before: Column, after: Column) -> Column:
    return F.when(before == 0, 1.0).otherwise(1 - after / before)


def verdict(delta: Column) -> Column:
    return F.when(F.abs(delta) < 1e-12, "tied").when(delta > 0, "supported").otherwise("rejected")


def total_score(parts: list[Column]) -> Column:
    terms = [F.lit(weight) * part for weight, part in zip(TOTAL_WEIGHTS, parts, strict=True)]
    return sum(terms[1:], terms[0])


def exact_match(actual: Column, expected: Column) -> Column:
    """Equal after case folding and squeezing of blanks."""
    plain = lambda t: F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"\s+", " "))
    return plain(actual) == plain(expected)


def keyword_hit(answer: Column, keywords: list[str]) -> Column:
    """Any folded keyword inside the folded answer."""
    hits = [F.contains(fold(answer), fold(F.lit(k))) for k in keywords]
    return sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) > 0


def unsupported_answer(answer: Column, context: Column, least: float = 0.35) -> Column:
    """Whether fewer than ``least`` of the answer's words of 4 letters or more occur in the context. No such word: supported."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]{4,}"), F.lit(0)))
    long_words = words(answer)
    return (F.size(long_words) > 0) & (F.size(F.array_intersect(long_words, words(context))) < F.size(long_words) * least)


# Answers that claim nothing.
ABSTENTIONS = ("", "unknown", "no data")


def abstains(answer: Column) -> Column:
    return fold(F.coalesce(answer, F.lit(""))).isin(*ABSTENTIONS)


def hallucinated(answer: Column, trap: Column, trace: Column) -> Column:
    """Whether a graph's answer claims what nothing supports: anything but an abstention where there is no answer, else an
    answer without a trace, right or wrong."""
    return F.when(abstains(answer), False).when(trap, True).otherwise(F.size(trace) == 0)


def retrieval_hallucinated(answer: Column, trap: Column, spans: Column, context: Column) -> Column:
    """Likewise for retrieval: no expected span in the context, or too few of the answer's words in it."""
    body = fold(F.coalesce(context, F.lit("")))
    grounded = F.exists(spans, lambda s: (s != "") & F.contains(body, fold(s)))
    return F.when(abstains(answer), False).when(trap, True).otherwise(~grounded | unsupported_answer(answer, context))


def gold_eval(cases: DataFrame) -> DataFrame:
    """Cases with ``hit``, ``explained`` and ``hallucinated``: ``case_id, answer, trace, keyword, gold_trace, trap``, each case on its own graph."""
    hit = F.when(F.col("trap"), abstains(F.col("answer"))).otherwise(F.contains(fold(F.coalesce("answer", F.lit(""))), fold(F.col("keyword"))))
    flags = {"hit": hit, "explained": trace_contains(F.col("trace"), F.col("gold_trace")), "hallucinated": hallucinated(F.col("answer"), F.col("trap"), F.col("trace"))}
    return cases.withColumns(flags)


def answer_cases(cases: DataFrame, told: DataFrame, protocol: str = "isolated", unknown: str = "unknown") -> DataFrame:
    """Cases (``session, seq, subject, relation`` and more columns) with ``answer``, ``trace`` and ``n_known``.

    Each case tells facts, ``session, seq, fid, subject, relation, object``, and then asks what holds for its subject and
    relation: the object told last (the largest fid within a case), with its fact as the trace. An ``isolated`` case knows
    what it told itself; a ``sequential`` one also what the cases of its session told before it. One running window over facts and
    questions in order, so a session is never a pair join nor held whole. A null subject or relation is unknown.
    """
    if protocol not in ("isolated", "sequential"):
        raise ValueError(f"no such protocol: {protocol}")
    key = ["session", "subject", "relation"]
    own = [c for c in cases.columns if c not in (*key, "seq")]
    asked = cases.select(*key, "seq", F.lit(1).alias("asks"), F.lit(None).cast(told.schema["fid"].dataType).alias("fid"), F.lit(None).cast("string").alias("object"), F.struct(F.lit(0).alias("_none"), *own).alias("case"))
    facts = told.filter("subject is not null and relation is not null and object is not null")
    facts = facts.select(*key, "seq", F.lit(0).alias("asks"), "fid", F.col("object").cast("string").alias("object")).withColumn("case", F.lit(None).cast(asked.schema["case"].dataType))
    order = Window.partitionBy(*key, *(["seq"] if protocol == "isolated" else [])).orderBy("seq", "asks", "fid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = facts.unionByName(asked).withColumns({"last": F.last("object", ignorenulls=True).over(order), "proof": F.last("fid", ignorenulls=True).over(order), "n_known": F.count("object").over(order)})
    trace = F.when(F.col("proof").isNull(), F.array().cast(f"array<{told.schema['fid'].dataType.simpleString()}>")).otherwise(F.array("proof"))
    return known.filter("asks = 1").select("session", "seq", "subject", "relation", "case.*", F.coalesce("last", F.lit(unknown)).alias("answer"), trace.alias("trace"), "n_known").drop("_none")


def path_quality(found: Column, proof: Column) -> dict[str, Column]:
    """Precision, recall, F1, missing and extra of a found path (arrays of ids)."""
    both = F.size(F.array_intersect(found, proof))
    p, r = ratio(both, F.size(F.array_distinct(found))), ratio(both, F.size(F.array_distinct(proof)))
    return {
        "precision": p,
        "recall": r,
        "f1": f1(p, r),
        "hop_efficiency": F.least(F.lit(1.0), ratio(F.size(proof), F.size(found))),
        "missing": F.size(F.array_except(proof, found)),
        "extra": F.size(F.array_except(found, proof)),
    }


def role_scores(expected: DataFrame, predicted: DataFrame, mandatory: tuple[str, ...] = ("SUBJECT", "OBJECT", "LOCATION")) -> DataFrame:
    """``role, precision, recall, f1, weight`` on multisets of ``item, role, value``; mandatory roles always have a row."""
    key = ["item", "role", "value"]
    want, got = expected.groupBy(*key).agg(F.count("*").alias("want")), predicted.groupBy(*key).agg(F.count("*").alias("got"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = want.join(got, key, "full").select("role", zero("want").alias("want"), zero("got").alias("got"))
    always = expected.sparkSession.createDataFrame([(r, 0, 0) for r in mandatory], "role string, want long, got long")
    sums = both.unionByName(always).groupBy("role").agg(F.sum(F.least("want", "got")).alias("hit"), F.sum("want").alias("want"), F.sum("got").alias("got"))
    p, r = ratio(F.col("hit"), F.col("got")), ratio(F.col("hit"), F.col("want"))
    weight = F.lit(1.0)
    for role, w in ROLE_WEIGHTS.items():
        weight = F.when(F.col("role") == role, w).otherwise(weight)
    return sums.select("role", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), weight.alias("weight"))


def weighted_role_score(scores: DataFrame) -> DataFrame:
    """One row: weighted sum of the F1 values, and that over the sum of weights."""
    total = F.sum(F.col("f1") * F.col("weight"))
    return scores.agg(total.alias("weighted"), ratio(total, F.sum("weight")).alias("normalized"))


def trajectories(history: DataFrame, threshold: float, relevant: DataFrame | None = None) -> DataFrame:
    """One row of metrics per run from ``run_id, tick, uid, x`` (a row for each node and tick).

    latency: first tick at which a relevant node (all, if none are named) meets the threshold; half_life: ticks from
    the peak of the largest relevant activation to its half; both null where that never happens. spread and stability
    are of the last tick, convergence is the largest change in it; oscillation is the mean share of sign changes.
    """
    named = history.withColumn("relevant", F.lit(True)) if relevant is None else history.join(relevant.select("uid", F.lit(True).alias("hit")), "uid", "left").withColumn("relevant", F.col("hit").isNotNull()).drop("hit")
    node = Window.partitionBy("run_id", "uid").orderBy("tick")
    step = F.col("x") - F.lag("x").over(node)
    sign = F.when(step > 1e-6, 1).when(step < -1e-6, -1).when(step.isNotNull(), 0)
    signs = named.withColumn("step", step).withColumn("sign", sign).withColumn("turn", (F.col("sign") * F.lag("sign").over(node) == -1).cast("int"))
    by_node = signs.groupBy("run_id", "uid").agg(
        F.max_by("x", "tick").alias("x"),
        F.max_by(F.abs("step"), "tick").alias("change"),
        F.max("relevant").alias("relevant"),
        F.max("x").alias("peak"),
        F.min(F.when(F.col("relevant") & (F.col("x") >= threshold), F.col("tick"))).alias("reached"),
        F.when(F.count("*") < 4, 0.0).otherwise(F.coalesce(F.sum("turn"), F.lit(0)) / F.greatest(F.lit(1), F.count("*") - 2)).alias("swing"),
    )
    active = F.col("x") >= threshold
    mean_of = lambda flag: F.coalesce(F.avg(F.when(flag, F.col("x"))), F.lit(0.0))
    selectivity = F.lit(0.0) if relevant is None else mean_of(F.col("relevant")) / F.greatest(F.lit(1e-12), mean_of(~F.col("relevant")))
    runs = by_node.groupBy("run_id").agg(
        F.min("reached").alias("latency"),
        F.max("peak").alias("peak"),
        F.count_if(active).alias("spread"),
        (1 - share(active)).alias("stability"),
        F.coalesce(F.max("change"), F.lit(0.0)).alias("convergence"),
        F.avg("swing").alias("oscillation"),
        selectivity.alias("selectivity"),
    )
    top = named.filter("relevant").groupBy("run_id", "tick").agg(F.max("x").alias("top"))
    peak = top.groupBy("run_id").agg(F.max(F.struct("top", (-F.col("tick")).alias("back"))).alias("peak"))
    halved = top.join(peak.select("run_id", F.col("peak.top").alias("most"), (-F.col("peak.back")).alias("at")), "run_id")
    fallen = halved.filter((F.col("most") > 0) & (F.col("tick") > F.col("at")) & (F.col("top") <= F.col("most") / 2))
    return runs.join(fallen.groupBy("run_id").agg(F.min(F.col("tick") - F.col("at")).alias("half_life")), "run_id", "left")


def outcomes(history: DataFrame, thresholds: tuple[float, ...], last: int) -> DataFrame:
    """``run_id, threshold, peak, latency, spread`` of :func:`trajectories` for several thresholds, in one aggregation, of a history
    in which every node has every tick up to ``last``."""
    at = lambda t: F.struct(F.lit(t).alias("threshold"), F.min(F.when(F.col("x") >= t, F.col("tick"))).alias("latency"), F.count_if((F.col("tick") == last) & (F.col("x") >= t)).alias("spread"))
    runs = history.groupBy("run_id").agg(F.max("x").alias("peak"), F.array(*[at(t) for t in thresholds]).alias("all"))
    return runs.select("run_id", "peak", F.explode("all").alias("at")).select("run_id", "at.threshold", "peak", "at.latency", "at.spread")


def paired(rows: DataFrame, item: str, arm: str, arms: tuple[str, str], values: list[str]) -> DataFrame:
    """Per item the values of two arms and their differences; items that only one arm has are kept with null."""
    wide = rows.groupBy(item).pivot(arm, list(arms)).agg(*[F.first(v).alias(v) for v in values]) if len(values) > 1 else rows.groupBy(item).pivot(arm, list(arms)).agg(F.first(values[0]))
    name = (lambda a, v: f"{a}_{v}") if len(values) > 1 else (lambda a, v: a)
    return wide.select(item, *[c for v in values for c in (F.col(name(arms[0], v)).alias(f"{arms[0]}_{v}"), F.col(name(arms[1], v)).alias(f"{arms[1]}_{v}"), (F.col(name(arms[0], v)) - F.col(name(arms[1], v))).alias(f"{v}_delta"))])
