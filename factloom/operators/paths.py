"""Multi-hop answers, path explanations, garbage collection, proofs and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .analysis import orphans


def explain(members: DataFrame, weights: DataFrame, beliefs: DataFrame, seeds: DataFrame, hops: int = 4, floor: float = 0.05) -> DataFrame:
    """``uid, depth, parent, fid, nodes, path``: the best way from a seed to each node over factors, fewest hops first.

    A node is entered only with a belief of at least ``floor``; among equal depths the factor with the largest mean belief of
    its members times (1 + weight) wins, then the smallest factor. A hop is a join on factors and one on nodes; a factor
    passes its entrant of largest belief on, the smallest on ties, so a large factor does not emit all pairs.
    """
    nodes = beliefs.filter(F.col("belief") >= floor).select("uid")
    m = members.select("fid", "uid").distinct()
    scores = m.join(beliefs.select("uid", "belief"), "uid").groupBy("fid").agg(F.avg("belief").alias("mean")).join(weights.select("fid", "w"), "fid")
    m = m.join(scores.select("fid", (F.col("mean") * (1 + F.greatest(F.lit(0.0), F.col("w")))).alias("score")), "fid")
    name = members.schema["uid"].dataType
    seen = cut_lineage(seeds.select("uid").distinct().select("uid", F.lit(0).alias("depth"), F.lit(None).cast(name).alias("parent"), F.lit(None).cast(members.schema["fid"].dataType).alias("fid"), F.array("uid").alias("nodes")))
    frontier = seen
    for hop in range(1, hops + 1):
        came = frontier.select("uid", "nodes").join(beliefs.select("uid", "belief"), "uid", "left").join(m.select("fid", "uid"), "uid")
        entrants = came.groupBy("fid").agg(F.min_by(F.struct(F.col("uid").alias("parent"), "nodes"), F.struct((-F.coalesce("belief", F.lit(0.0))).alias("b"), "uid")).alias("e"))
        reached = m.join(entrants, "fid").join(nodes, "uid").join(seen.select("uid"), "uid", "left_anti")
        best = reached.groupBy("uid").agg(F.min_by(F.struct("e.parent", "fid", "e.nodes"), F.struct((-F.col("score")).alias("s"), "fid")).alias("b"))
        frontier = cut_lineage(best.select("uid", F.lit(hop).alias("depth"), "b.parent", "b.fid", F.concat("b.nodes", F.array("uid")).alias("nodes")))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen.withColumn("path", F.array_join(F.col("nodes").cast("array<string>"), " > "))


def explanations(reached: DataFrame, beliefs: DataFrame, seeds: DataFrame, threshold: float, most: int = 12, fallback: int = 8) -> DataFrame:
    """``rank, uid, path, isolated``: a report of ``most`` rows over what :func:`explain` reached.

    First the paths to nodes with a belief above ``threshold`` (to the ``fallback`` most believed nodes, if none is), by
    belief and uid; then the seeds that are on none of these paths, isolated, by belief and uid.
    """
    targets = beliefs.filter(F.col("belief") > threshold).select("uid", "belief")
    order = [F.col("belief").desc(), F.col("uid")]
    if targets.isEmpty():
        targets = beliefs.select("uid", "belief").orderBy(*order).limit(fallback)
    shown = cut_lineage(reached.select("uid", "nodes", "path").join(targets, "uid").orderBy(*order).limit(most))
    on = shown.select(F.explode("nodes").alias("uid")).distinct()
    alone = seeds.select("uid").distinct().join(beliefs.select("uid", "belief"), "uid").join(on, "uid", "left_anti").orderBy(*order).limit(most)
    both = shown.select(F.lit(False).alias("isolated"), "uid", "belief", "path").unionByName(alone.select(F.lit(True).alias("isolated"), "uid", "belief", F.col("uid").cast("string").alias("path")))
    rank = F.row_number().over(Window.orderBy("isolated", *order))  # two reports of ``most`` rows at most
    return both.withColumn("rank", rank).filter(F.col("rank") <= most).select("rank", "uid", "path", "isolated")


def collect_garbage(nodes: DataFrame, links: DataFrame, roots: DataFrame, tau: int, ttl: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept nodes, kept links, and a report ``uid, fate`` of orphans: removed, or protected while younger than ``ttl``. Nodes have ``added_at``."""
    lost = orphans(nodes, links, roots).join(nodes.select("uid", "added_at"), "uid")
    fate = lost.select("uid", F.when(tau - F.coalesce("added_at", F.lit(0)) >= ttl, "removed").otherwise("protected").alias("fate"))
    gone = fate.filter("fate = 'removed'").select("uid")
    kept = links.filter("w > 0")
    for end in ("e1", "e2"):
        kept = kept.join(gone.withColumnRenamed("uid", end), end, "left_anti")
    return nodes.join(gone, "uid", "left_anti"), kept, fate


def touched(members: DataFrame, activated: DataFrame, factors: DataFrame, events: DataFrame) -> DataFrame:
    """``part, id``: activated nodes, the factors and relations they take part in, and those factors' events (``fid, event``)."""
    f = members.join(activated.select("uid"), "uid", "left_semi").select("fid").distinct()
    relations = factors.join(f, "fid", "left_semi").select(F.lit("relation").alias("part"), F.col("relation").alias("id")).distinct()
    happened = events.join(f, "fid", "left_semi").select(F.lit("event").alias("part"), F.col("event").alias("id")).distinct()
    return activated.select(F.lit("node").alias("part"), F.col("uid").alias("id")).distinct().unionByName(f.select(F.lit("factor").alias("part"), F.col("fid").alias("id"))).unionByName(relations).unionByName(happened)


def chain_check(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """``case_id, linked, one_relation, answered`` of proofs ``case_id, pos, subject, relation, object`` and ``case_id, answer``."""
    w = Window.partitionBy("case_id").orderBy("pos")
    ahead = steps.withColumn("next", F.lead("subject").over(w))
    sums = ahead.groupBy("case_id").agg(
        F.bool_and(F.coalesce(F.col("next") == F.col("object"), F.col("next").isNull())).alias("linked"), (F.countDistinct("relation") == 1).alias("one_relation"), F.max_by("object", "pos").alias("last")
    )
    return sums.join(answers, "case_id").select("case_id", "linked", "one_relation", F.coalesce(F.col("last") == F.col("answer"), F.lit(False)).alias("answered"))


def proof_view(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """``case_id, view``: a proof's steps in order, with the labels (``uid, label``) of what they name where there is one."""
    named = steps
    for end in ("subject", "object"):
        named = named.join(labels.select(F.col("uid").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    line = F.concat_ws(" ", F.coalesce("subject_label", "subject"), "relation", F.coalesce("object_label", "object"))
    rows = named.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("all"))
    return rows.select("case_id", F.array_join(F.col("all.line"), "; ").alias("view"))


def issues(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``check, uid``: repeated uids, repeated property names (``names`` array), references ``uid, ref`` without a node."""
    twice = nodes.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("uid").alias("check"), "uid")
    named = nodes.filter(F.size("names") != F.size(F.array_distinct("names"))).select(F.lit("property").alias("check"), "uid")
    lost = refs.join(nodes.select(F.col("uid").alias("ref")).distinct(), "ref", "left_anti").select(F.lit("reference").alias("check"), "uid")
    return twice.unionByName(named).unionByName(lost)
