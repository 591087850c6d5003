"""Reachability, closure and hygiene of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, written


def reachable(edges: DataFrame, roots: DataFrame, max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """``uid, hops`` of all nodes reached from ``roots`` (uid) over ``e1, e2``, within ``max_hops`` if given.

    A frontier join and an anti join per hop; where only being reached counts, :func:`connected` needs fewer rounds.
    """
    steps = edges.select(F.col("e1").alias("uid"), F.col("e2").alias("next"))
    if not directed:
        steps = steps.unionByName(edges.select(F.col("e2").alias("uid"), F.col("e1").alias("next")))
    steps = steps.distinct()
    steps = cut_lineage(steps)
    seen = frontier = cut_lineage(roots.select("uid", F.lit(0).alias("hops")).distinct())
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        found = frontier.join(steps, "uid").select(F.col("next").alias("uid")).distinct().join(seen, "uid", "left_anti")
        frontier = cut_lineage(found.select("uid", F.lit(hop).alias("hops")))
        if frontier.isEmpty():
            break
        # frontiers are written once each; now and then their union is, so that plans stay short
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:
            seen = cut_lineage(seen)
    return seen


def connected(edges: DataFrame) -> DataFrame:
    """``uid, root``: the smallest node of each node's component over undirected ``e1, e2``; loops and nulls are dropped.

    Nodes are linked to the smallest node they know of, by turns those above and those below a node, until nothing
    changes: rounds grow with the logarithm of a component's size rather than with its diameter.
    """
    pairs = cut_lineage(edges.filter("e1 <> e2").select(F.greatest("e1", "e2").alias("high"), F.least("e1", "e2").alias("low")).distinct())
    total = None
    while True:
        near = pairs.select(F.col("high").alias("uid"), F.col("low").alias("other")).unionByName(pairs.select(F.col("low").alias("uid"), F.col("high").alias("other")))
        least = near.groupBy("uid").agg(F.least(F.min("other"), F.col("uid")).alias("root"))
        above = near.join(least, "uid").filter("other > uid").select(F.col("other").alias("high"), F.col("root").alias("low")).distinct()
        above = cut_lineage(above)
        least = above.groupBy("high").agg(F.min("low").alias("root"))
        below = above.join(least, "high")
        linked = below.select(F.col("low").alias("high"), F.col("root").alias("low")).filter("high <> low").unionByName(least.select("high", F.col("root").alias("low")))
        pairs = cut_lineage(linked.distinct())
        now = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("high", "low"), F.lit(1 << 40)))).first()
        if now == total:
            break
        total = now
    return pairs.select(F.col("high").alias("uid"), F.col("low").alias("root")).unionByName(pairs.select(F.col("low").alias("uid"), F.col("low").alias("root")).distinct())


def orphans(nodes: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes whose links all have weight 0 or that have none, or that no root reaches; roots are none. ``uid``."""
    ends = links.select(F.col("e1").alias("uid"), "w").unionByName(links.select(F.col("e2").alias("uid"), "w"))
    weight = ends.groupBy("uid").agg(F.max("w").alias("w"))
    parts = connected(links.filter("w > 0"))
    rooted = parts.join(roots.select("uid").distinct(), "uid", "left_semi").select("root").distinct()
    live = parts.join(rooted, "root", "left_semi").select("uid")
    alive = live.join(weight.filter("w > 0").select("uid"), "uid", "left_semi").unionByName(roots.select("uid"))
    return nodes.select("uid").join(alive, "uid", "left_anti")


def _state(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Number of rows and a sum of hashes, by which two steps of a loop are told apart."""
    n, total = df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)))).first()
    return n, total or 0


def _chains(edges: DataFrame) -> DataFrame:
    """``uid, up, down, low`` of every node with one edge in and one out: the ends of its chain, found by doubling.

    ``up`` and ``down`` are the nearest nodes above and below that are no such nodes; on a ring without any they are null,
    and ``low`` is the ring's smallest node.
    """
    into = edges.groupBy(F.col("e2").alias("uid")).agg(F.count("*").alias("n_in"), F.min("e1").alias("up"))
    out = edges.groupBy(F.col("e1").alias("uid")).agg(F.count("*").alias("n_out"), F.min("e2").alias("down"))
    links = into.join(out, "uid").filter("n_in = 1 and n_out = 1").select("uid", "up", "down")
    links = written(links)
    inner = links.select(F.col("uid").alias("inner"))
    ends = links.join(inner.withColumnRenamed("inner", "up").withColumn("u", F.lit(True)), "up", "left").join(inner.withColumnRenamed("inner", "down").withColumn("d", F.lit(True)), "down", "left")
    # a pointer is open while it leads to a node that is itself in a chain
    rows = ends.select("uid", "up", F.col("u").isNotNull().alias("up_open"), "down", F.col("d").isNotNull().alias("down_open"), F.col("uid").alias("low"))
    rows = written(rows)
    before = None
    while True:
        now = _state(rows.filter("up_open or down_open"), "uid", "low", "up_open", "down_open")
        if not now[0] or now == before:
            break
        before = now
        # closed pointers, which come to be most and name few nodes, take no part in the joins
        there = lambda way: rows.select(F.col("uid").alias(f"{way}_at"), F.col(way).alias(f"{way}_next"), F.col(f"{way}_open").alias(f"{way}_on"), F.col("low").alias(f"{way}_low"))
        met = rows.join(there("up"), F.when(F.col("up_open"), F.col("up")) == F.col("up_at"), "left").join(there("down"), F.when(F.col("down_open"), F.col("down")) == F.col("down_at"), "left")
        jump = lambda way: [F.when(F.col(f"{way}_open"), F.col(f"{way}_next")).otherwise(F.col(way)).alias(way), (F.col(f"{way}_open") & F.col(f"{way}_on")).alias(f"{way}_open")]
        low = F.least("low", F.when(F.col("up_open"), F.col("up_low")), F.when(F.col("down_open"), F.col("down_low")))
        rows = written(met.select("uid", *jump("up"), *jump("down"), low.alias("low")))
    return rows.select("uid", F.when(~F.col("up_open"), F.col("up")).alias("up"), F.when(~F.col("down_open"), F.col("down")).alias("down"), "low")


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``uid, label`` with each node's smallest label of all that reach it over ``e1, e2``."""
    before = None
    while True:
        heard = labels.join(edges, F.col("uid") == F.col("e1")).groupBy(F.col("e2").alias("uid")).agg(F.min("label").alias("heard"))
        labels = written(labels.join(heard, "uid", "left").select("uid", F.least("label", "heard").alias("label")))
        now = _state(labels, "uid", "label")
        if now == before:
            return labels
        before = now


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges that have one before and one after them."""
    return edges.join(edges.select(F.col("e2").alias("e1")).distinct(), "e1", "left_semi").join(edges.select(F.col("e1").alias("e2")).distinct(), "e2", "left_semi").select("e1", "e2")


def _core_cycles(edges: DataFrame) -> DataFrame:
    """``uid, component`` of the nodes of a graph's strongly connected components of several nodes, by forward and backward labels."""
    found = None
    while True:
        # what has no edge in or none out lies on no cycle
        before = None
        while True:
            edges = written(_peeled(edges))
            now = _state(edges, "e1", "e2")
            if now == before:
                break
            before = now
        if edges.isEmpty():
            return found
        nodes = edges.select(F.explode(F.array("e1", "e2")).alias("uid")).distinct()
        colors = _spread(edges, nodes.select("uid", F.col("uid").alias("label")))
        # within one color, what reaches the node that gave it is a component
        side = lambda end: colors.select(F.col("uid").alias(end), F.col("label").alias(f"c_{end}"))
        same = written(edges.join(side("e1"), "e1").join(side("e2"), "e2").filter("c_e1 = c_e2").select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), "c_e1"))
        seeds = colors.select("uid", F.when(F.col("uid") == F.col("label"), F.col("label")).alias("label"))
        part = _spread(same.select("e1", "e2"), seeds).filter("label is not null").select("uid", F.col("label").alias("component"))
        part = written(part.join(part.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1"), "component", "left_semi").select("uid", "component"))
        found = part if found is None else found.unionByName(part)
        done = colors.join(part, "uid", "left_anti").filter("uid <> label").select("uid")
        # components are complete: what is left are other nodes of each color
        edges = written(same.select(F.col("e2").alias("e1"), F.col("e1").alias("e2")).join(done.withColumnRenamed("uid", "e1"), "e1", "left_semi").join(done.withColumnRenamed("uid", "e2"), "e2", "left_semi"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """``uid, component``: the nodes that lie on a cycle of directed edges ``e1, e2``, with the smallest node of their part.

    Chains are shortened to one edge by doubling pointers, so their length counts by its logarithm; rings are found
    there, too. Then nodes without an edge in or out are peeled, and what is left is split into strongly connected
    components by labels that spread forward and back; a chain lies on a cycle if its ends lie in one component. A
    part's name is its smallest node that is no inner node of a chain. Edges with a null end are left out.
    """
    rows = written(edges.filter("e1 is not null and e2 is not null").select("e1", "e2").distinct())
    loops = rows.filter("e1 = e2").select(F.col("e1").alias("uid"))
    plain = rows.filter("e1 <> e2")
    chains = written(_chains(plain))
    rings = chains.filter("up is null").select("uid", F.col("low").alias("component"))
    inner = chains.select("uid")
    direct = plain.join(inner.withColumnRenamed("uid", "e1"), "e1", "left_anti").join(inner.withColumnRenamed("uid", "e2"), "e2", "left_anti")
    bridges = chains.filter("up is not null and down is not null")
    short = direct.unionByName(bridges.select(F.col("up").alias("e1"), F.col("down").alias("e2"))).distinct()
    core = _core_cycles(short.filter("e1 <> e2"))
    alone = short.filter("e1 = e2").select(F.col("e1").alias("uid")).unionByName(loops).distinct()
    alone = alone if core is None else alone.join(core, "uid", "left_anti")
    named = alone.select("uid", F.col("uid").alias("component"))
    named = written(named if core is None else named.unionByName(core))
    of = lambda end: named.select(F.col("uid").alias(end), F.col("component").alias(f"c_{end}"))
    inside = bridges.join(of("up"), "up").join(of("down"), "down").filter("c_up = c_down").select("uid", F.col("c_up").alias("component"))
    rings = rings.join(loops, "uid", "left_anti")
    return named.join(rings, "uid", "left_anti").unionByName(inside.join(named, "uid", "left_anti")).unionByName(rings)


def has_cycle(edges: DataFrame) -> bool:
    """Whether directed edges ``e1, e2`` hold a cycle.

    A loop or two opposite edges settle it at once. Else nodes without an edge in or out are peeled as long as each layer
    takes a tenth of what is left, so that all layers together read some ten times the edges at most; the rest, such as
    long chains, goes to :func:`cycle_nodes`.
    """
    rows = written(edges.filter("e1 is not null and e2 is not null").select("e1", "e2").distinct())
    opposite = rows.groupBy(F.least("e1", "e2"), F.greatest("e1", "e2")).agg(F.count("*").alias("n"), F.first(F.col("e1") == F.col("e2")).alias("loop"))
    if not opposite.filter("n > 1 or loop").isEmpty():
        return True
    n = rows.count()
    while n:
        rows, before = written(_peeled(rows)), n
        n = rows.count()
        if n > before * 0.9:
            return not cycle_nodes(rows).isEmpty()
    return False


def closure(edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``uid, ancestor, hops`` (fewest) over ``e1`` is-a ``e2``, within ``max_hops`` if given, with a visited set, so cycles end."""
    seen = cut_lineage(edges.select(F.col("e1").alias("uid"), F.col("e2").alias("ancestor"), F.lit(1).alias("hops")).distinct())
    frontier = seen
    hop = 1
    while max_hops is None or hop < max_hops:
        hop += 1
        up = frontier.join(edges.select(F.col("e1").alias("ancestor"), "e2"), "ancestor").select("uid", F.col("e2").alias("ancestor")).distinct()
        frontier = cut_lineage(up.join(seen, ["uid", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(refs: DataFrame, ref: str, targets: DataFrame, uid: str) -> DataFrame:
    """References without a target row."""
    return refs.join(targets.select(F.col(uid).alias(ref)).distinct(), ref, "left_anti")
