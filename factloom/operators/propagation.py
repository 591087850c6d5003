"""Relation-agnostic activation spreading for many runs at once.

What a source sends does not depend on the target, so a target receives its factor's total less its own message. A
step is two aggregations (by factor and by node), linear in the number of members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, logistic
from ..runtime import cut_lineage, written
from . import hubs as hub_joins


#: Runs at most that are columns of a node.
WIDE = 16
#: Numbers of a role's state (a key and the runs of each node) that are told to every task, 32 MB.
TOLD = 4_000_000
#: Factors that lie in one task when they meet a role's state, about.
TASK_ROWS = 1_000_000

#: What is sent, by name: from activation x weight x confidence x transmission within [0, 1], and the factor's selectivity.
KERNELS: dict[str, Callable[[Column, Column], Column]] = {
    "linear": lambda x, selectivity: x,
    "decay": lambda x, selectivity: x,
    "sigmoid": lambda x, selectivity: logistic(8 * (x - selectivity)),
    "relu": lambda x, selectivity: clip(F.greatest(F.lit(0.0), x - 0.25 * selectivity)),
}


def kernel(name: str, linear: Column, selectivity: Column) -> Column:
    """What a registered kernel sends; users may add their own to :data:`KERNELS`."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name}")
    return KERNELS[name](clip(linear), selectivity)


def decayed(target: Column, decay: Column, linear: Column) -> Column:
    """A target that keeps its activation less the decay, and gets what is sent to it."""
    return clip(target * (1 - decay) + linear)


def mean_decay(members: DataFrame, factors: DataFrame, hub_factors: DataFrame | None = None) -> DataFrame:
    """``uid, decay``: mean over all incident factors."""
    return hub_joins.join(members, factors.select("fid", "decay"), ["fid"], hub_factors, "uid").groupBy("uid").agg(F.avg("decay").alias("decay"))


def messages(members: DataFrame, factors: DataFrame, state: DataFrame, name: str = "linear", hub_nodes: DataFrame | None = None, hub_factors: DataFrame | None = None) -> DataFrame:
    """``run_id, fid, uid, sent`` of active members; ``pos`` 0 is a factor's source. Inactive members are dropped before the join."""
    active = hub_joins.join(members, state.filter("x > 0"), ["uid"], hub_nodes, "fid")
    active = hub_joins.join(active, factors.select("fid", "w", "confidence", "forward", "backward", "selectivity"), ["fid"], hub_factors, "uid")
    through = F.when(F.col("pos") == 0, F.col("forward")).otherwise(F.col("backward"))
    return active.select("run_id", "fid", "uid", kernel(name, F.col("x") * F.col("w") * F.col("confidence") * through, F.col("selectivity")).alias("sent"))


def hubs_of(members: DataFrame, hub_rows: int = hub_joins.HUB_ROWS, most: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Nodes in more than ``hub_rows`` factors, and factors of more than ``hub_rows`` members; the latter are not looked for
    where ``most``, the largest number of members that the schema allows, is not above it."""
    small = most is not None and most <= hub_rows
    return hub_joins.measure(members, "uid", hub_rows), None if small else hub_joins.measure(members, "fid", hub_rows)


def propagate(members: DataFrame, factors: DataFrame, evidence: DataFrame, steps: int = 3, name: str = "linear", hubs: tuple[DataFrame | None, DataFrame | None] | None = None, apart: bool = False) -> DataFrame:
    """``run_id, uid, x`` after ``steps``; nodes that stay at 0 are left out. Evidence is ``run_id, uid, x``.

    The rows of ``hubs`` (measured by :func:`hubs_of` unless given) are dealt among tasks wherever they meet a state,
    parameters or a total. Up to :data:`WIDE` runs are columns of a node, so that members are shuffled once for all of
    them; with more, each run has its rows. ``apart`` says that no factor has a node twice, which spares a look at each node.
    """
    hubs = hubs_of(members) if hubs is None else hubs
    runs = [r.run_id for r in evidence.select("run_id").distinct().limit(WIDE + 1).collect()]
    return (_wide(members, factors, evidence, steps, name, hubs, runs, apart) if len(runs) <= WIDE else _long(members, factors, evidence, steps, name, hubs)).select("run_id", "uid", "x")


def _wide(members: DataFrame, factors: DataFrame, evidence: DataFrame, steps: int, name: str, hubs: tuple[DataFrame | None, DataFrame | None], runs: list, apart: bool) -> DataFrame:
    """A column ``x_i`` per run. Members go to their nodes' states and back to their factor, in which a window tells each
    what the others send; so a step shuffles them twice, and what they get once, summed before that."""
    hub_nodes, hub_factors = hubs
    kind, which = evidence.schema["run_id"].dataType, range(len(runs))
    zero, through = F.lit(0.0), F.when(F.col("pos") == 0, F.col("forward")).otherwise(F.col("backward"))
    is_run = lambda i: F.col("run_id").eqNullSafe(F.lit(runs[i]).cast(kind))
    state = evidence.groupBy("uid").agg(*[F.sum(F.when(is_run(i), clip(F.col("x"))).otherwise(zero)).alias(f"x_{i}") for i in which])
    params = factors.select("fid", "w", "confidence", "forward", "backward", "selectivity", "decay")
    for step in range(1, steps + 1):
        live = state.filter(" or ".join(f"x_{i} > 0" for i in which) or "false")
        met = hub_joins.join(members.select("fid", "uid", "pos"), live, ["uid"], hub_nodes, "fid", "left")
        met = hub_joins.join(met, params, ["fid"], hub_factors, "uid")
        sends = [F.when(F.col(f"x_{i}") > 0, kernel(name, F.col(f"x_{i}") * F.col("w") * F.col("confidence") * through, F.col("selectivity"))).otherwise(zero).alias(f"s_{i}") for i in which]
        sent = met.select("fid", "uid", "decay", *sends)
        if hub_factors is None:
            own, all_of = Window.partitionBy("fid", "uid"), Window.partitionBy("fid")
            got = sent.withColumns({f"o_{i}": F.col(f"s_{i}") if apart else F.sum(f"s_{i}").over(own) for i in which}).withColumns({f"t_{i}": F.sum(f"s_{i}").over(all_of) for i in which})
            got = got.select("uid", "decay", F.lit(1).alias("n"), *[f"o_{i}" for i in which], *[f"t_{i}" for i in which])
        else:
            own = sent.groupBy("fid", "uid").agg(F.max("decay").alias("decay"), F.count("*").alias("n"), *[F.sum(f"s_{i}").alias(f"o_{i}") for i in which])
            totals = sent.groupBy("fid").agg(*[F.sum(f"s_{i}").alias(f"t_{i}") for i in which])
            got = hub_joins.join(own, totals, ["fid"], hub_factors, "uid")
        gets = [F.sum(F.col("n") * (F.col(f"t_{i}") - F.col(f"o_{i}"))).alias(f"z_{i}") for i in which]
        gets = got.groupBy("uid").agg((F.sum(F.col("n") * F.col("decay")) / F.sum("n")).alias("decay"), *gets)
        kept = lambda i: F.coalesce(f"x_{i}", zero) * (1 - F.coalesce("decay", F.lit(0.1)))
        after = [clip(kept(i) + F.greatest(F.coalesce(f"z_{i}", zero), zero)) for i in which]
        state = gets.join(state, "uid", "full").select("uid", *[F.when(x > 1e-15, x).otherwise(zero).alias(f"x_{i}") for i, x in enumerate(after)])
        state = state.filter(" or ".join(f"x_{i} > 0" for i in which) or "false")
        if step < steps:
            state = cut_lineage(state)
    rows = F.array(*[F.struct(F.lit(runs[i]).cast(kind).alias("run_id"), F.col(f"x_{i}").alias("x")) for i in which])
    return state.select("uid", F.explode(rows).alias("r")).select("r.run_id", "uid", "r.x").filter("x > 0") if runs else evidence.select("run_id", "uid", "x").limit(0)


def _long(members: DataFrame, factors: DataFrame, evidence: DataFrame, steps: int, name: str, hubs: tuple[DataFrame | None, DataFrame | None]) -> DataFrame:
    """A row per run and node."""
    hub_nodes, hub_factors = hubs
    decay = mean_decay(members, factors, hub_factors)
    state = evidence.select("run_id", "uid", clip(F.col("x")).alias("x"))
    for step in range(1, steps + 1):
        sent = messages(members, factors, state, name, hub_nodes, hub_factors)
        totals = sent.groupBy("run_id", "fid").agg(F.sum("sent").alias("total"))
        got = hub_joins.join(members.select("fid", "uid"), totals, ["fid"], hub_factors, "uid").join(sent, ["run_id", "fid", "uid"], "left")
        incoming = got.select("run_id", "uid", (F.col("total") - F.coalesce("sent", F.lit(0.0))).alias("z"), F.lit(0.0).alias("x"))
        both = incoming.unionByName(state.select("run_id", "uid", F.lit(0.0).alias("z"), "x")).groupBy("run_id", "uid").agg(F.sum("z").alias("z"), F.sum("x").alias("x"))
        kept = F.col("x") * (1 - F.coalesce("decay", F.lit(0.1)))
        state = both.join(decay, "uid", "left").select("run_id", "uid", clip(kept + F.greatest(F.col("z"), F.lit(0.0))).alias("x")).filter("x > 1e-15")
        if step < steps:
            state = cut_lineage(state)
    return state


def propagate_rows(rows: DataFrame, roles: list[str], evidence: DataFrame, runs: list, steps: int = 3, kernels: tuple[str, ...] = ("linear",), wanted: list[str] | None = None, every: bool = False, told: int = TOLD, hub_rows: int = hub_joins.HUB_ROWS) -> DataFrame:
    """``kernel, run_id, step, role, node, x`` of factors that are rows: a column of nodes per role (the first is the source), each
    role with nodes of its own kind. As :func:`propagate` otherwise, without its members: a row sees all that its members send.

    Evidence is ``run_id, role, node, x``, where a role is its place in ``roles``. All kernels and ``runs`` (:data:`WIDE` together
    at most) are columns of a node. A step takes each row once to the state of a role with many nodes, fewest first; a role's state
    of up to ``told`` numbers is told to all tasks, and one that nobody who is asked for can hear is left out. Nodes that
    have more than ``hub_rows`` rows then meet them in parts. What each node hears is summed before its one shuffle.

    The last step tells of ``wanted`` roles only, if they are named; with ``every`` the states of all steps are returned.
    Rows are read in each step, so they should be written. A parameter that is the same for all of them is not carried along.
    """
    kind, zero = evidence.schema["run_id"].dataType, F.lit(0.0)
    columns = [(k, r) for k in kernels for r in runs]
    if not columns or len(columns) > WIDE:
        raise ValueError(f"1 to {WIDE} runs of all kernels")
    which, name_of = range(len(columns)), lambda role: roles[role]
    is_run = lambda r: F.col("run_id").eqNullSafe(F.lit(r).cast(kind))
    alive = " or ".join(f"x_{i} > 0" for i in which)
    state = written(evidence.groupBy("role", "node").agg(*[F.sum(F.when(is_run(r), clip(F.col("x"))).otherwise(zero)).alias(f"x_{i}") for i, (_, r) in enumerate(columns)]).filter(alive))
    names = ("w", "confidence", "forward", "backward", "selectivity", "decay")
    seen_in = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in names for n, f in (("count", F.count), ("min", F.min), ("max", F.max))]).first()
    fixed = {c: seen_in[f"min_{c}"] for c in names if seen_in.n and seen_in[f"count_{c}"] == seen_in.n and seen_in[f"min_{c}"] == seen_in[f"max_{c}"]}
    param = lambda c: F.lit(fixed[c]).cast("double") if c in fixed else F.col(c)
    parts = max(-(-seen_in.n // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hubs: dict[str, DataFrame | None] = {}
    seen: list[tuple[int, DataFrame]] = []
    for step in range(1, steps + 1):
        targets = roles if wanted is None or step < steps else [r for r in roles if r in wanted]
        nodes = {name_of(r.role): r.n for r in state.groupBy("role").agg(F.count("*").alias("n")).collect()}
        senders = sorted((r for r in roles if nodes.get(r) and any(t != r for t in targets)), key=lambda r: (nodes[r] * (len(columns) + 1) <= told, nodes[r]))
        dealt = [r for r in senders if nodes[r] * (len(columns) + 1) > told]
        through = lambda r: param("forward" if r == roles[0] else "backward")
        sent = lambda r, i: F.when(F.col(f"x_{r}_{i}") > 0, kernel(columns[i][0], F.col(f"x_{r}_{i}") * param("w") * param("confidence") * through(r), param("selectivity"))).otherwise(zero)
        # a coalesce that merges nothing keeps Spark from one generated method for all roles, too long to be compiled
        says = lambda df, due: df.coalesce(parts).withColumns({f"s_{d}_{i}": sent(d, i) for d in due for i in which}).drop(*[f"x_{d}_{i}" for d in due for i in which]) if due else df
        met, due = rows, []
        for no, r in enumerate(senders, 1):
            of = state.filter(F.col("role") == roles.index(r)).select(F.col("node").alias(r), *[F.col(f"x_{i}").alias(f"x_{r}_{i}") for i in which])
            if r in dealt and r not in hubs:
                hubs[r] = hub_joins.measure(rows.select(r), r, hub_rows)
            if r not in dealt:
                met = met.join(F.broadcast(of), r, "left")
            elif hubs[r] is None:
                met = met.repartition(parts, r).join(of.hint("merge"), r, "left")
            else:
                met = hub_joins.join(met, of, [r], hubs[r], next(t for t in roles if t != r), "left")
            # activations are carried to the last shuffle (they repeat), then each role's messages are made
            if no >= len(dealt):
                met, due = says(met, due), []
            due.append(r)
        met = says(met, due).coalesce(parts)
        met = met.select(*targets, *[c for c in ["decay"] if c not in fixed], *[f"s_{r}_{i}" for r in senders for i in which])
        extra = {} if "decay" in fixed else {"decay": F.col("decay"), "n": F.lit(1)}
        hears = lambda t, i: sum((F.col(f"s_{r}_{i}") for r in senders if r != t), zero)
        each = F.array(*[F.struct(F.lit(roles.index(t)).alias("role"), F.col(t).alias("node"), *[hears(t, i).alias(f"z_{i}") for i in which], *[c.alias(n) for n, c in extra.items()]) for t in targets])
        gets = met.select(F.explode(each).alias("m")).select("m.*").filter("node is not null").groupBy("role", "node").agg(*[F.sum(c).alias(c) for c in [*[f"z_{i}" for i in which], *extra]])
        decay = F.col("decay") / F.col("n") if extra else F.when(F.col("z_0").isNotNull(), param("decay"))
        kept = lambda i: F.coalesce(f"x_{i}", zero) * (1 - F.coalesce(decay, F.lit(0.1)))
        after = [clip(kept(i) + F.greatest(F.coalesce(f"z_{i}", zero), zero)) for i in which]
        before = state.filter(F.col("role").isin([roles.index(t) for t in targets]))
        state = gets.join(before, ["role", "node"], "full").select("role", "node", *[F.when(x > 1e-15, x).otherwise(zero).alias(f"x_{i}") for i, x in enumerate(after)]).filter(alive)
        state = written(state) if step < steps else state
        seen.append((step, state))
    out = None
    for step, state in seen if every else seen[-1:]:
        each = F.array(*[F.struct(F.lit(k).alias("kernel"), F.lit(r).cast(kind).alias("run_id"), F.col(f"x_{i}").alias("x")) for i, (k, r) in enumerate(columns)])
        now = state.select("role", "node", F.explode(each).alias("r")).select("r.kernel", "r.run_id", F.lit(step).alias("step"), "role", "node", "r.x").filter("x > 0")
        out = now if out is None else out.unionByName(now)
    return out
