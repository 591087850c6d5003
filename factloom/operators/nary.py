"""Messages of factors with many members: cause, semantic and hypernode potentials.

Input rows are the members of factors with the message each sends: ``run_id, fid, uid, pos, role, p`` and the factor's
``w``. A target's message needs all others of its factor: where the potential is a mean or a product, "all but own" comes
from window totals and is linear in the arity; the exact hypernode gathers a factor's members, at most ``EXACT_ARITY``
of them, into one array. A member without a message (null) counts as one half. Members are distinct per factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import TINY, clip, pulled

KEY = ["run_id", "fid"]
EXACT_ARITY = 12


def evaluation_mode(potential: Column, arity: Column, configured: str = "auto", exact_max: int = EXACT_ARITY) -> Column:
    """Only hypernodes are summed over assignments; under ``auto`` up to an arity."""
    if configured not in ("auto", "exact", "approximate"):
        raise ValueError(f"unknown evaluation {configured}")
    mode = F.when(arity <= exact_max, "exact").otherwise("approximate") if configured == "auto" else F.lit(configured)
    return F.when(potential == "hypernode", mode).otherwise("closed_form")


def _with_totals(members: DataFrame, **sums: Column) -> DataFrame:
    w = Window.partitionBy(*KEY)
    rows = members.withColumn("p", F.coalesce("p", F.lit(0.5)))
    return rows.withColumns({**{name: F.sum(c).over(w) for name, c in sums.items()}, "n": F.count("*").over(w)})


def cause(members: DataFrame, ahead: float = 0.8, back: float = 0.15) -> DataFrame:
    """Mean of the others, strong towards the OBJECT; one member alone gets one half."""
    rows = _with_totals(members, total=F.col("p"))
    mean = F.when(F.col("n") > 1, (F.col("total") - F.col("p")) / (F.col("n") - 1)).otherwise(0.5)
    strength = clip(F.col("w") * F.when(F.col("role") == "OBJECT", ahead).otherwise(back))
    return rows.select(*KEY, "uid", pulled(mean, strength).alias("message"))


def semantic(members: DataFrame) -> DataFrame:
    """Mean of the others by what their relation lets pass (``forward`` from position 0, else ``backward``), pulled by ``w * confidence``."""
    c = F.when(F.col("pos") == 0, F.col("forward")).otherwise(F.col("backward"))
    rows = _with_totals(members.withColumn("c", c), total=F.col("c") * F.col("p"), passed=F.col("c"))
    passed = F.col("passed") - F.col("c")
    mean = F.when(passed > TINY, (F.col("total") - F.col("c") * F.col("p")) / passed).otherwise(0.5)
    return rows.select(*KEY, "uid", pulled(mean, clip(F.col("w") * F.col("confidence"))).alias("message"))


def hypernode_approximate(members: DataFrame, mode: str = "soft_and", lam: float = 0.5, strength: float = 0.6) -> DataFrame:
    """One signal from the others: their product, their mean pair product, or a blend of mean and product."""
    p, others = F.col("p"), F.col("n") - 1
    log = F.ln(F.greatest(p, F.lit(TINY)))
    rows = _with_totals(members, total=p, squares=p * p, logs=log)
    product, mean = F.exp(F.col("logs") - log), (F.col("total") - p) / others
    if mode == "and":
        signal = product
    elif mode == "pairwise":
        rest = F.col("total") - p
        signal = F.when(others > 1, (rest * rest - (F.col("squares") - p * p)) / (others * (others - 1))).otherwise(rest)
    elif mode == "soft_and":
        signal = (mean + lam * product) / (1 + lam)
    else:
        raise ValueError(f"unknown mode {mode}")
    message = F.when(others > 0, pulled(signal, clip(F.col("w") * strength))).otherwise(0.5)
    return rows.select(*KEY, "uid", message.alias("message"))


def _gain(ones: int, arity: int, mode: str, lam: float) -> float:
    """What an assignment with so many ones is worth."""
    full = float(ones == arity)
    if mode == "and":
        return full
    if mode == "pairwise":
        return ones * (ones - 1) / (arity * (arity - 1)) if arity > 1 else float(ones)
    if mode == "soft_and":
        return ones / arity + lam * full
    raise ValueError(f"unknown mode {mode}")


def _exact(p: np.ndarray, pull: np.ndarray, mode: str, lam: float) -> np.ndarray:
    """Messages to each member of factors of one arity: ``p`` is factor by member, ``pull`` by factor."""
    arity = p.shape[1]
    message = np.empty_like(p)
    for target in range(arity):
        chances = [np.ones(len(p))]
        for other in range(arity):
            if other != target:
                one = p[:, other]
                same, more = [*(c * (1 - one) for c in chances), 0.0], [0.0, *(c * one for c in chances)]
                chances = [a + b for a, b in zip(same, more, strict=True)]
        no, yes = (sum(c * np.exp(np.minimum(50.0, pull * _gain(k + side, arity, mode, lam))) for k, c in enumerate(chances)) for side in (0, 1))
        message[:, target] = yes / (no + yes)
    return message


def hypernode_exact(members: DataFrame, mode: str = "soft_and", lam: float = 0.5, strength: float = 0.6) -> DataFrame:
    """The sum over all assignments of the others.

    An assignment's worth depends on its number of ones alone, so the chances of 0, 1, 2, ... ones among the others,
    folded member by member, replace the 2^(n-1) terms. Factors of one arity in a batch are folded together.
    """
    _gain(0, 1, mode, lam)  # refuses an unknown mode
    sent = F.struct("uid", F.coalesce("p", F.lit(0.5)).alias("p"))
    together = members.groupBy(*KEY, F.col("w").cast("double").alias("w")).agg(F.collect_list(sent).alias("all"))
    arrays = together.select(*KEY, "w", F.col("all.uid").alias("uids"), F.col("all.p").alias("ps"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run_id, fid, w, uids, ps = batch.columns
            n, p = np.diff(np.asarray(ps.offsets)), ps.flatten().to_numpy(zero_copy_only=False)
            pull = np.fmax(0.0, w.to_numpy(zero_copy_only=False) * strength)
            first, message = np.cumsum(n) - n, np.empty(len(p))
            for arity in np.unique(n):
                rows = np.flatnonzero(n == arity)
                at = first[rows][:, None] + np.arange(arity)
                message[at] = _exact(p[at], pull[rows], mode, lam)
            factor = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([run_id.take(factor), fid.take(factor), uids.flatten(), pa.array(message)], names=[*KEY, "uid", "message"])

    types = members.select(*KEY, "uid").schema
    return arrays.mapInArrow(over, StructType([*types, StructField("message", DoubleType())]))


def hypernode(members: DataFrame, mode: str = "soft_and", exact_max: int = EXACT_ARITY, most: int | None = None) -> DataFrame:
    """Exact up to an arity, approximate beyond it. ``most`` is the largest arity, where the schema says so: up to
    ``exact_max`` nothing is counted, and members are read once."""
    if most is not None and most <= exact_max:
        return hypernode_exact(members, mode)
    n = F.count("*").over(Window.partitionBy(*KEY))
    sized = members.withColumn("arity", n)
    small, large = sized.filter(F.col("arity") <= exact_max).drop("arity"), sized.filter(F.col("arity") > exact_max).drop("arity")
    return hypernode_exact(small, mode).unionByName(hypernode_approximate(large, mode))
