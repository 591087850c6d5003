"""Ordered folds of an event log into keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fill_template


def fold_set_delete(ops: DataFrame) -> DataFrame:
    """``key, value`` after all set and delete operations (``key, seq, op, value``); combined before the shuffle."""
    last = ops.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.filter("last.op = 'set'").select("key", "last.value")


def fold_append(ops: DataFrame) -> DataFrame:
    """``key, values`` in order of ``seq``, repeats kept."""
    listed = ops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("all"))
    return listed.select("key", F.transform("all", lambda x: x["value"]).alias("values"))


def transitions(ops: DataFrame) -> DataFrame:
    """Value before and after each operation of a key; deleted is null."""
    after = F.when(F.col("op") == "set", F.col("value"))
    w = Window.partitionBy("key").orderBy("seq")
    return ops.withColumn("after", after).withColumn("before", F.lag("after").over(w)).select("key", "seq", "op", "before", "after")


def holdings(ops: DataFrame) -> DataFrame:
    """``owner, item, since`` of what is held at the end: re-gained items count from their last gain, given ones go."""
    last = ops.groupBy("owner", "item").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("since"))
    return last.filter("op = 'gain'").select("owner", "item", "since")


def expand_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``seq, op, key, value`` of each event (``seq, relation, roles``) and each rule of its relation (``relation, op, key, value``).

    {ROLE} in a rule's key and value is the event's filler; a role the event lacks leaves its braces, and ``missing`` is true.
    """
    filled = lambda template: fill_template(F.col(template), F.col("roles"))
    joined = events.join(rules, "relation")
    rows = joined.select("seq", "op", filled("key").alias("key"), filled("value").alias("value"))
    return rows.withColumn("missing", F.coalesce(F.concat("key", F.coalesce("value", F.lit(""))).rlike(r"\{[A-Z_]+\}"), F.lit(False)))
