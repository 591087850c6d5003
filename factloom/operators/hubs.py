"""Joins of many rows with one row per key, in which the rows of a hub are dealt among tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Rows of a key above which it is a hub; its rows are dealt into parts of about so many.
HUB_ROWS = 100_000
#: Hubs that are told to every task.
MAX_HUBS = 10_000
#: Slots of a sieve (see :func:`sieve`), and those that lie in one row.
MAX_SLOTS, BLOCK = 1 << 28, 1 << 15


def measure(rows: DataFrame, key: str, hub_rows: int = HUB_ROWS, max_hubs: int = MAX_HUBS) -> DataFrame | None:
    """``key, parts`` of the hubs of ``rows``, or None where there are none.

    A hub has more than ``hub_rows`` rows. Where more than ``max_hubs`` keys have, it is one with more than 1 in
    ``max_hubs`` of all their rows, so there are never more and the table is safe to broadcast, whatever the input; the
    keys left out hold a ten thousandth of the rows at most. Null keys join nothing and count for nothing. One
    aggregation, combined before its shuffle; its result has a row per ``hub_rows`` rows at most.
    """
    degrees = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > hub_rows)
    degrees = written(degrees.withColumn("parts", F.ceil(F.col("n") / hub_rows)))
    hubs, total = degrees.agg(F.count("*"), F.sum("n")).first()
    if hubs > max_hubs:
        degrees = degrees.filter(F.col("n") > total // max_hubs)
    return degrees.select(key, "parts") if hubs else None


def join(rows: DataFrame, one: DataFrame, keys: list[str], hubs: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """The equi-join (inner, or left with ``how``) of ``rows`` with ``one`` (a row or few per value of ``keys``), where a hub's rows meet in parts.

    ``hubs`` comes from :func:`measure` and names one of ``keys`` and its parts. A hub's rows are dealt into them by a
    hash of ``by`` and the other side's row is repeated once for each, so it grows by no more than the rows' own number
    divided by ``HUB_ROWS``. Every row meets what it would meet in a plain join, once; without hubs the join is plain.
    """
    if hubs is None:
        return rows.join(one, keys, how)
    key = hubs.columns[0]
    told = F.broadcast(hubs.withColumnRenamed("parts", "_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = rows.join(told, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    repeated = one.join(told, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def sieve(rows: DataFrame, one: DataFrame, keys: list[str], most: int = MAX_SLOTS) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not among those of ``one``, which is counted and so should be written.

    For a join of many rows with few keys, before it shuffles them: the hashes of the keys mark one slot of some 16 each, and
    all tasks are told the slots, 32 MB at most. A row that has a partner always stays; with very many keys more others do.
    """
    if any(rows.schema[k].dataType != one.schema[k].dataType for k in keys):
        return rows
    slots = min(most, max(BLOCK, 1 << (16 * one.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    word, bit = (lambda s: F.floor(s / 64)), (lambda s: (s % 64).cast("int"))
    marked = one.select(slot.alias("s")).groupBy(word(F.col("s")).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("s")))).alias("bits"))
    words = rows.sparkSession.range(slots // 64).join(marked, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    blocks = words.groupBy(F.floor(F.col("id") * 64 / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("w")).select("_block", F.col("w.bits").alias("_words"))
    found = F.element_at("_words", (word(F.col("_slot") % BLOCK) + 1).cast("int"))
    met = rows.withColumn("_slot", slot).join(F.broadcast(blocks), F.floor(F.col("_slot") / BLOCK) == F.col("_block"))
    return met.filter(F.call_function("shiftright", found, bit(F.col("_slot"))).bitwiseAND(F.lit(1).cast("long")) == 1).select(*rows.columns)
