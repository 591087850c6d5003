"""Similarity joins that are exact and meet on few tokens: rare tokens come first, and only a start of each list is joined.

A side is ``id, token`` (and ``v``), one row per distinct token. Tokens are put in one order for both sides: those that
hold more than one ``SHARE``-th of all rows last, by their number of rows, all others before them. Of frequent tokens
there can be no more than ``SHARE``, whatever the data, so their table is broadcast. Two lists that are similar enough
share a token within a start of each, whose length follows from the threshold; a pair is looked at once, at the first
token that the two starts share. What frequent tokens are left in starts is dealt into tiles of ``tile`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

#: A token is frequent when it holds more than one in so many rows; there are at most so many frequent tokens.
SHARE = 10_000
#: Rows of a token's list that one task pairs.
TILE = 20_000


def frequent_tokens(*sides: DataFrame) -> DataFrame:
    """``token, n`` of frequent tokens, ``SHARE`` of them at most."""
    rows = sides[0].select("token")
    for side in sides[1:]:
        rows = rows.unionByName(side.select("token"))
    counts = cut_lineage(rows.groupBy("token").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * SHARE > total)


def ordered(side: DataFrame, ids: list[str], frequent: DataFrame) -> DataFrame:
    """``ids, all``: each id's tokens as one list in the common order, with ``n`` (0 for rare ones)."""
    each = [F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("token")] + ([F.col("v").cast("double").alias("v")] if "v" in side.columns else [])
    return side.join(F.broadcast(frequent), "token", "left").groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(*each))).alias("all"))


def meet(left: DataFrame, right: DataFrame, fit: Column | None = None, tile: int = TILE) -> DataFrame:
    """Pairs whose starts (``left_all`` and ``right_all`` up to ``left_start`` and ``right_start``) share a token, each once.

    ``fit`` is a condition on both sides' columns. A frequent token's right rows lie in tiles, its left rows go to each
    of them; so a task holds one tile's rows and not the token's whole list.
    """
    start = lambda side: F.slice(f"{side}_all", F.lit(1), F.col(f"{side}_start"))
    tiles = F.floor(F.col("t.n") / tile)
    a = left.select("*", F.explode(start("left")).alias("t")).select("*", F.col("t.token").alias("token"), F.explode(F.sequence(F.lit(0).cast("long"), tiles)).alias("tile")).drop("t")
    own = [c for c in right.columns if c not in ("right_all", "right_start")]
    b = right.select("*", F.explode(start("right")).alias("t")).select("*", F.col("t.token").alias("token"), F.pmod(F.xxhash64(*own), tiles + 1).alias("tile")).drop("t")
    both = a.join(b, ["token", "tile"])
    if fit is not None:
        both = both.filter(fit)
    first = F.array_intersect(start("left")["token"], start("right")["token"])[0]
    return both.filter(first == F.col("token")).drop("token", "tile", "left_start", "right_start")


def _side(df: DataFrame, side: str, start: Column) -> DataFrame:
    return df.select("*", start.cast("int").alias(f"{side}_start")).withColumnRenamed("all", f"{side}_all")


def dice_pairs(left: DataFrame, right: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """All pairs of lists of :func:`ordered` with a common token and a Dice coefficient of ``least`` or more, with ``score``.

    A list of n tokens has at least ``least / (2 - least) * n`` in common with any partner, so its start are all tokens
    but so many, and one. At ``least`` 0 the start is the whole list.
    """
    share = least / (2 - least)
    start = F.size("all") - F.greatest(F.lit(1), F.ceil(F.size("all") * share - 1e-9)) + 1
    n, m = F.size("left_all"), F.size("right_all")
    fit = (m >= n * share - 1e-9) & (n >= m * share - 1e-9)
    both = meet(_side(left, "left", start), _side(right, "right", start), fit, tile)
    common = F.size(F.array_intersect(F.col("left_all.token"), F.col("right_all.token")))
    return both.withColumn("score", 2 * common / (n + m)).drop("left_all", "right_all").filter(F.col("score") >= least)


def best_dice(left: DataFrame, right: DataFrame, left_id: str, right_id: str, levels: tuple[float, ...] = (0.8, 0.5, 0.25, 0.0), tile: int = TILE) -> DataFrame:
    """``left_id, right_id, score``: each left list's best right one, the smaller number on ties; none without a common token.

    The highest level comes first; a list that finds a partner there has its best one among them, and only the others
    go on to the next level with its longer starts. So few lists are joined by all their tokens.
    """
    rest, out = left, None
    for no, least in enumerate(levels):
        pairs = dice_pairs(rest, right, least, tile)
        best = pairs.groupBy(left_id).agg(F.max(F.struct("score", (-F.col(right_id)).alias("back"))).alias("best"))
        found = cut_lineage(best.select(left_id, (-F.col("best.back")).alias(right_id), "best.score"))
        out = found if out is None else out.unionByName(found)
        if no + 1 < len(levels):
            rest = cut_lineage(rest.join(found.select(left_id), left_id, "left_anti"))
            if rest.isEmpty():
                break
    return out


def cosine_pairs(left: DataFrame, right: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """All pairs of lists of :func:`ordered` with ``v`` that share a token and have a cosine, rounded to 9 places, of ``least``
    or more, with ``score``.

    By Cauchy and Schwarz the tokens after a start add at most their own length; a start ends where that falls below
    ``least`` of the whole length. ``least`` must be above 0.
    """
    if least <= 0:
        raise ValueError("the least cosine must be above 0")
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["v"] * x["v"])
    bound = size(F.col("all")) * max(least - 1e-6, 0.0) ** 2
    walk = F.aggregate("all", F.struct(size(F.col("all")).alias("rest"), F.lit(0).alias("p")), lambda s, x: F.struct((s["rest"] - x["v"] * x["v"]).alias("rest"), (s["p"] + F.when(s["rest"] >= bound, 1).otherwise(0)).alias("p")))["p"]
    both = meet(_side(left, "left", walk), _side(right, "right", walk), None, tile)
    both = both.withColumn("known", F.map_from_entries(F.transform("right_all", lambda x: F.struct(x["token"], x["v"]))))
    dot = F.aggregate("left_all", F.lit(0.0), lambda s, x: s + x["v"] * F.coalesce(F.col("known")[x["token"]], F.lit(0.0)))
    score = F.round(dot / (F.sqrt(size(F.col("left_all"))) * F.sqrt(size(F.col("right_all")))), 9)
    return both.withColumn("score", score).drop("left_all", "right_all", "known").filter(F.col("score") >= least)
