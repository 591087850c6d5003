"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's share of all words is dealt to its documents as expected copies, in proportion to the document's grade (the
number of binary digits of its size, so that longer documents are likelier), up to ``max_copies`` each. The whole part
of a document's expected copies is allocated for certain; the fraction is its inclusion probability p in a Pareto
sample: documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)) with a keyed uniform u,
and the smallest ranks are taken until the source's remaining words are filled (to within half a document). The size
that is fixed is that of the mix in words: a fixed number of documents would miss the target in words.

The cut in rank order needs no sort of a source: words are summed by bins of rank / (1 + rank), bins are accumulated,
and only the bin in which the cut falls is ordered. Documents then compare their rank with their source's cut where
they are, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD_PATTERN, materialize, read, require

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-2"
#: Rows of a bin, on average over the corpus.
BIN_ROWS = 20_000
MAX_BINS = 1 << 20


def source_targets(sizes: DataFrame, total: int, max_copies: int = MAX_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from one row per source (``source, source_size``).

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. A target stops at ``max_copies``
    times its source; what is left is shared again by weight until no target is above. Only sums come to the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    table = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    table = materialize(table.withColumn("cap", F.col("source_size") * max_copies), "mix-sources")
    rest, weight, level = total, None, None
    while True:
        # a source is at its cap when its share at the present level lies above the cap
        full = F.lit(False) if level is None else F.col("cap").cast("double") < F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))
        at_cap, free = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        now = (total - int(at_cap or 0), int(free or 0))
        if now == level or not now[1]:
            break
        level, (rest, weight) = now, now
    if not weight:
        return table.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *others: Column) -> DataFrame:
    """``source, size, grade, u, tie`` of each row, in place; u and the tie come from a digest of seed, id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(SPACE_WORD_PATTERN)).cast("long")
    tie = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed), F.md5(text)))
    rows = docs.select(*others, F.col(source_col).alias("source"), size.alias("size"), tie.alias("tie"))
    grade = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    u = (F.conv(F.substring("tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return rows.withColumn("grade", grade).withColumn("u", u)


def expected_copies(grades: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``source, grade, source_size, target, whole, p, rest`` from the words of each source and grade.

    Expected copies are a source's rate times the grade, at most ``max_copies``; the rate fills the target. From the
    highest grade down, grades are at the bound until the rate that is left for the others keeps below it.
    """
    rows = grades.alias("g").join(targets.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", "t.source_size", "t.target")
    down = Window.partitionBy("source").orderBy(F.desc("grade"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum(F.col("grade") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = F.when(weight > 0, (F.col("target") - max_copies * above) / weight.cast("double"))
    fits = F.when(rate * F.col("grade") <= max_copies, F.col("grade"))
    rows = rows.withColumn("rate", rate).withColumn("fits", fits)
    rows = rows.withColumn("rate", F.max_by("rate", "fits").over(Window.partitionBy("source")))
    copies = F.when(F.col("grade") == 0, 0.0).otherwise(F.least(F.coalesce(F.col("rate") * F.col("grade"), F.lit(float(max_copies))), F.lit(float(max_copies))))
    rows = rows.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return rows.withColumn("rest", rest).select("source", "grade", "source_size", "target", "whole", "p", "rest")


def _rank() -> Column:
    return F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))


def mix_plan(rows: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, grade, source_size, target, whole, p, cut`` of a written table of :func:`measured` rows.

    ``cut`` is the last (rank, tie) of the source that is taken; null if none is.
    """
    count = rows.count()
    bins = min(MAX_BINS, max(64, -(-count // BIN_ROWS)))
    grades = materialize(rows.groupBy("source", "grade").agg(F.sum("size").alias("words")), "mix-grades")
    total = grades.agg(F.sum("words")).first()[0]
    targets = source_targets(grades.groupBy("source").agg(F.sum("words").alias("source_size")), int(total or 0), max_copies)
    plan = materialize(expected_copies(grades, targets, max_copies), "mix-copies")

    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    ranked = rows.alias("d").join(plan.alias("p"), same & (F.col("d.grade") == F.col("p.grade"))).select("d.*", "p.p", "p.rest").withColumn("rank", _rank()).filter("rank is not null")
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), F.lit(bins - 1)).cast("int"))
    upto = Window.partitionBy("source").orderBy("bin")
    binned = ranked.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    binned = materialize(binned, "mix-bins")
    # the bin of the cut is the first one that the rest does not hold; without one, the last bin is ordered
    place = F.struct("bin", "before")
    cut_bins = binned.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("upto").cast("double") > F.col("rest"), place)), F.max(place)).alias("at"))
    cut_bins = materialize(cut_bins.select("source", "at.bin", "at.before"), "mix-cut-bins")
    at_cut = ranked.alias("d").join(cut_bins.alias("p"), same & (F.col("d.bin") == F.col("p.bin"))).select("d.*", "p.before")
    # rows that agree in everything are one; the order of a bin is that of its rows, some BIN_ROWS of them
    at_cut = at_cut.groupBy("source", "bin", "before", "rest", "rank", "tie").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source", "bin").orderBy("rank", "tie")
    middle = F.col("before") + F.sum("words").over(order) - F.col("words") / 2.0
    inside = at_cut.withColumn("inside", middle <= F.col("rest"))
    exact = inside.filter("inside").groupBy("source").agg(F.max(F.struct("rank", "tie")).alias("cut"))
    # if nothing of the bin is taken, the cut lies before it
    floors = cut_bins.select("source", F.struct((F.col("bin") / (bins - F.col("bin"))).alias("rank"), F.lit("").alias("tie")).alias("cut"))
    cuts = exact.unionByName(floors).groupBy("source").agg(F.max("cut").alias("cut"))
    out = plan.alias("d").join(cuts.alias("p"), same, "left").select("d.source", "d.grade", "d.source_size", "d.target", "d.whole", "d.p", "p.cut")
    return materialize(out, "mix-plan")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.grade") == F.col("p.grade"))
    joined = rows.alias("d").join(plan.alias("p"), same).select("d.*", "p.source_size", "p.target", "p.whole", "p.p", "p.cut")
    sampled = F.coalesce(F.struct(_rank().alias("rank"), "tie") <= F.col("cut"), F.lit(False)) & (F.col("p") > 0)
    return joined.withColumn("copies", F.col("whole") + sampled.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    Size is the number of words by white space; null or empty text has size 0 and takes 0 words. A null source is a
    source of its own. Rows that share id and text share their random number, and are taken alike. An empty table gives
    an empty result.
    """
    require(docs, id_col, text_col, source_col)
    rows = materialize(measured(docs, id_col, text_col, source_col, seed, F.col(id_col).alias("doc_id")), "mix-sizes")
    chosen = _with_copies(rows, mix_plan(rows, max_copies))
    return chosen.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` with ``copies``, for documents that the mix takes at least once. Other rows are as :func:`mix` has them.

    Only numbers are written and shuffled; the documents meet the plan (one row per source and grade) where they are.
    """
    require(docs, id_col, text_col, source_col)
    plan = mix_plan(materialize(measured(docs, id_col, text_col, source_col, seed), "mix-sizes"), max_copies)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("row")
    taken = _with_copies(measured(docs, id_col, text_col, source_col, seed, packed), plan).filter("copies > 0")
    return taken.select("row.*", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL of the mix over a table or a subquery's name."""
    return rf"""
d0 AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD_PATTERN}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}:' || md5(coalesce(text, ''))) AS tie
  FROM {documents}
), d AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS grade,
         (CAST(CAST('0x' || substr(tie, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM d0
), s AS (
  SELECT source, sum(size) AS source_size, 3 * sum(size) AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER before, 0) AS rest_words,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before, 0) AS rest_weight, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS k
  FROM s WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT CAST(rest_words AS DOUBLE) AS rest_words, CAST(rest_weight AS DOUBLE) AS rest_weight FROM o
  WHERE CAST(rest_words AS DOUBLE) * weight / CAST(rest_weight AS DOUBLE) <= CAST(cap AS DOUBLE) ORDER BY k LIMIT 1
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(least(CAST(cap AS DOUBLE), coalesce((SELECT rest_words FROM f) * weight / (SELECT rest_weight FROM f), CAST(cap AS DOUBLE))) AS DOUBLE) AS target FROM s
), gr AS (
  SELECT source, grade, sum(size) AS words FROM d GROUP BY source, grade
), ra AS (
  SELECT gr.source, grade, words, source_size, target,
         (target - CAST(3 * coalesce(sum(words) OVER (PARTITION BY gr.source ORDER BY grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / nullif(CAST(sum(grade * words) OVER (PARTITION BY gr.source ORDER BY grade DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS own_rate
  FROM gr JOIN t ON gr.source IS NOT DISTINCT FROM t.source
), rt AS (
  SELECT *, first_value(CASE WHEN own_rate * grade <= 3 THEN own_rate END) OVER (PARTITION BY source ORDER BY CASE WHEN own_rate * grade <= 3 THEN grade END DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rate FROM ra
), ex AS (
  SELECT *, CASE WHEN grade = 0 THEN 0.0::DOUBLE ELSE least(coalesce(rate * grade, 3.0::DOUBLE), 3.0::DOUBLE) END AS expected FROM rt
), pl AS (
  SELECT source, grade, source_size, target, floor(expected) AS whole, expected - floor(expected) AS p,
         target - sum(CAST(floor(expected) AS BIGINT) * words) OVER (PARTITION BY source) AS rest FROM ex
), od AS (
  SELECT d.doc_id, d.source, d.size, d.tie, pl.source_size, pl.target, pl.whole, pl.p, pl.rest,
         CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank
  FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source AND d.grade = pl.grade
), mi AS (
  SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            - sum(size) OVER (PARTITION BY source, rank, tie) / 2.0::DOUBLE AS middle FROM od
), mixed AS (
  SELECT doc_id, source, size, source_size, target,
         CAST(whole + CASE WHEN rank IS NOT NULL AND middle <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM mi
)"""


ORACLE = f"WITH {oracle()} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
