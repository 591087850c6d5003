"""Phrases in texts: one pass of an Aho-Corasick automaton over words or lemmas, whatever the phrases' widths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.scalars import fold
from ..runtime import spread, written

#: Words of phrases that one automaton holds, about; more phrases are dealt into more automata, one after the other.
BLOCK = 150_000
#: Places that a task gathers before it hands them on, about.
HITS = 50_000
_SIGN = "\n"  # between words; no word of letters and digits holds it


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lemmatized(df: DataFrame, lemmas: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, w`` with each word of ``w`` replaced by its own lemma: the smallest of ``form, lemma``, else the word itself.

    Words meet the table in a left join, so that it may be of any size. Rows of ``ids`` must be distinct.
    """
    own = lemmas.select(fold(F.col("form")).alias("word"), fold(F.col("lemma")).alias("lemma")).filter("word <> '' and lemma <> ''").groupBy("word").agg(F.min("lemma").alias("lemma"))
    each = df.select(*ids, F.posexplode("w").alias("pos", "word")).join(own, "word", "left")
    rows = each.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "word").alias("word")))).alias("all"))
    return rows.select(*ids, F.col("all.word").alias("w"))


def _find(runs: list[str]):
    """A function over batches of ``text_id, body`` that gives each place of the runs (bodies and runs have signs around all words)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not runs:  # a block may be empty
            return
        automaton = ahocorasick.Automaton()
        for run in runs:
            automaton.add_word(run, (run, run.count(_SIGN) - 1))
        automaton.make_automaton()

        def made(ids: pa.Array, rows: list[int], starts: list[int], widths: list[int], found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(widths, pa.int32()), pa.array(found, pa.string())], names=["text_id", "start", "width", "run"])

        for batch in batches:
            ids = batch.column(0)
            rows, starts, widths, found = [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                signs = at = 0
                for end, (run, width) in automaton.iter(body):
                    signs, at = signs + body.count(_SIGN, at, end), end
                    rows.append(row)
                    starts.append(signs - width)
                    widths.append(width)
                    found.append(run)
                if len(rows) >= HITS:
                    yield made(ids, rows, starts, widths, found)
                    rows, starts, widths, found = [], [], [], []
            if rows:
                yield made(ids, rows, starts, widths, found)

    return over


def phrase_matches(texts: DataFrame, phrases: DataFrame, least: int = 2, most: int | None = None, lemmas: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``text_id, start, width, uid``: where a phrase's words (``uid, phrase``) stand in a text (``text_id, text``).

    With ``lemmas`` (``form, lemma``) both sides are compared by their own lemmas. Distinct phrases of ``least`` to
    ``most`` words become automata of some ``block`` words; each finds all places, overlapping ones too, in one pass, and
    the places then meet the uids. Null and empty texts and phrases match nothing; rows of one ``text_id`` are one text's repeats.
    """
    known = phrases.select("uid", words_of(F.col("phrase")).alias("w")).filter(F.size("w") > 0).distinct()
    said = texts.select("text_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    if lemmas is not None:
        known, said = lemmatized(known.withColumn("said", F.col("w")), lemmas, ["uid", "said"]), lemmatized(said.dropDuplicates(["text_id"]), lemmas, ["text_id"])
    fits = F.size("w") >= least if most is None else F.size("w").between(least, most)
    closed = F.concat(F.lit(_SIGN), F.array_join("w", _SIGN), F.lit(_SIGN))
    known = written(known.filter(fits).select("uid", closed.alias("run"), F.size("w").alias("n")).distinct())
    runs = known.groupBy("run").agg(F.first("n").alias("n"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block))
    bodies = spread(said.select("text_id", closed.alias("body")), "text_id")
    if blocks > 1:
        bodies = written(bodies)
    schema = StructType([bodies.schema["text_id"], StructField("start", IntegerType()), StructField("width", IntegerType()), StructField("run", StringType())])
    found = None
    for no in range(blocks):
        some = [r.run for r in runs.filter(F.pmod(F.xxhash64("run"), F.lit(blocks)) == no).select("run").collect()]
        hits = bodies.mapInArrow(_find(some), schema)
        found = hits if found is None else found.unionByName(hits)
    return found.join(known.select("uid", "run"), "run").select("text_id", "start", "width", "uid")
