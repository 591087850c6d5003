"""Line de-duplication by range-partitioned hashes; DataFrame functions only.

Lines travel as hashes with document and position, never as text. They are range-partitioned by hash and sorted by
(hash, document, position), so a partition streams each key's first occurrence ahead of the others; places behind the
first document's come out. What goes back to a document is a sparse bitmap of its lines (words of 64 bits, empty words
left out), and the text meets it once, by id.

A key with many lines would be one long run in one task. Such keys (more than a :data:`HOT_KEYS`-th of all lines, so at
most that many) are found by counts of hash buckets, their first documents come from a combined minimum, and their
lines are judged where they lie against that bounded, broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, null_safe_text, read, require

MIN_CHARS = 10
BLANKS = " \t\n\x0b\f\r"
#: Lines of a range partition, on average.
RANGE_LINES = 400_000
#: Bound on the keys that are broadcast, least lines of such a key, and buckets that find them.
HOT_KEYS = 100_000
HOT_LEAST = 1_000
HOT_BUCKETS = 1 << 20
#: Sorts rows without an id behind all others.
LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, body, place, row``: the order of documents, and a hash that tells rows with one id apart by their text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), null_safe_text(text_col).alias("body"))
    return rows.withColumn("place", F.coalesce("id", F.lit(LAST))).withColumn("row", F.xxhash64("place", "body"))


def line_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """``place, row, pos, h1, h2`` of every line whose key has ``min_chars`` code points or more."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lines = rows.select("place", "row", F.posexplode(_lines(F.col("body"))).alias("pos", "line"))
    bare = F.btrim("line", F.lit(BLANKS))
    # on ASCII alone lower() is the same and many times faster
    key = F.when(F.octet_length("bare") == F.length("bare"), F.lower("bare")).otherwise(F.translate("bare", capitals, small))
    lines = lines.withColumn("bare", bare).filter(F.length("bare") >= min_chars).withColumn("key", key)
    return lines.select("place", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(lines: DataFrame, total: int) -> DataFrame:
    """``h1, h2, first`` of the keys with more than ``total / HOT_KEYS`` lines; at most :data:`HOT_KEYS` rows."""
    least = max(HOT_LEAST, total // HOT_KEYS)
    bucket = F.pmod("h1", F.lit(HOT_BUCKETS)).cast("int")
    full = lines.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > least).select("bucket")
    within = lines.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")
    return within.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter(F.col("n") > least).drop("n")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """``place, row, pos`` of the lines whose key a smaller document holds, from a written table of :func:`line_keys`."""
    total = lines.count()
    hot = materialize(hot_keys(lines, total), "lines-hot")
    here = lines.join(F.broadcast(hot), ["h1", "h2"]).filter("place > first")
    cold = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    ranged = cold.repartitionByRange(max(1, -(-total // RANGE_LINES)), "h1", "h2")
    run = Window.partitionBy("h1", "h2").orderBy("place", "pos")
    streamed = ranged.withColumn("first", F.first("place").over(run.rowsBetween(Window.unboundedPreceding, 0))).filter("place > first")
    return here.select("place", "row", "pos").unionByName(streamed.select("place", "row", "pos"))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``place, row, words``: per document with dropped lines, the bits of those lines as ``(word, bits)`` in order; other words are empty."""
    lines = materialize(line_keys(_documents(docs, id_col, text_col), min_chars), "lines")
    gone = dropped_lines(lines).repartition("place", "row")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")
    words = gone.groupBy("place", "row", F.expr("cast(pos div 64 as int)").alias("word")).agg(bits)
    return words.groupBy("place", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def positions(words: Column) -> Column:
    """The set bits of a bitmap as line numbers."""
    set_bits = lambda w: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", w["bits"], k).bitwiseAND(F.lit(1)) == 1)
    return F.flatten(F.transform(words, lambda w: F.transform(set_bits(w), lambda k: w["word"] * 64 + k)))


def kept_lines(body: Column, words: Column) -> Column:
    """The text without the lines of the bitmap; linear in the number of lines."""
    lines = _lines(body)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions(words))
    return F.when(words.isNull(), body).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, dropped`` (bitmap, null if nothing goes) ``, kept_text``.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of ``min_chars`` code points or more
    that two documents hold stay in the smallest only, there with all their lines. Null and empty text is one empty
    line. Ids are numbers; rows that share an id are one document (none of them loses a line to another), rows without
    an id are together the last document. An empty table gives an empty result. Keys are compared by 128 bits of hash.
    """
    require(docs, id_col, text_col)
    maps = drop_bitmaps(docs, id_col, text_col, min_chars)
    joined = _documents(docs, id_col, text_col).join(maps, ["place", "row"], "left")
    n_dropped = F.coalesce(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0).cast("long"))
    n_lines = F.length("body") - F.length(F.translate("body", "\n", "")) + 1
    return joined.select(
        F.col("id").alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        n_dropped.alias("n_dropped"),
        F.col("words").alias("dropped"),
        kept_lines(F.col("body"), F.col("words")).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS place, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT rid, place, pos, l[pos] AS line, translate(trim(l[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, place, l, unnest(range(1, len(l) + 1)) AS pos FROM d)
), f AS (
  SELECT key, min(place) AS first FROM e WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT rid, pos, line, coalesce(e.place > f.first, false) AS gone FROM e LEFT JOIN f ON e.key = f.key
), k AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN k USING (rid)
"""
