"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of ``n`` consecutive words of the test items (an item with fewer words is one window).
The alphabet is words: for each pattern length the blocks of two words give a shift table that skips positions where
no pattern can end, a block that may end a pattern leads to a bucket of patterns with that suffix, and the candidate
is confirmed by comparing all its words.

The patterns are sent to every task, in blocks of :data:`BLOCK_WORDS` words at most, so a larger test set makes more
blocks and never a larger broadcast. With one block the search is a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, append_columns, fold_words, materialize, null_safe_text, read, require, texts

#: Words of test items in one block of patterns; some 60 MB of tables.
BLOCK_WORDS = 150_000
RESULTS = {"n_words", "n_hit", "hit_spans", "items", "contaminated"}


class WuManber:
    """Shift and suffix tables for each pattern length; patterns are tuples of words."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], n: int):
        self.items: list[str | None] = []
        windows: dict[tuple[bytes, ...], set[int]] = {}
        for item, words in items:
            if words:
                self.items.append(item)
                width = min(n, len(words))
                for i in range(len(words) - width + 1):
                    windows.setdefault(tuple(words[i : i + width]), set()).add(len(self.items) - 1)
        self.tables: list[tuple[int, int, dict, dict]] = []
        for width in sorted({len(w) for w in windows}):
            block = min(2, width)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], tuple[int, ...]]]] = {}
            for window, owners in windows.items():
                if len(window) != width:
                    continue
                for end in range(block, width + 1):
                    key = window[end - block : end]
                    shift[key] = min(shift.get(key, width), width - end)
                buckets.setdefault(window[width - block :], []).append((list(window), tuple(sorted(owners))))
            self.tables.append((width, block, shift, buckets))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [start, end) of words inside occurrences, and the numbers of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        n = len(words)
        for width, block, shift, buckets in self.tables:
            skip, end, get = width - block + 1, width, shift.get
            while end <= n:
                key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
                step = get(key, skip)
                if step:
                    end += step
                    continue
                for window, owners in buckets[key]:
                    if words[end - width : end] == window:
                        spans.append((end - width, end))
                        found.update(owners)
                end += 1
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[WuManber]:
    """Pattern tables of the whole test set, block by block; each block is fetched alone."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), null_safe_text(text_col).alias("body"))
    total = rows.agg(F.sum(F.floor(F.length("body") / 2) + 1)).first()[0] or 0  # no fewer than there are words
    count = max(1, -(-int(total) // BLOCK_WORDS))
    for b in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == b)
        yield WuManber(((r.item, fold_words(r.body.encode())) for r in part.toLocalIterator()), n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_hit, hit_spans, items, contaminated``.

    ``hit_spans`` are the merged runs of words inside any occurrence, ``items`` the test items (as strings, sorted)
    of which a window occurs. Null text has no words; items without words match nothing; the words of items without an
    id are hit, but there is no name to list; equal items each count. An empty test set marks nothing.
    """
    require(docs, text_col)
    require(benchmark, item_col, item_text)
    spark = docs.sparkSession
    blocks = pattern_blocks(benchmark, item_col, item_text, n)
    schema = "n_words long, n_hit long, hit_spans array<struct<start:int,end:int>>, items array<string>, contaminated boolean"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for no, block in enumerate(blocks):
        tables = spark.sparkContext.broadcast(block)

        def scan(batch: pa.RecordBatch, tables=tables, more=no > 0) -> dict[str, pa.Array]:
            matcher: WuManber = tables.value
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            earlier = zip(column("hit_spans").to_pylist(), column("items").to_pylist(), strict=True) if more else None
            n_words, n_hit, spans, items = [], [], [], []
            for body in texts(column(text_col)):
                words = fold_words(body)
                own, found = matcher.search(words)
                names = {matcher.items[i] for i in found} - {None}
                if earlier is not None:
                    old_spans, old_items = next(earlier)
                    own = merged(own + [(s["start"], s["end"]) for s in old_spans])
                    names.update(old_items)
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in own))
                spans.append([{"start": s, "end": e} for s, e in own])
                items.append(sorted(names))
            return {
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "hit_spans": pa.array(spans, span_type),
                "items": pa.array(items, pa.list_(pa.string())),
                "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_()),
            }

        docs = append_columns(materialize(docs, "decontaminate") if no else docs, text_col, scan, schema)
    return docs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs, with their columns."""
    if not RESULTS & set(docs.columns):
        return decontaminate(docs, benchmark, n, text_col).filter(~F.col("contaminated")).select(*docs.columns)
    marked = decontaminate(docs.select(F.struct(*docs.columns).alias("_row"), text_col), benchmark, n, text_col)
    return marked.filter(~F.col("contaminated")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}')"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), widths AS (SELECT DISTINCT width FROM bw), dw AS (
  SELECT rid, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)
), m AS (
  SELECT rid, i, dw.width AS width, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.width = bw.width
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM m) GROUP BY rid
), it AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
