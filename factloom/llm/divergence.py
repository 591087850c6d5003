"""Source divergence audit: how the terms of each source of a language differ from its other sources and the language.

One pass over the texts counts terms by language and source. A language keeps the terms of enough documents; each kept
term is a row of its sources' counts. A group's share of a term is smoothed, so where both sources of a pair lack a term
the pair's value is a constant of the two, where one lacks it, it depends on the other's count only, and just the terms
that both hold need a correction of the pair.

These corrections come from frequent-pattern trees: a row's nonzero counts in order of sources are a path, equal rows
are one path with a multiplicity, and paths with a common beginning share its nodes. Paths are dealt by range and sorted,
so a task walks its tree in order and keeps one path of open nodes; a node that is left is complete, and gives one
correction per ancestor, times its multiplicity. (A beginning that two tasks share is a node in each, which adds up the
same.)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, read, require, texts

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Counted terms that a task holds, and corrections that it makes at once.
HELD_TERMS = 400_000
HELD_NODES = 500_000
#: Paths of a task, on average.
PATHS = 20_000

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, summed within tasks; the term '' names a group that occurs."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(text_col).cast("binary").alias("body"))
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in held.items():
                names = ["", *n]
                columns = [[lang] * len(names), [source] * len(names), names, [0, *n.values()], [0, *(documents[t] for t in n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
            held.clear()

        size = 0
        for whole in batches:
            for batch in pieces(whole, "body"):
                for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                    n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                    terms = body.translate(_LETTERS).decode("utf-8", "replace").split(" ")
                    own = Counter(terms)
                    own.pop("", None)
                    before = len(n)
                    n.update(own)
                    documents.update(own.keys())
                    size += len(n) - before
                    if size > HELD_TERMS:
                        yield from flush()
                        size = 0
        yield from flush()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))``, exact."""
    wide = lambda c, kind: c.cast(kind)
    whole = F.call_function("div", wide(F.lit(SCALE), "decimal(10,0)") * wide(count + 1, "decimal(20,0)"), wide(total + terms, "decimal(20,0)"))
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``, exact."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Paths:
    """A frequent-pattern tree walked in order of its paths; nodes are (source, count) with their multiplicities."""

    def __init__(self):
        self.lang: str | None = None
        self.keys: list[tuple[str, int]] = []  # the open nodes, from the root, and their multiplicities so far
        self.times: list[int] = []
        self.entries: list[tuple[int, int, int]] = []  # source number, p, p0 of each open node
        self.numbers: dict[str, int] = {}
        self.paths: list[tuple[int, int, int]] = []  # entries of paths that were left, end to end
        self.left: list[tuple[int, int, int]] = []  # start of its path there, depth and multiplicity of each node that was left
        self.n_above = 0
        self.sums: dict[tuple[str, str, str], int] = {}

    def _leave(self, depth: int) -> None:
        if len(self.keys) <= depth:
            return
        start = len(self.paths)
        self.paths += self.entries
        for d in range(len(self.keys) - 1, max(depth, 1) - 1, -1):
            self.times[d - 1] += self.times[d]
            self.left.append((start, d, self.times[d]))
            self.n_above += d
        del self.keys[depth:], self.times[depth:], self.entries[depth:]
        if self.n_above > HELD_NODES:
            self._settle()

    def add(self, lang: str, keys: list[tuple[str, int]], shares: list[tuple[int, int]], times: int) -> None:
        """``keys``: (source, count) in order of sources, ``shares``: their p and p0; paths come sorted."""
        if lang != self.lang:
            self.close()
            self.lang, self.numbers = lang, {}
        depth, most = 0, min(len(self.keys), len(keys))
        while depth < most and self.keys[depth] == keys[depth]:
            depth += 1
        self._leave(depth)
        self.keys += keys[depth:]
        self.times += [0] * (len(keys) - depth)
        self.times[-1] += times
        for (source, _), (p, p0) in zip(keys[depth:], shares[depth:], strict=True):
            self.entries.append((self.numbers.setdefault(source, len(self.numbers)), p, p0))

    def close(self) -> None:
        self._leave(0)
        self._settle()

    def _settle(self) -> None:
        """Corrections of the nodes that were left, once per node and ancestor, added up by pair of sources."""
        if self.left:
            source, p, p0 = np.array(self.paths, dtype=np.int64).T
            start, depth, times = np.array(self.left, dtype=np.int64).T
            node = np.repeat(start + depth, depth)
            above = np.arange(len(node)) - np.repeat(np.cumsum(depth) - depth, depth) + np.repeat(start, depth)
            code = source[above] * len(self.numbers) + source[node]
            order = np.argsort(code, kind="stable")
            node, above, code, times = node[order], above[order], code[order], np.repeat(times, depth)[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            names, x, x0, y, y0 = list(self.numbers), p[node], p0[node], p[above], p0[above]
            for (a, a0, b, b0), turned in (((y, y0, x, x0), False), ((x, x0, y, y0), True)):
                value = _gap(a, b) - _gap(a, b0) - _gap(a0, b) + _gap(a0, b0)
                # sums must be exact: where 64 bits might not hold them, Python's numbers do
                fits = float(np.abs(value).max()) * float(times.max()) * len(value) < 2.0**62
                total = np.add.reduceat(value * times if fits else value.astype(object) * times.astype(object), starts)
                for pair, more in zip(code[starts].tolist(), total.tolist(), strict=True):
                    one, other = divmod(pair, len(names))
                    key = (self.lang, names[other], names[one]) if turned else (self.lang, names[one], names[other])
                    self.sums[key] = self.sums.get(key, 0) + more
        self.paths, self.left, self.n_above = [], [], 0


def pair_corrections(paths: DataFrame) -> DataFrame:
    """``lang, source, item, value`` summed within tasks, from ``lang, path, times`` rows dealt by range and sorted."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Paths()

        def told() -> pa.RecordBatch:
            rows = [(*key, Decimal(value)) for key, value in tree.sums.items()]
            tree.sums = {}
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fields = [flat.field(k).to_pylist() for k in range(4)]
            keys, shares = list(zip(*fields[:2], strict=True)), list(zip(*fields[2:], strict=True))
            for k, (lang, times) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                tree.add(lang, keys[ends[k] : ends[k + 1]], shares[ends[k] : ends[k + 1]], times)
            if len(tree.sums) > HELD_TERMS:
                yield told()
        tree.close()
        yield told()

    return paths.mapInArrow(walk, "lang string, source string, item string, value decimal(38,0)")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group of language and source its divergence from each other source
    of the language (part ``pair``) and its ``top_terms`` terms above the language (part ``term``).

    Terms are runs of ASCII letters (A-Z lower-cased) and characters outside ASCII. Null text, language and source count
    as ''. Each row is a document, also where ids repeat. Groups without terms are there with the pairs that they form.
    An empty table gives an empty result. A path has one entry per source of the language, and the result one row per
    pair of sources, so both grow with the number of sources alone.
    """
    require(docs, text_col, lang_col, source_col)
    # dealt by term once: a term has one row per task and source, and then one per source, which bounds its list
    counted = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    sums = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # rare terms, which are most, go before lists are made; both sides lie by term already, and read one shuffle
    kept = sums.groupBy("lang", "term").agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("all_n")).filter((F.col("all_docs") >= least_docs) | (F.col("term") == ""))
    found = sums.join(kept.hint("shuffle_hash"), ["lang", "term"])
    path = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("path")
    listed = materialize(found.groupBy("lang", "term").agg(path, F.first("all_n").alias("n"), F.sum("docs").alias("docs")), "audit-rows")
    occurring = listed.filter("term = ''").select("lang", F.explode("path.source").alias("source"))
    rows = listed.filter("term <> ''").drop("docs")

    langs = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = rows.select("lang", F.inline("path")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = occurring.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    stats = stats.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    stats = materialize(stats, "audit-groups")

    # pairs: what holds without common terms, from each source's distribution of counts
    levels = rows.select("lang", F.inline("path")).groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    levels = levels.join(stats, ["lang", "source"]).select("lang", "source", "n", "times", "total", "terms", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0")
    # a source's distribution, which others meet: one row per source
    spread = levels.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("levels"))
    one = stats.select("lang", "source", "p0", "terms").join(spread, ["lang", "source"], "left")
    other = one.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("levels").alias("q_levels"))
    met = one.join(other, "lang").filter("source <> item")
    big = lambda c: c.cast("decimal(38,0)")
    none = big(F.lit(0))
    times = lambda value, n: big(big(value) * big(n))
    added = lambda levels, value: F.when(F.col(levels).isNull(), none).otherwise(F.aggregate(levels, none, lambda s, x: big(s + times(value(x["p"]), x["times"]))))
    base = gap(F.col("p0"), F.col("q0"))
    single = added("levels", lambda p: gap(p, F.col("q0")) - base) + added("q_levels", lambda q: gap(F.col("p0"), q) - base)
    value = F.when(F.col("terms") > 0, times(base, F.col("terms")) + single).otherwise(none)
    apart = met.select("lang", "source", "item", big(value).alias("value"))

    # and what common terms correct: equal rows are one path
    shared = rows.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times"))
    shared = materialize(shared, "audit-paths")
    # a path meets the sources of its language, which are as many as its entries may be
    known = F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "terms", "p0"))))
    by_lang = stats.groupBy("lang").agg(known.alias("known"))
    full = shared.join(by_lang, "lang").select(
        "lang",
        F.transform("path", lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), share(x["n"], F.col("known")[x["source"]]["total"], F.col("known")[x["source"]]["terms"]).alias("p"), F.col("known")[x["source"]]["p0"].alias("p0"))).alias("path"),
        "times",
    )
    n_paths = shared.count()
    dealt = full.repartitionByRange(max(1, -(-n_paths // PATHS)), "lang", "path").sortWithinPartitions("lang", "path")
    pairs = apart.unionByName(pair_corrections(dealt)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.withColumn("part", F.lit("pair"))

    # terms of a group that lie above the language
    above = rows.select("lang", "term", F.col("n").alias("lang_n"), F.inline("path")).join(stats, ["lang", "source"])
    above = above.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    above = above.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*names).unionByName(terms.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (SELECT DISTINCT lang, source FROM d), o AS (
  SELECT rid, lang, source, unnest(w) AS term FROM d
), v AS (
  SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), c AS (
  SELECT o.lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY o.lang, source, term
), t AS (
  SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM v GROUP BY lang
), gt AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gt.total + t.terms) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (v.lang_n + 1)) // (t.lang_total + t.terms) AS BIGINT) AS q
  FROM g JOIN v USING (lang) JOIN t USING (lang) JOIN gt ON g.lang = gt.lang AND g.source = gt.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), allpairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), above AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM above)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
