"""Substring de-duplication by level-wise doubling.

Windows of a short length are tested for repetition first; at each level only places where two adjacent windows are
both repeated are extended to twice the length, until the target length is reached or no candidates survive. (Windows
of twice the target and more lie inside repeated target windows, so they could remove nothing further.)

Documents are dealt once into blocks by a hash of their ids. A block sends, per level, the sorted distinct hashes of its
candidate windows as compressed differences (two to six bytes a window), dealt by hash range; each range answers every
block with what it needs: one bit per hash at the lower levels (does it occur in another block?), and the hashes that
an earlier document of another block has at the target level, for which a block tells its earliest document with each
hash. A block orders its own windows itself. A window that fills the corpus costs one hash per block, never a group of
all its places. Messages are at most as many as hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, null_safe_text, read, require, text_hashes, texts, window_hashes

#: Characters of text in a block, hashes that one answering group holds, and groups in a task, on average.
BLOCK_CHARS = 8 << 20
RANGE_HASHES = 2_000_000
GROUPS_PER_TASK = 1
SECOND_BASE = 0xC2B2AE3D27D4EB4F


def encode(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """A block's documents in order of (key, text), and the hashes of their words laid end to end."""

    def __init__(self, table: pa.Table):
        keys, ids = table.column("key").to_pylist(), table.column("id").to_pylist()
        bodies = [b for chunk in table.column("body").chunks for b in texts(chunk)]
        order = sorted(range(len(ids)), key=lambda i: (keys[i], bodies[i]))
        self.ids, self.bodies = [ids[i] for i in order], [bodies[i] for i in order]
        self.hashes, self.lengths = text_hashes(self.bodies, fold=False)
        self.owner = np.repeat(np.arange(len(order)), self.lengths)
        self.keys = np.array([keys[i] for i in order], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)

    def places(self, width: int, least: int) -> np.ndarray:
        """Where windows of ``width`` words start, in documents of ``least`` words or more."""
        left = self.ends[self.owner] - np.arange(len(self.owner))
        return np.flatnonzero((left >= width) & (self.lengths[self.owner] >= least))

    def windows(self, width: int, places: np.ndarray, base: int | None = None) -> np.ndarray:
        args = (width,) if base is None else (width, base)
        return window_hashes(self.hashes, *args)[places]


def _split(values: np.ndarray, range_bits: int, hash_bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted values by their upper bits."""
    if not len(values):
        return []
    ranges = (values >> np.uint64(hash_bits - range_bits)) if range_bits else np.zeros(len(values), np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(values)]])
    return [(int(ranges[a]), int(a), int(b)) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _table(rows: list[tuple], **columns: pa.DataType) -> pa.Table:
    found = zip(*rows, strict=True) if rows else ((),) * len(columns)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(found, columns.values(), strict=True)], names=list(columns))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, start: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``, and ``kept_text`` if asked for.

    Words are runs of non-space characters. A word goes when it lies in a window of ``window`` words that also starts
    earlier (in a smaller id, or before in the same document); windows are judged on the input. The levels are
    ``start`` (half the window unless given), twice that, and so on up to ``window``. Null text has no words. Ids are
    numbers; documents without one come last, in an order of their own; rows with the same id are documents of their
    own, ordered by text. Windows are compared by 96 bits of hash at the target length.
    """
    require(docs, id_col, text_col)
    levels = [window // 2 if start is None else start]
    while 0 < levels[-1] < window:
        levels.append(levels[-1] * 2)
    if len(levels) < 2 or levels[-1] != window:
        raise ValueError("window must be start doubled once or more")
    chars = int(docs.agg(F.sum(F.length(text_col))).first()[0] or 0)
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    range_bits = max(0, chars // 6 // RANGE_HASHES).bit_length()
    bits = min(64, max(40, (chars // 6).bit_length() + 8))  # one short window in 2^8 survives by chance at most
    by_block, by_range = max(1, -(-n_blocks // GROUPS_PER_TASK)), max(1, -(-(1 << range_bits) // GROUPS_PER_TASK))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), null_safe_text(text_col).cast("binary").alias("body"))
    block = F.pmod(F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("body")), F.lit(n_blocks)).cast("int")
    # what orders documents: the id, and above all ids the block for those without one
    key = F.coalesce("id", F.lit((1 << 63) - 1 - n_blocks) + F.col("block"))
    blocks = rows.withColumn("block", block).withColumn("key", key).select("block", "key", "id", "body").repartition(by_block, "block")

    def alive(held: Block, flags: pa.Table, upto: int) -> np.ndarray:
        """Places at which windows of the level before ``upto`` are candidates for doubling, from the flags of all levels below."""
        keep = None
        answers = {(lv, part): data for lv, part, data in zip(*(flags.column(c).to_pylist() for c in ("level", "part", "data")), strict=True)}
        for lv in range(upto):
            width = levels[lv]
            places = held.places(width, window) if keep is None else np.flatnonzero(keep)
            values, inverse, times = np.unique(held.windows(width, places) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
            repeated = times > 1
            for r, a, b in _split(values, range_bits, bits):
                repeated[a:b] |= np.unpackbits(np.frombuffer(answers[lv, r], dtype=np.uint8), count=b - a).astype(bool)
            hit = np.zeros(len(held.owner) + 2 * width, dtype=bool)
            hit[places[repeated[inverse]]] = True
            keep = np.zeros(len(held.owner), dtype=bool)
            wide = held.places(2 * width, window)
            keep[wide] = hit[wide] & hit[wide + width]
        return held.places(levels[0], window) if keep is None else np.flatnonzero(keep)

    no_flags = _table([], level=pa.int32(), part=pa.int32(), data=pa.binary())

    def offer(docs_table: pa.Table, flags: pa.Table, level: int) -> pa.Table:
        found: list[tuple] = []
        if docs_table.num_rows:
            held = Block(docs_table)
            keys = distinct(held.windows(levels[level], alive(held, flags, level)) >> np.uint64(64 - bits))
            found = [(r, docs_table.column("block")[0].as_py(), encode(keys[a:b])) for r, a, b in _split(keys, range_bits, bits)]
        return _table(found, part=pa.int32(), block=pa.int32(), data=pa.binary())

    def offer_shortest(docs_table: pa.Table) -> pa.Table:
        return offer(docs_table, no_flags, 0)

    def offer_at(level: int):
        def doubled(docs_table: pa.Table, flags: pa.Table) -> pa.Table:
            return offer(docs_table, flags, level)

        return doubled

    def answer(level: int):
        def repeated(table: pa.Table) -> pa.Table:
            part, owners = table.column("part")[0].as_py(), table.column("block").to_pylist()
            lists = [decode(d) for d in table.column("data").to_pylist()]
            keys = np.concatenate(lists)
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            flags = np.zeros(len(keys), dtype=bool)
            flags[order[1:][same]] = True
            flags[order[:-1][same]] = True
            ends = np.cumsum([len(x) for x in lists])
            data = [np.packbits(flags[e - len(x) : e]).tobytes() for x, e in zip(lists, ends, strict=True)]
            return _table([(no, level, part, d) for no, d in zip(owners, data, strict=True)], block=pa.int32(), level=pa.int32(), part=pa.int32(), data=pa.binary())

        return repeated

    def offer_windows(docs_table: pa.Table, flags: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if docs_table.num_rows:
            held = Block(docs_table)
            places = alive(held, flags, len(levels) - 1)
            h = held.windows(window, places)
            g = (held.windows(window, places, SECOND_BASE) >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((g, h))  # stable, and documents lie in order, so the first of equals is the earliest
            h, g, docs_at = h[order], g[order], held.owner[places[order]]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            h, g, keys = h[first], g[first], held.keys[docs_at[first]]
            no, pack = docs_table.column("block")[0].as_py(), zstandard.ZstdCompressor(level=1).compress
            planes = lambda x: pack(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
            found = [(r, no, encode(h[a:b]), g[a:b].tobytes(), planes(np.ascontiguousarray(keys[a:b]))) for r, a, b in _split(h, range_bits, 64)]
        return _table(found, part=pa.int32(), block=pa.int32(), data=pa.binary(), more=pa.binary(), keys=pa.binary())

    def answer_windows(table: pa.Table) -> pa.Table:
        owners = table.column("block").to_pylist()
        lists = [decode(d) for d in table.column("data").to_pylist()]
        keys = np.concatenate(lists)
        more = np.concatenate([np.frombuffer(d, dtype=np.uint32) for d in table.column("more").to_pylist()])
        unpack = zstandard.ZstdDecompressor().decompress
        first = np.concatenate([np.ascontiguousarray(np.frombuffer(unpack(d), dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel() for d in table.column("keys").to_pylist()])
        by = np.lexsort((first, more, keys))
        later = np.zeros(len(keys), dtype=bool)
        later[by[1:]] = (keys[by][1:] == keys[by][:-1]) & (more[by][1:] == more[by][:-1])
        out, end = [], 0
        for no, x in zip(owners, lists, strict=True):
            begin, end = end, end + len(x)
            mine = later[begin:end]
            if mine.any():
                out.append((no, encode(x[mine]), more[begin:end][mine].tobytes()))
        return _table(out, block=pa.int32(), data=pa.binary(), more=pa.binary())

    def finish(docs_table: pa.Table, hits: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs_table.num_rows:
            held = Block(docs_table)
            places = held.places(window, window)
            known = np.concatenate([np.zeros(0, np.uint64), *(decode(d) for d in hits.column("data").to_pylist())])
            known_more = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(d, dtype=np.uint32) for d in hits.column("more").to_pylist())])
            more = (held.windows(window, places, SECOND_BASE) >> np.uint64(32)).astype(np.uint32)
            starts = places[_later(held.windows(window, places), more, known, known_more)]
            edge = np.zeros(len(held.owner) + window + 1, dtype=np.int32)
            edge[starts] += 1
            edge[starts + window] -= 1
            gone = np.cumsum(edge)[: len(held.owner)] > 0
            removed = np.bincount(held.owner[gone], minlength=len(held.ids))
            for doc, body, total, n, end in zip(held.ids, held.bodies, held.lengths.tolist(), removed.tolist(), held.ends.tolist(), strict=True):
                words = body.split()
                if n:
                    words = [words[k] for k in np.flatnonzero(~gone[end - total : end])]
                kept = b" ".join(words)
                out.append((doc, total, n, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
        more_columns = {"kept_text": pa.string()} if with_text else {}
        return _table(out, doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string(), **more_columns)

    flags = None
    for level in range(len(levels) - 1):
        if flags is None:
            halves = blocks.groupBy("block").applyInArrow(offer_shortest, "part int, block int, data binary")
        else:
            halves = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(offer_at(level), "part int, block int, data binary")
        told = halves.repartition(by_range, "part").groupBy("part").applyInArrow(answer(level), "block int, level int, part int, data binary").repartition(by_block, "block")
        flags = told if flags is None else flags.unionByName(told).repartition(by_block, "block")
    candidates = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(offer_windows, "part int, block int, data binary, more binary, keys binary")
    hits = candidates.repartition(by_range, "part").groupBy("part").applyInArrow(answer_windows, "block int, data binary, more binary").repartition(by_block, "block")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(finish, schema)


def _later(keys: np.ndarray, more: np.ndarray, known: np.ndarray, known_more: np.ndarray) -> np.ndarray:
    """Whether an equal (key, more) stands at an earlier place or is known."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    involved = np.zeros(len(keys), dtype=bool)
    involved[1:] |= same
    involved[:-1] |= same
    if len(known):
        sorted_known = np.sort(known)
        edge = np.zeros(len(keys) + 1, dtype=np.int32)
        np.add.at(edge, np.searchsorted(ranked, sorted_known, side="left"), 1)
        np.add.at(edge, np.searchsorted(ranked, sorted_known, side="right"), -1)
        involved |= np.cumsum(edge)[:-1] > 0
    some = np.sort(order[involved])
    # known pairs go before the places
    all_keys, all_more = np.concatenate([known, keys[some]]), np.concatenate([known_more, more[some]])
    by = np.lexsort((all_more, all_keys))
    hit = np.zeros(len(all_keys), dtype=bool)
    hit[by[1:]] = (all_keys[by][1:] == all_keys[by][:-1]) & (all_more[by][1:] == all_more[by][:-1])
    out = np.zeros(len(keys), dtype=bool)
    out[some] = hit[len(known) :]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), start=5)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), l AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM l
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), k AS (
  SELECT p.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN w[p.p] END, ' ' ORDER BY p.p) AS kept
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
