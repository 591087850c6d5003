"""Exact de-duplication by Patricia-trie owners.

Texts are equal when their bytes are equal after each run of white space became one space. Full byte strings go into
compressed radix tries whose terminal nodes hold the smallest id; hashes only decide which task a string meets its
likes in, never whether two strings are equal.

Plan: (1) every input partition inserts its texts into a trie of its own, so that a text which fills a third of the
corpus leaves each partition once (the rows that hold the string, one per distinct text and partition, plus narrow
member rows); (2) the strings are dealt by (length, content hash) and inserted into tries that spill by subtree;
(3) member rows join the owners on the key of their partition's terminal node, which no other partition shares.

To drop duplicates, whole rows take the place of the strings: the tries of step 1 pass on one row of each text, the
tries of step 2 keep one of those, so a row is shuffled once at most and nothing is written or joined.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, null_safe_text, pieces, read, require, texts

LOCAL_SCHEMA = "id long, pid int, node long, seq long, sha string, n_bytes long, hash long, n_rows long, body binary"
OWNER_SCHEMA = "pid int, node long, keep_id long, win_pid int, win_node long, win_seq long, group_size long"
#: Bytes of text (with a charge per node) that one trie holds before it is flushed or spilled.
TRIE_BYTES = 48 << 20
NODE_BYTES = 250
NO_ID = 1 << 63


class Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value = label, None, None


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by bisection over C comparisons."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``insert`` returns the terminal node of a string."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes) -> Node:
        node, at = self.root, 0
        while at < len(key):
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += len(kid.label) + NODE_BYTES
                return kid
            if not key.startswith(kid.label, at):
                n = shared_length(kid.label, key, at)
                middle = Node(kid.label[:n])
                kid.label = kid.label[n:]
                middle.kids = {kid.label[0]: kid}
                node.kids[key[at]] = kid = middle
                self.held += NODE_BYTES
            node, at = kid, at + len(kid.label)
        return node

    def walk(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Any]]:
        """(string, value) of every terminal node below ``node``."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            stack.extend((k, prefix) for k in (node.kids or {}).values())


class SpillingTrie:
    """Groups (string, value) pairs by string within a memory budget: the largest subtree goes to disk when it is reached.

    With ``least`` a terminal node stores the smallest value only. Spilled subtrees lie in files of the task's own, which
    a retried task writes anew.
    """

    def __init__(self, budget: int = TRIE_BYTES, least: bool = False):
        self.budget, self.least, self.trie, self.sizes, self.files = budget, least, PatriciaTrie(), {}, {}

    def add(self, key: bytes, value: Any, size: int = 100) -> None:
        """Add a value that takes about ``size`` bytes."""
        first = key[:1]
        if first in self.files:
            pickle.dump((key, [value]), self.files[first])
            return
        before = self.trie.held
        node = self.trie.insert(key)
        if self.least and node.value:
            node.value[0] = min(node.value[0], value)
            return
        if node.value is None:
            node.value = []
        node.value.append(value)
        self.sizes[first] = self.sizes.get(first, 0) + self.trie.held - before + size
        while sum(self.sizes.values()) > self.budget:
            self._spill(max(self.sizes, key=self.sizes.get))

    def _spill(self, first: bytes) -> None:
        self.files[first] = out = tempfile.TemporaryFile()
        if first:
            top = self.trie.root.kids.pop(first[0])
            found = self.trie.walk(top)
        else:
            found = [(b"", self.trie.root.value)]
        for key, values in found:
            pickle.dump((key, values), out)
        if not first:
            self.trie.root.value = None
        self.trie.held -= min(self.trie.held, self.sizes.pop(first))

    def groups(self) -> Iterator[tuple[bytes, list[Any]]]:
        yield from self.trie.walk()
        self.trie, self.sizes = PatriciaTrie(), {}
        while self.files:
            _, file = self.files.popitem()
            yield from _regroup(file, self.budget)


def _entries(file) -> Iterator[tuple[bytes, list[Any]]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _regroup(file, budget: int) -> Iterator[tuple[bytes, list[Any]]]:
    """Groups of a spilled subtree; one that is still too large is split at the byte after its common prefix."""
    prefix, total = None, 0
    for key, _ in _entries(file):
        prefix = key if prefix is None else os.path.commonprefix([prefix, key[: len(prefix)]])
        total += len(key) + NODE_BYTES
    if prefix is None:
        file.close()
        return
    if total <= budget:
        trie = PatriciaTrie()
        for key, values in _entries(file):
            node = trie.insert(key)
            node.value = (node.value or []) + values
        file.close()
        yield from trie.walk()
        return
    ended: list[Any] = []
    parts: dict[int, Any] = {}
    for key, values in _entries(file):
        if len(key) == len(prefix):
            ended += values
        else:
            part = parts.get(key[len(prefix)])
            if part is None:
                part = parts[key[len(prefix)]] = tempfile.TemporaryFile()
            pickle.dump((key, values), part)
    file.close()
    if ended:
        yield prefix, ended
    while parts:
        yield from _regroup(parts.popitem()[1], budget)


def _local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a partition's terminal nodes and, once per distinct text, the text with its smallest id."""
    names = ["id", "pid", "node", "seq", "sha", "n_bytes", "hash", "n_rows", "body"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    pid = TaskContext.get().partitionId()
    trie, n_nodes, seq = PatriciaTrie(), 0, 0

    def batch_of(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def owners() -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for body, (no, owner, owner_seq, count) in trie.walk():
            digest = xxhash.xxh3_64_intdigest(body)
            rows.append((None if owner == NO_ID else owner, pid, no, owner_seq, None, len(body), digest - (1 << 64) if digest >> 63 else digest, count, body))
            held += len(body)
            if held > 8 << 20:
                yield batch_of(zip(*rows, strict=True))
                rows, held = [], 0
        if rows:
            yield batch_of(zip(*rows, strict=True))

    for whole in batches:
        for batch in pieces(whole, "body", 8 << 20):
            ids = batch.column(0).to_pylist()
            bodies = texts(batch.column(1))
            found, shas = [], []
            for doc, body in zip(ids, bodies, strict=True):
                node = trie.insert(body)
                key = NO_ID if doc is None else doc
                if node.value is None:
                    node.value = [n_nodes, key, seq, 0]
                    n_nodes += 1
                elif key < node.value[1]:
                    node.value[1:3] = key, seq
                node.value[3] += 1
                found.append((node.value[0], seq))
                shas.append(hashlib.sha256(body).hexdigest())
                seq += 1
            none = [None] * len(ids)
            yield batch_of([ids, [pid] * len(ids), [n for n, _ in found], [s for _, s in found], shas, none, none, none, none])
            if trie.held > TRIE_BYTES:
                yield from owners()
                trie = PatriciaTrie()
    yield from owners()


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every partition's terminal node: the smallest id over all partitions, its row, and the rows in all."""
    names = ["pid", "node", "keep_id", "win_pid", "win_node", "win_seq", "group_size"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    trie = SpillingTrie()
    for batch in batches:
        columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("id", "pid", "node", "seq", "n_rows")}
        for body, doc, pid, node, seq, count in zip(texts(batch.column(batch.schema.get_field_index("body"))), *columns.values(), strict=True):
            trie.add(body, (NO_ID if doc is None else doc, pid, node, seq, count))
    rows = []
    for _, values in trie.groups():
        keep, win_pid, win_node, win_seq, _ = min(values)
        size = sum(v[4] for v in values)
        rows.extend((pid, node, None if keep == NO_ID else keep, win_pid, win_node, win_seq, size) for _, pid, node, _, _ in values)
        if len(rows) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty text. The row with the smallest id stays; rows without an id come last, and of rows
    with the same id and text exactly one stays. An empty table gives an empty result. Other columns are not read.
    """
    require(docs, id_col, text_col)
    body = F.regexp_replace(null_safe_text(text_col), r"[\x20\x09-\x0D]+", " ")
    local = materialize(docs.select(F.col(id_col).cast("long").alias("id"), body.cast("binary").alias("body")).mapInArrow(_local_tries, LOCAL_SCHEMA), "exact-local")
    strings = local.filter(F.col("body").isNotNull())
    owners = strings.repartition("n_bytes", "hash").mapInArrow(_owners, OWNER_SCHEMA)
    members = local.filter(F.col("body").isNull()).select("id", "pid", "node", "seq", "sha")
    return members.join(owners, ["pid", "node"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("pid") == F.col("win_pid")) & (F.col("node") == F.col("win_node")) & (F.col("seq") == F.col("win_seq"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def normalized(text: bytes) -> bytes:
    """The text with each run of white space replaced by one space."""
    inner = b" ".join(text.split())
    if not inner:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + inner + (b" " if text[-1:].isspace() else b"")


class _Keeper:
    """A row in order of id (none last) and text; rows that agree in both are as good as one another."""

    __slots__ = ("order", "row")

    def __init__(self, order: tuple, row: Any):
        self.order, self.row = order, row

    def __lt__(self, other: _Keeper) -> bool:
        return self.order < other.order

    def __getstate__(self):
        return self.order, self.row

    def __setstate__(self, state):
        self.order, self.row = state


def _order(doc: Any, text: bytes) -> tuple:
    return (True, text) if doc is None else (False, doc, text)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the smallest id.

    Ids of any ordered type will do. Null text counts as empty text; rows without an id come last; of rows that agree in
    id and text one stays. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def fields(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[Any], list[bytes]]]:
        rows = batch.column(batch.schema.get_field_index("row"))
        for piece in pieces(pa.RecordBatch.from_arrays([rows, rows.field(at_text)], names=["row", "text"]), "text", 8 << 20):
            rows = piece.column(0)
            yield rows, rows.field(at_id).to_pylist(), texts(piece.column(1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = PatriciaTrie(), [], 0

        def keepers() -> Iterator[pa.RecordBatch]:
            chosen: list[list[tuple[int, int, int]]] = [[] for _ in held]
            for body, (_, no, place) in trie.walk():
                digest = xxhash.xxh3_64_intdigest(body)
                chosen[no].append((place, len(body), digest - (1 << 64) if digest >> 63 else digest))
            for rows, kept in zip(held, chosen, strict=True):
                if kept:
                    places, sizes, hashes = zip(*sorted(kept), strict=True)
                    taken = rows.take(pa.array(places, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()), taken], names=["n_bytes", "hash", "row"])

        for batch in batches:
            for rows, ids, bodies in fields(batch):
                for place, (doc, text) in enumerate(zip(ids, bodies, strict=True)):
                    node, order = trie.insert(normalized(text)), _order(doc, text)
                    if node.value is None or order < node.value[0]:
                        node.value = (order, len(held), place)
                held.append(rows)
                size += sum(map(len, bodies)) + 200 * len(bodies)
                if size > TRIE_BYTES:
                    yield from keepers()
                    trie, held, size = PatriciaTrie(), [], 0
        yield from keepers()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = SpillingTrie(least=True), None
        for batch in batches:
            for rows, ids, bodies in fields(batch):
                kind = rows.type
                others = pa.StructArray.from_arrays([pa.nulls(len(rows), f.type) if k == at_text else rows.field(k) for k, f in enumerate(kind)], fields=list(kind))
                for doc, text, row, null in zip(ids, bodies, others.to_pylist(), rows.field(at_text).is_null().to_pylist(), strict=True):
                    body = normalized(text)
                    # the text is held once where it is normalized already
                    own = b"" if body == text else text
                    trie.add(body, _Keeper(_order(doc, text), (null, own, row)), 500 + len(own))
        name, out, size = None if kind is None else kind[at_text].name, [], 0
        for body, values in trie.groups():
            null, own, row = min(values).row
            row[name] = None if null else (own or body).decode()
            out.append(row)
            size += len(body) + 500
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, kind)], names=["row"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, kind)], names=["row"])

    row = packed.schema["row"].dataType
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("row", row)])
    kept = packed.mapInArrow(local, schema).repartition("n_bytes", "hash").mapInArrow(keep, T.StructType([T.StructField("row", row)]))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
