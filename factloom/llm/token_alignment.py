"""Alignment of two tokenizers over one corpus by diagonal run skipping, and counts of the id pairs that it links.

Both token sequences of a text are laid out as byte end offsets. A walk over the two end arrays keeps the current index
shift: where ends agree, exponential probing compares ever longer stretches at that shift and jumps over one-to-one
runs; where they part, the side that lies behind moves until ends meet again, which closes an irregular group and sets
a new shift. Groups lie between common ends; all tokens of a group are linked with all of the other side.

An id pair's count is the number of documents that hold it linked. Tasks cut their documents into chunks; a chunk keeps
each document's distinct pairs as packed numbers and tells the rest of the corpus one row per distinct pair. Spark sums
these rows by pair, and each chunk gets back one row per pair it asked for: what is shuffled grows with the chunks'
vocabularies of pairs, not with the links. A pair has at most one row per chunk, so no key is hot.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, read, require, texts

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words of text as the byte-level tokenizer's files split them, before merges (a fixed value of its format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text of one chunk, and of what is encoded at once.
CHUNK_BYTES = 32 << 20
PIECE_BYTES = 2 << 20
#: Links of a group beyond which its pairs are made from distinct ids.
WIDE_GROUP = 1 << 16


_SPACED = re.compile(" +[^ ]*")


class _Words(dict):
    """Piece ids of a space and a word, None if they are not its bytes; forgets everything when it holds too many or too long ones."""

    LIMIT = 400_000
    LONG = 64

    def __init__(self, pair: Pair):
        self.pair = pair

    def __missing__(self, word: str) -> tuple[int, ...] | None:
        ids = self.pair.second.encode(word) if word else [self.pair.blank]
        value = tuple(ids) if b"".join(map(self.pair.bytes_b.__getitem__, ids)) == b" " + word.encode() else None
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


class Pair:
    """The two tokenizers, the bytes of their tokens, and the names of tokens with what follows them."""

    def __init__(self, folder: str):
        with open(os.path.join(folder, BYTE_LEVEL), encoding="utf-8") as file:
            model = json.load(file)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in model["added_tokens"]}
        ranks = {bytes(chars[c] for c in token): no for token, no in model["model"]["vocab"].items() if token not in special}
        # ids stand in merge order, so they serve as ranks
        self.first = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        a = [b""] * (max(ranks.values()) + 1)
        for token, no in ranks.items():
            a[no] = token
        b = [self._piece(no) for no in range(self.second.get_piece_size())]
        self.bytes_a, self.bytes_b, self.n_b = a, b, len(b)
        self.len_a, self.len_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (a, b))
        # if no piece goes on with a space behind a word, words (and the spaces before them) are merged alone and may be looked up
        self.by_word = not any("▁" in self.second.id_to_piece(no).lstrip("▁") for no in range(len(b)))
        self.blank = self.second.piece_to_id("▁")
        self.words = _Words(self)
        # a token's name before another of its side, and before the other side
        self.names = [f"{no}{mark}" for size, marks in ((len(a), ",|"), (len(b), ",;")) for mark in marks for no in range(size)]
        self.offsets = np.array([0, len(a), 2 * len(a), 2 * len(a) + len(b)], dtype=np.int64)

    def _piece(self, no: int) -> bytes:
        piece = self.second.id_to_piece(no)
        return bytes([int(piece[3:-1], 16)]) if self.second.is_byte(no) else piece.replace("▁", " ").encode()

    def _words(self, text: str) -> list[str]:
        """Parts of a text that are merged alone, each without the space that the tokenizer adds."""
        if not self.by_word:
            return [text]
        return [x[1:] for x in _SPACED.findall(" " + text)] if text.startswith(" ") or "  " in text else text.split(" ")

    def encode(self, bodies: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by both; none for a text that is empty or that either does not give back byte by byte.

        The byte-level tokenizer gives back all that is UTF-8.
        """
        out_a, out_b, none = [], [], np.zeros(0, dtype=np.int64)
        for body in bodies:
            try:
                text = body.decode()
                parts = list(map(self.words.__getitem__, self._words(text))) if text else []
            except UnicodeDecodeError:
                parts = []
            if parts and None not in parts:
                out_a.append(self.first.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64))
                out_b.append(np.fromiter(chain.from_iterable(parts), dtype=np.int64))
            else:
                out_a.append(none)
                out_b.append(none)
        return out_a, out_b


_PAIRS: dict[str, Pair] = {}


def pair_of(folder: str) -> Pair:
    if folder not in _PAIRS:
        _PAIRS[folder] = Pair(folder)
    return _PAIRS[folder]


def common_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches ``(i, j, length)`` of equal ends at one index shift, in order; both arrays end alike."""
    runs, i, j, n = [], 0, 0, len(ends_a)
    at_a, at_b = ends_a.tolist(), ends_b.tolist()
    # stretches are compared as bytes
    raw_a, raw_b = ends_a.astype(np.int32).tobytes(), ends_b.astype(np.int32).tobytes()
    while i < n:
        x, y = at_a[i], at_b[j]
        while x != y:  # an irregular group: the side behind moves on
            if x < y:
                i += 1
                x = at_a[i]
            else:
                j += 1
                y = at_b[j]
        length = 1
        if i + 1 < n and at_a[i + 1] == at_b[j + 1]:
            # probe stretches of 2, 4, 8, ... at this shift, then halve the one that fails
            p, q, length, step = 4 * i, 4 * j, 2, 2
            while i + length + step <= n and raw_a[p + 4 * length : p + 4 * (length + step)] == raw_b[q + 4 * length : q + 4 * (length + step)]:
                length += step
                step *= 2
            while step:
                if i + length + step <= n and raw_a[p + 4 * length : p + 4 * (length + step)] == raw_b[q + 4 * length : q + 4 * (length + step)]:
                    length += step
                step >>= 1
        runs.append((i, j, length))
        i, j = i + length, j + length
    return runs


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the last token of each group, on both sides."""
    runs = np.array(common_runs(ends_a, ends_b), dtype=np.int64).reshape(-1, 3)
    i, j, length = runs.T
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(i, length) + within, np.repeat(j, length) + within


class Piece:
    """Some documents' tokens laid end to end, their groups, and their linked pairs."""

    def __init__(self, pair: Pair, bodies: list[bytes]):
        a, b = pair.encode(bodies)
        self.pair, self.n_docs = pair, len(bodies)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a, b))
        empty = [np.zeros(0, dtype=np.int64)]
        self.a, self.b = np.concatenate(a + empty), np.concatenate(b + empty)
        # equal bytes of both sides keep the offsets of later documents in step
        self.last_a, self.last_b = group_ends(np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b]))
        self.size_a, self.size_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        self.bounds = np.searchsorted(self.last_a, np.cumsum(self.n_a))  # groups before each document's end
        self.n_groups = np.diff(self.bounds, prepend=0)
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.size_a * self.size_b)])[self.bounds], prepend=0)

    def names(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        group = np.arange(len(self.last_a))
        of_a, of_b = np.repeat(group, self.size_a), np.repeat(group, self.size_b)
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        kind_a, kind_b = np.zeros(len(self.a), dtype=np.int64), np.full(len(self.b), 2, dtype=np.int64)
        kind_a[self.last_a] = 1
        kind_b[self.last_b] = 3
        order[np.arange(len(self.a)) + (self.last_b - self.size_b + 1)[of_a]] = self.a + self.pair.offsets[kind_a]
        order[np.arange(len(self.b)) + (self.last_a + 1)[of_b]] = self.b + self.pair.offsets[kind_b]
        words, out, at = list(map(self.pair.names.__getitem__, order.tolist())), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(words[at : at + n])[:-1])
            at += n
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of its links, for each distinct pair of each document, in that order."""
        links = self.size_a * self.size_b
        doc_of = np.repeat(np.arange(self.n_docs), self.n_groups)
        wide = np.flatnonzero(links > WIDE_GROUP)
        plain = np.where(links > WIDE_GROUP, 0, links)
        of = np.repeat(np.arange(len(links)), plain)
        k = np.arange(len(of)) - np.repeat(np.cumsum(plain) - plain, plain)
        first_a, first_b = self.last_a - self.size_a + 1, self.last_b - self.size_b + 1
        row, column = np.divmod(k, self.size_b[of])
        span = np.int64(len(self.pair.len_a)) * self.pair.n_b
        keys = [doc_of[of] * span + self.a[first_a[of] + row] * self.pair.n_b + self.b[first_b[of] + column]]
        keys[0].sort()
        starts = np.flatnonzero(np.concatenate([[True], keys[0][1:] != keys[0][:-1]])) if len(of) else np.zeros(0, np.int64)
        times = [np.diff(starts, append=len(of))]
        keys = [keys[0][starts]]
        for g in wide.tolist():
            ids_a, n_a = np.unique(self.a[first_a[g] : self.last_a[g] + 1], return_counts=True)
            ids_b, n_b = np.unique(self.b[first_b[g] : self.last_b[g] + 1], return_counts=True)
            keys.append((doc_of[g] * span + ids_a[:, None] * self.pair.n_b + ids_b).ravel())
            times.append((n_a[:, None] * n_b).ravel())
        key, n = np.concatenate(keys), np.concatenate(times)
        if len(wide):
            key, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, weights=n).astype(np.int64)
        return key // span, key % span, n


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_CHUNK_COLUMNS = "chunk string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, at binary, times binary, pair long, n_docs long"
_CHUNK_TYPES = pa.schema([
    ("chunk", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("at", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("n_docs", pa.int64()),
])


def _chunk_rows(pair: Pair, ids: list[int | None], bodies: list[bytes], with_groups: bool) -> Iterator[pa.RecordBatch]:
    """One row per document with its pairs as places in the chunk's list of pairs, then one row per pair of that list."""
    chunk, rows, found, start = uuid.uuid4().hex, [], [], 0
    while start < len(bodies):
        stop, held = start, 0
        while stop < len(bodies) and (stop == start or held + len(bodies[stop]) <= PIECE_BYTES):
            held += len(bodies[stop])
            stop += 1
        piece = Piece(pair, bodies[start:stop])
        names = piece.names()
        shas = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names]
        rows += zip(ids[start:stop], piece.n_a.tolist(), piece.n_b.tolist(), piece.n_groups.tolist(), piece.n_links.tolist(), shas, names if with_groups else [None] * len(names), strict=True)
        docs, codes, times = piece.pairs()
        cuts = np.searchsorted(docs, np.arange(1, piece.n_docs))
        found += zip(np.split(codes, cuts), np.split(times.astype(np.uint32), cuts), strict=True)
        start = stop
    everything = np.sort(np.concatenate([c for c, _ in found]))
    starts = np.flatnonzero(np.concatenate([[True], everything[1:] != everything[:-1]])) if len(everything) else np.zeros(0, np.int64)
    known, n_docs = everything[starts], np.diff(starts, append=len(everything))
    del everything
    columns = list(zip(*rows, strict=True))
    data = {name: pa.array(c, _CHUNK_TYPES.field(name).type) for name, c in zip(_CHUNK_TYPES.names[1:8], columns, strict=True)}
    data["at"] = pa.array([pack(np.diff(np.searchsorted(known, c), prepend=0)) for c, _ in found], pa.binary())
    data["times"] = pa.array([pack(t) for _, t in found], pa.binary())
    yield _batch(chunk, len(rows), data)
    yield _batch(chunk, len(known), {"pair": pa.array(known), "n_docs": pa.array(n_docs)})


def _batch(chunk: str, n: int, data: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {"chunk": pa.array([chunk] * n, pa.string()), **data}
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _CHUNK_TYPES], schema=_CHUNK_TYPES)


def chunks(docs: DataFrame, id_col: str, text_col: str, folder: str, with_groups: bool) -> DataFrame:
    """The written table of chunks: rows of documents (``pair`` is null) and rows of their pairs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, ids, bodies, held = pair_of(folder), [], [], 0
        for whole in batches:
            for batch in pieces(whole, "body", CHUNK_BYTES):
                more = texts(batch.column(1))
                size = sum(map(len, more))
                if bodies and held + size > CHUNK_BYTES:
                    yield from _chunk_rows(pair, ids, bodies, with_groups)
                    ids, bodies, held = [], [], 0
                ids += batch.column(0).to_pylist()
                bodies += more
                held += size
        if bodies:
            yield from _chunk_rows(pair, ids, bodies, with_groups)

    return materialize(rows.mapInArrow(run, _CHUNK_COLUMNS), "token-chunks")


def pair_counts(chunked: DataFrame, n_b: int) -> DataFrame:
    """``pair, a, b, count, best`` of every linked id pair; ``best``: no pair of its A id has a higher count."""
    counts = chunked.filter("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("count"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {n_b}")).withColumn("b", F.expr(f"pair % {n_b}")), "token-pairs")
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(highest, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, with_groups: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and ``groups`` if asked for.

    A is the byte-level tokenizer on a space and the text, B the piece tokenizer on the text. Null and empty texts, and
    those that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty string. Ids are
    numbers; rows that repeat, or have no id, are documents of their own. An empty table gives an empty result. A group
    of many tokens on both sides costs as many pairs as it has distinct ids on the two sides.
    """
    require(docs, id_col, text_col)
    pair = pair_of(folder)
    chunked = chunks(docs, id_col, text_col, folder, with_groups)
    told = chunked.filter("pair is not null").select("chunk", "pair").join(pair_counts(chunked, pair.n_b).select("pair", "count", "best"), "pair")
    told = told.select(F.col("chunk").alias("to"), "pair", "count", "best")
    held = chunked.filter("pair is null").drop("pair", "n_docs", *([] if with_groups else ["groups"]))

    def finish(documents: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("pair").to_numpy())
        count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order].astype(np.int64)
        n_best, count_sum = [], []
        for at, times in zip(documents.column("at").to_pylist(), documents.column("times").to_pylist(), strict=True):
            places, n = np.cumsum(unpack(at)), unpack(times)
            n_best.append(int(n @ best[places]))
            count_sum.append(int(n @ count[places]))
        out = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        for name in ["groups_sha256"] + (["groups"] if with_groups else []):
            out = out.append_column(name, documents.column(name))
        return out

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if with_groups else "")
    return held.groupBy("chunk").cogroup(told.groupBy("to")).applyInArrow(finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read(spark, sf_dir, "documents"))
