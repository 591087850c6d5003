"""Shared pieces of the training-data operators: the folder all machines see, word cutting, Arrow helpers.

Every operator takes a DataFrame with an id column and a text column. Extra input columns pass through; when an
operator adds a column whose name is already there, the operator's column replaces the input's.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of lower-cased text: runs of digits, letters a-z and everything outside ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words by white space.
SPACE_WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in range(ord("0"), ord("9") + 1):
    _FOLD[_c] = _c
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c
_FOLD = bytes(_FOLD)

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-factloom-"))
        base = f"file://{_OWN_DIR[0]}"
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/factloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a step's rows to the shared folder and go on from the written table; cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a filter of hashes that is broadcast, with 64 slots each; the bound holds whatever the tables' size.
FILTER_WORDS = 1 << 17


def maybe_in(df: DataFrame, h: str, keys: DataFrame) -> DataFrame:
    """``df`` with a boolean ``maybe``: false where no row of ``keys`` has the hash ``h``, so that such rows need no shuffle to be told apart.

    The slots that the hashes of ``keys`` fall in are aggregated to :data:`FILTER_WORDS` rows at most and broadcast.
    With more keys than slots all rows may be true, which costs a shuffle of them and nothing else.
    """
    word, bit = f"cast(pmod(shiftright({h}, 6), {FILTER_WORDS}) as int)", f"cast(pmod({h}, 64) as int)"
    slots = keys.groupBy(F.expr(word).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))
    found = df.withColumn("_word", F.expr(word)).join(F.broadcast(slots), "_word", "left")
    return found.withColumn("maybe", F.expr(f"coalesce(shiftright(_bits, {bit}) & 1L, 0L) = 1L")).drop("_word", "_bits")


def fold_words(text: bytes) -> list[bytes]:
    """Words of :data:`WORD_PATTERN` after lower-casing A-Z, as UTF-8."""
    return text.translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hashes of words; forgets everything when it holds too many, so memory stays bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


_SPACED = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_CHUNK = 1 << 20
_LONG_WORD = 256
_SYMBOLS = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2^64; those of a chunk are kept."""
    if not _POWERS or n > _CHUNK:
        step, size = 0x9E3779B97F4A7C15, max(n, _CHUNK) + 1
        up, down = np.full(size, step, dtype=np.uint64), np.full(size, pow(step, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > _CHUNK:
            return made
        _POWERS["up"], _POWERS["down"] = made
    return _POWERS["up"], _POWERS["down"]


def text_hashes(bodies: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, laid end to end, and the number of words of each text.

    Words are those of :func:`fold_words`, or runs of non-space characters. A word's hash is a difference of prefix sums
    of its bytes weighted by powers, moved to a common place; words so long that such sums could be made to agree are
    hashed by themselves.
    """
    joined = b"".join(x + b" " for x in bodies).translate(_FOLD if fold else _SPACED)
    bounds = np.cumsum([len(b) + 1 for b in bodies])
    found, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        stop = len(joined)
        if stop - at > _CHUNK:
            stop = joined.rfind(b" ", at, at + _CHUNK) + 1
            if stop <= at:  # one word fills the chunk
                stop = joined.index(b" ", at) + 1
        chars = np.frombuffer(joined, dtype=np.uint8, count=stop - at, offset=at)
        inside = np.zeros(len(chars) + 1, dtype=bool)
        np.not_equal(chars, 32, out=inside[1:])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        if len(starts):
            up, down = _powers(len(chars))
            with np.errstate(over="ignore"):
                sums = np.cumsum(_SYMBOLS[chars] * up[: len(chars)], dtype=np.uint64)
                first = np.where(starts > 0, sums[starts - 1], np.uint64(0))
                value = mix((sums[ends - 1] - first) * down[starts])
            for k in np.flatnonzero(ends - starts > _LONG_WORD):
                value[k] = xxhash.xxh3_64_intdigest(chars[starts[k] : ends[k]].tobytes())
            found.append(value)
            firsts.append(starts + at)
        at = stop
    firsts = np.concatenate(firsts)
    return np.concatenate(found), np.diff(np.searchsorted(firsts, bounds), prepend=0) if len(bodies) else np.zeros(0, np.int64)


def window_hashes(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of every run of ``width`` consecutive word hashes, mixed so that all bits are usable."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= step
            out += hashes[k : n + k]
        return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting is many times faster here than ``np.unique`` without an inverse)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of one column at most (a longer text is a slice of its own)."""
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def append_columns(
    df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, drop: tuple[str, ...] = ()
) -> DataFrame:
    """All columns of ``df`` (without ``drop`` and those that are replaced) and the columns that ``fn`` makes of each batch.

    Row-wise, so it needs no shuffle; ``fn`` sees at most about 16 MB of text at once.
    """
    added = T._parse_datatype_string(schema)
    names = [f.name for f in added.fields]
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                made = fn(batch)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in kept_names] + [made[n] for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=kept_names + names)

    return df.mapInArrow(run, T.StructType(kept + added.fields))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a stream of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            values = np.asarray(c.to_numpy(zero_copy_only=False))
            change[1:] |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[int(a)].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def null_safe_text(text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))
