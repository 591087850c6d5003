"""N-gram Jaccard self-join by chosen paths.

Sets are the distinct runs of five words, embedded as a pool of keyed minima, so that two sets of similarity J agree in
each place of the pool with probability J. In each run a set follows chosen paths: at every level a path, that is its
places and tokens so far, tells by its hash which place's token comes next, and at times a second one, so that a path
has 1 / threshold continuations on average and a pair at the threshold keeps about one in common at any depth. Buckets
of sets on the same path are split by the next level until they are small; small buckets are compared by brute force
on the pools, and runs are repeated until a pair at the threshold that is split to the greatest depth is missed with a
probability of at most 1 - target_recall. What the pools propose is grouped, and within the groups every pair is
verified on the full sets, which also finds pairs that no bucket held.

Equal sets are joined once: a node stands for all rows that have the set. Bucket counts are aggregated before the
shuffle, buckets that stay large at the greatest depth are proposed as a group without gathering them, and large groups
are verified in tasks of two chunks each, from which only counts and spanning links leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, distinct, groups, materialize, maybe_in, mix, null_safe_text, read, require, text_hashes, texts, window_hashes
from .components import components

SHINGLE, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
#: Places of a set's pool, sets that a bucket may hold before it is split again, levels of a path, sets in a chunk of a
#: verified group.
POOL, BUCKET, DEPTH, CHUNK = 64, 64, 6, 512
#: A pair goes on when the last bytes of its pools agree in this share of places: five standard deviations below the
#: threshold.
SKETCH_SHARE = 0.55


def kept_path(similarity: float, branch: float, depth: int) -> float:
    """Probability that two sets have a path of this depth in common when a path has 1 or (with ``branch``) 2 continuations."""
    lost = 0.0
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = one * (1 - branch + branch * one)
    return 1 - lost


def runs_for(threshold: float, recall: float, depth: int = DEPTH, pool: int = POOL) -> int:
    """Runs after which a pair at the threshold has met at this depth with the target probability, whatever its pools agree in."""
    shares = [(math.comb(pool, k) * threshold**k * (1 - threshold) ** (pool - k), kept_path(k / pool, 1 / threshold - 1, depth)) for k in range(pool + 1)]
    runs = 1
    while sum(p * (1 - kept) ** runs for p, kept in shares) > 1 - recall:
        runs += 1
    return runs


def shingle_sets(bodies: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; a shorter text that has words is one run."""
    hashes, counts = text_hashes(bodies, fold=True)
    ends = np.cumsum(counts)
    return [distinct(window_hashes(hashes[e - c : e], min(n, c))) if c else np.zeros(0, np.uint64) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _multipliers(count: int) -> np.ndarray:
    return (mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(tokens: np.ndarray, a: np.ndarray) -> np.ndarray:
    """For each multiplier the smallest product over the (already well mixed) tokens."""
    folded = (tokens >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(folded), 2048):
        np.minimum(out, (a[:, None] * folded[None, start : start + 2048]).min(axis=1), out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _continued(keys: np.ndarray, pools: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the paths that go on from each row's path: the path's hash tells which place's token comes next."""
    draw = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    width = np.uint64(pools.shape[1])
    first = draw % width
    second = (first + np.uint64(1) + (draw >> np.uint64(16)) % (width - np.uint64(1))) % width
    twice = np.flatnonzero((draw >> np.uint64(40)).astype(np.float64) < branch * (1 << 24))
    rows = np.concatenate([np.arange(len(keys)), twice])
    places = np.concatenate([first, second[twice]])
    with np.errstate(over="ignore"):
        token = pools[rows, places.astype(np.int64)].astype(np.uint64) | places << np.uint64(32)
        return rows, mix(keys[rows] * np.uint64(0x9E3779B97F4A7C15) + mix(token))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Smallest member of the component of each of n places, for links a-b."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets (with each other if right is None)."""
    other = left if right is None else right
    if len(left) * len(other) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in other] for x in left], dtype=np.int64)
    sets = left if right is None else left + right
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(other)), dtype=np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        out += block[: len(left)] @ (block if right is None else block[len(left) :]).T
    return np.rint(out).astype(np.int64)


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    inter = overlaps(left, right)
    a = np.array([len(s) for s in left])
    b = a if right is None else np.array([len(s) for s in right])
    links = inter >= threshold * (a[:, None] + b[None, :] - inter) - 1e-9
    links &= inter > 0
    if right is None:
        links = np.triu(links, 1)
    return np.nonzero(links)


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, bucket: int = BUCKET, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, copy_of, class_id, n_links``.

    ``copy_of`` is the smallest id with the same set, ``class_id`` the smallest id among all that links connect, and
    ``n_links`` the number of other sets with a similarity of ``threshold`` or more. Rows without words have no links
    and a class of their own; rows without an id come out with nulls; rows that share an id are judged each by its
    text. Ids are numbers. An empty table gives an empty result.
    """
    rows = _joined(docs, id_col, text_col, n, threshold, target_recall, bucket, chunk)
    return rows.select(F.col("id").alias("doc_id"), F.coalesce("first.id", "id").alias("copy_of"), F.coalesce("class.id", "id").alias("class_id"), "n_links")


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, target_recall: float, bucket: int, chunk: int) -> DataFrame:
    """``id, h, size, first, class, n_links``: h is a hash of the text, first and class are (id, h) of the smallest row of
    the same set and of the class; null for rows without words or id."""
    require(docs, id_col, text_col)
    runs = runs_for(threshold, target_recall)
    a = _multipliers(POOL)
    base = docs.select(F.col(id_col).cast("long").alias("id"), null_safe_text(text_col).alias("body")).withColumn("h", F.xxhash64("body"))

    def describe(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        size, low, high, signatures, sketches = [], [], [], [], []
        for s in shingle_sets(texts(batch.column(batch.schema.get_field_index("body"))), n):
            size.append(len(s))
            with np.errstate(over="ignore"):
                low.append(int(_signed(np.sum(mix(s), dtype=np.uint64, keepdims=True))[0]))
                high.append(int(_signed(np.sum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64, keepdims=True))[0]))
            pool = signature(s, a)
            signatures.append(pool.tobytes() if len(s) else None)
            sketches.append((pool & np.uint32(0xFF)).astype(np.uint8).tobytes() if len(s) else None)
        return {"size": pa.array(size, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "pool": pa.array(signatures, pa.binary()), "sketch": pa.array(sketches, pa.binary())}

    described = materialize(append_columns(base, "body", describe, "size long, low long, high long, pool binary, sketch binary", drop=("body",)), "near-sets")
    same = ["low", "high", "size"]
    # the pools of equal sets are equal, so any will do; numbers are fixed once the table is written
    nodes = described.filter("size > 0 and id is not null").groupBy(*same).agg(F.min(F.struct("id", "h")).alias("first"), F.first("pool").alias("pool"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    small, large = _buckets(nodes, runs, 1 / threshold - 1, bucket)
    proposed = _propose(small.join(nodes.select("node", "size", "sketch"), "node"), threshold)
    groups_of = materialize(components(proposed.unionByName(large) if large is not None else proposed), "near-groups")
    checked = materialize(_verify(base, groups_of.join(nodes.select("node", "first.id", "first.h"), "node"), n, threshold, chunk), "near-links")

    counts = checked.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = components(checked.filter("n = 0").select("a", "b")).join(nodes.select("node", "first"), "node")
    least = classes.groupBy("component").agg(F.min("first").alias("class"))
    known = nodes.select(*same, "node", "first").join(counts, "node", "left").join(classes.select("node", "component"), "node", "left").join(least, "component", "left")
    known = materialize(known.select(*same, "first", F.coalesce("class", "first").alias("class"), "n_links"), "near-classes")
    linked = described.filter("size > 0 and id is not null").select("id", "h", *same).join(known, same).select("id", "h", "size", "first", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    none = F.lit(None).cast(known.schema["first"].dataType)
    return linked.unionByName(described.filter("size = 0 or id is null").select("id", "h", "size", none.alias("first"), none.alias("class"), F.lit(0).cast("long").alias("n_links")))


def _buckets(nodes: DataFrame, runs: int, branch: float, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, node) of all small buckets of two sets or more, and star links of those that stay large at full depth."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            pools = np.frombuffer(b"".join(column("pool").to_pylist()), dtype=np.uint32).reshape(-1, POOL)
            ids = column("node").to_numpy(zero_copy_only=False)
            keys = column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for roots in [keys] if not first else [np.full(len(ids), mix(np.array([r + 1], dtype=np.uint64))[0]) for r in range(runs)]:
                rows, made = _continued(roots, pools, branch)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(_signed(made))], names=["node", "key"])

    first = True
    pools = nodes.select("node", "pool")
    active = pools.withColumn("key", F.lit(0).cast("long")).mapInArrow(paths, "node long, key long")
    leaves = None
    for d in range(DEPTH):
        if d:
            first = False
            active = pools.join(heavy, "node").mapInArrow(paths, "node long, key long")
        active = materialize(active, "near-paths")
        counts = materialize(active.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-counts")
        met = materialize(active.join(counts, "key"), "near-met")  # paths that one set follows alone are gone
        small = met.filter(F.col("n") <= bucket).select("key", "node")
        leaves = small if leaves is None else leaves.unionByName(small)
        if counts.filter(F.col("n") > bucket).limit(1).count() == 0:
            return leaves, None
        heavy = met.filter(F.col("n") > bucket).select("node", "key")
    heads = materialize(heavy.groupBy("key").agg(F.min("node").alias("b")), "near-heads")
    return leaves, heavy.select("key", F.col("node").alias("a")).join(heads, "key").select("a", "b")


def _propose(leaves: DataFrame, threshold: float) -> DataFrame:
    """Star links between the sets of each bucket whose pools and sizes allow the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key"]):
            if table.num_rows < 2:
                continue
            ids = np.array(table.column("node").to_pylist())
            sizes = np.array(table.column("size").to_pylist())
            order = np.argsort(ids)
            ids, sizes = ids[order], sizes[order]
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, POOL)[order]
            first, second = np.triu_indices(len(ids), 1)
            ratio = np.minimum(sizes[first], sizes[second]) >= threshold * np.maximum(sizes[first], sizes[second]) - 1e-9
            first, second = first[ratio], second[ratio]
            alike = (sketches[first] == sketches[second]).mean(axis=1) >= SKETCH_SHARE if len(first) else np.zeros(0, bool)
            roots = _roots(len(ids), first[alike], second[alike])
            found = [(int(ids[i]), int(ids[r])) for i, r in enumerate(roots) if i != r]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return leaves.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def _verify(base: DataFrame, groups_of: DataFrame, n: int, threshold: float, chunk: int) -> DataFrame:
    """Rows ``a, b, n``: n > 0 counts links of a found in one task; n = 0 is a link that spans them."""
    sizes = materialize(groups_of.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "near-sizes")
    dealt = groups_of.join(sizes, "component").select("id", "h", "node", "component", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    dealt = materialize(dealt, "near-dealt")

    def tokens(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"tokens": pa.array([s.tobytes() for s in shingle_sets(texts(batch.column(batch.schema.get_field_index("body"))), n)], pa.binary())}

    # only texts that may be in a group are shuffled
    held = maybe_in(base, "h", dealt).filter("maybe").drop("maybe")
    sets = append_columns(held.join(dealt, ["id", "h"]), "body", tokens, "tokens binary", drop=("body",))
    tasks = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = tasks.select("component", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "node", "chunk", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["component", "i", "j"]):
            # rows that repeat id and text come more than once
            rows = sorted(set(zip(table.column("node").to_pylist(), table.column("chunk").to_pylist(), table.column("tokens").to_pylist(), strict=True)))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            sets = [np.frombuffer(t, dtype=np.uint64) for _, _, t in rows]
            ids = np.array([r[0] for r in rows])
            if i == j:
                left = right = np.arange(len(rows))
                x, y = similar_pairs(sets, None, threshold)
            else:
                left = np.array([k for k, r in enumerate(rows) if r[1] == i], dtype=np.int64)
                right = np.array([k for k, r in enumerate(rows) if r[1] == j], dtype=np.int64)
                if not len(left) or not len(right):
                    continue
                x, y = similar_pairs([sets[k] for k in left], [sets[k] for k in right], threshold)
            x, y = left[x], right[y]
            if not len(x):
                continue
            links = np.bincount(np.concatenate([x, y]), minlength=len(ids))
            roots = _roots(len(ids), x, y)
            out = [(int(ids[k]), int(ids[k]), int(links[k])) for k in np.flatnonzero(links)]
            out += [(int(ids[k]), int(ids[r]), 0) for k, r in enumerate(roots) if ids[k] != ids[r]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n"])

    return tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(compare, "a long, b long, n long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class does: that with the smallest id.

    Rows without an id or without words stay; of rows that repeat id and text one stays.
    """
    rows = materialize(_joined(docs, id_col, text_col, SHINGLE, THRESHOLD, TARGET_RECALL, BUCKET, CHUNK).filter("class is not null").select("id", "h", "class"), "near-rows")
    leads = (F.col("id") == F.col("class.id")) & (F.col("h") == F.col("class.h"))
    gone = materialize(rows.filter(~leads).select("id", "h").distinct(), "near-gone")
    again = materialize(rows.filter(leads).groupBy("id", "h").agg(F.count("*").alias("n")).filter("n > 1").select("id", "h"), "near-again")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(null_safe_text(text_col)).alias("h"))
    # rows that can't be concerned stay where they are
    marked = maybe_in(keyed, "h", gone.unionByName(again))
    rest = marked.filter("maybe").drop("maybe")
    kept = marked.filter("not maybe").drop("maybe").unionByName(rest.join(gone.unionByName(again), ["id", "h"], "left_anti"))
    if again.limit(1).count():
        kept = kept.unionByName(rest.join(again, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), k AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS same FROM s GROUP BY doc_id
), r AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS rep FROM k
), ts AS (SELECT s.doc_id, t FROM s JOIN r ON s.doc_id = r.doc_id AND r.rep = r.doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM ts x JOIN ts y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), links AS (SELECT a AS rep, count(*) AS n_links FROM l GROUP BY a),
walk AS (
  WITH RECURSIVE c(rep, root) AS (SELECT a, a FROM l UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.rep)
  SELECT rep, min(root) AS class_id FROM c GROUP BY rep
)
SELECT d.doc_id, coalesce(rep, d.doc_id) AS copy_of, coalesce(class_id, rep, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN links USING (rep) LEFT JOIN walk USING (rep)
"""
