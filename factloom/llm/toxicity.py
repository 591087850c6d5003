"""Toxicity scoring of noisy-channel restored text.

A character trigram model is counted over all documents. Tokens that look disguised (digits or signs among letters,
stretched letters, letters spaced apart) become lattices of what each character may stand for, and the Viterbi path
under channel costs and the character model restores them. Texts are scored on their restored form by a logistic
model over hashed words and character n-grams, fitted on a bounded sample of labelled rows; it selects the features
that separate the labels significantly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, materialize, null_safe_text, read, require, texts

#: Labelled rows that the classifier is fitted on, at most (those with the smallest hashes of their ids).
MAX_LABELLED = 20_000
#: Hashed features, and how many of them the classifier uses at most.
FEATURE_BITS = 18
MAX_FEATURES = 4_096

# Character alphabet of the model: a-z, one class each for other letters, for digits and for all else (the boundary).
OTHER, DIGIT, EDGE, N_SYMBOLS = 26, 27, 28, 29
_SYMBOL = np.full(256, EDGE, dtype=np.uint8)
for _c in range(26):
    _SYMBOL[ord("a") + _c] = _SYMBOL[ord("A") + _c] = _c
_SYMBOL[ord("0") : ord("9") + 1] = DIGIT
_SYMBOL[0x80:] = OTHER

# Letters that signs and digits commonly stand for, with the probability of the disguise.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
P_LEET, P_DROP, P_REPEAT = 0.02, 0.01, 0.05

# Whole runs of letters, digits and signs with a letter and a digit or sign, or with a letter three times or more; three or
# more single characters set apart by separators.
_SUSPECT = re.compile(
    rb"(?<![A-Za-z0-9@$!|+(*])(?:[A-Za-z]+[0-9@$!|+(*]|[0-9@$!|+(*]+[A-Za-z]|[A-Za-z]*?([A-Za-z])\1\1)[A-Za-z0-9@$!|+(*]*"
    rb"|(?<![A-Za-z0-9])[A-Za-z0-9@$!](?:[ ._*-]+[A-Za-z0-9@$!]){2,}(?![A-Za-z0-9])"
)
_LETTER = re.compile(rb"[A-Za-z]")
_SEPARATORS = b" ._*-"


class CharModel:
    """Smoothed trigram log2 probabilities over the alphabet; counts[a, b, c]."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + N_SYMBOLS)
        p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
        p3 = (tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8)
        self.log = np.log2(p3).tolist()

    def restore(self, token: str) -> str:
        """The likeliest plain reading of a token: Viterbi over (last two symbols) through the character lattice.

        Each place may be read as it is, as a letter it stands for, as nothing (a separator or sign put in), or as a
        continuation of the letter before (stretching). Restored letters are lower case.
        """
        leet, drop, stretch = np.log2(P_LEET), np.log2(P_DROP), np.log2(P_REPEAT)
        # the reading so far is a chain (what came before, letter), so that a token of any length costs its length only
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        log = self.log
        for c in token:
            low = c.lower() if c.isascii() else c
            readings: list[tuple[str | None, float]] = []
            if low.isalpha():
                readings.append((low, 0.0))
            else:
                readings += [(x, leet) for x in LEET.get(low, "")]
                readings.append((low, leet if low.encode()[:1] in _SEPARATORS else 0.0))
                readings.append((None, drop if low not in LEET or low == "*" else 2 * drop))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, text) in states.items():
                row = log[a][b]
                for letter, price in readings:
                    if letter is None:
                        key, total, out = (a, b), cost + price, text
                    else:
                        s = int(_SYMBOL[letter.encode()[0]])
                        key, total, out = (b, s), cost + price + row[s], (text, letter)
                        if text and text[1] == letter and letter.isalpha() and (old := after.get((a, b), (-1e300, None)))[0] < cost + stretch:
                            after[(a, b)] = (cost + stretch, text) if cost + stretch > old[0] else old
                    if total > after.get(key, (-1e300, None))[0]:
                        after[key] = (total, out)
            states = after
        _, _, text = max((cost + log[a][b][EDGE], (a, b), text) for (a, b), (cost, text) in states.items())
        letters = []
        while text:
            text, letter = text
            letters.append(letter)
        return "".join(reversed(letters))

    def likely(self, word: str) -> bool:
        """Whether the model gives a reading more than random letters and edges have."""
        a = b = EDGE
        bits = 0.0
        for s in [*(int(_SYMBOL[c.encode()[0]]) for c in word), EDGE]:
            bits -= self.log[a][b][s]
            a, b = b, s
        return bits < np.log2(27) * (len(word) + 1)


def wordlike(token: bytes) -> bool:
    """Whether a suspect token is taken for a word whatever it reads; what looks like a number, hash or blob must read likely."""
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in token)
    marks = sum(48 <= c <= 57 for c in token)
    return letters >= 2 and marks <= letters and len(token) <= 64


def restore_text(body: bytes, model: CharModel, cache: dict[bytes, bytes]) -> bytes:
    """The text with its disguised tokens read plainly."""

    def plain(match: re.Match) -> bytes:
        token = match.group(0)
        if not _LETTER.search(token):
            return token
        out = cache.get(token)
        if out is None:
            reading = model.restore(token.decode())
            out = reading.encode() if wordlike(token) or model.likely(reading) else token
            if len(token) <= 64:  # longer ones would fill the memory and hardly come again
                if len(cache) > 50_000:
                    cache.clear()
                cache[token] = out
        return out

    return _SUSPECT.sub(plain, body)


def char_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts over every text; each task sends its own table's non-zero cells, which are summed by cell."""

    def count(batches):
        total = np.zeros(N_SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                joined = b"\n\n".join([b"", *texts(batch.column(0).slice(start, 256)), b""])
                s = _SYMBOL[np.frombuffer(joined, dtype=np.uint8)].astype(np.int32)
                total += np.bincount((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:], minlength=N_SYMBOLS**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    rows = docs.select(null_safe_text(text_col).cast("binary").alias("body")).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(N_SYMBOLS**3, dtype=np.int64)
    for r in rows.collect():  # as many rows as there are trigrams of the alphabet, 24,389 at most
        out[r.cell] = r.n
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[97:123] = _IS_WORD[48:58] = _IS_WORD[0x80:] = True


def features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hashed feature) of every word and every run of 4 and 5 characters within word edges."""
    ends = np.cumsum([len(b) + 2 for b in bodies])
    raw = _FOLD[np.frombuffer(b"".join(b" " + b + b" " for b in bodies), dtype=np.uint8)]
    word = _IS_WORD[raw]
    chars = np.where(word, raw, 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), np.diff(ends, prepend=0))
    found_docs, found = [], []
    with np.errstate(over="ignore"):
        for n in (4, 5):
            if len(chars) < n:
                continue
            h = np.zeros(len(chars) - n + 1, dtype=np.uint32)
            inner = np.ones(len(h), dtype=bool)
            for k in range(n):
                h = h * np.uint32(0x01000193) + chars[k : len(h) + k]
                if 0 < k < n - 1:
                    inner &= word[k : len(h) + k]
            inner &= owner[: len(h)] == owner[n - 1 :]
            at = np.flatnonzero(inner)
            found_docs.append(owner[at])
            found.append((h[at] + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - FEATURE_BITS))
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        if len(starts):
            # a word's hash from prefix sums of position-weighted characters, made independent of the position
            step = np.uint64(0x9E3779B97F4A7C15)
            powers = np.cumprod(np.full(len(chars), step, dtype=np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
            stops = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
            inverse = np.uint64(pow(int(step), -1, 1 << 64))
            back = np.cumprod(np.full(len(chars) + 1, inverse, dtype=np.uint64))
            value = (sums[stops] - sums[starts]) * back[starts]
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found_docs.append(owner[starts])
            found.append((value >> np.uint64(64 - FEATURE_BITS)).astype(np.uint32))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    return np.concatenate(found_docs), np.concatenate(found)


def slices(bodies: list[bytes], limit: int = 1 << 20):
    """Runs of texts of about a megabyte, so that per-character arrays stay small."""
    start, held = 0, 0
    for i, b in enumerate(bodies):
        if held + len(b) > limit and i > start:
            yield start, i
            start, held = i, 0
        held += len(b)
    if start < len(bodies):
        yield start, len(bodies)


def presence(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, feature) pairs."""
    docs, feats = features(bodies)
    pairs = np.unique(docs.astype(np.int64) << FEATURE_BITS | feats.astype(np.int64))
    return (pairs >> FEATURE_BITS).astype(np.int64), (pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int64)


class Classifier:
    """Logistic model over the presence of selected features."""

    def __init__(self, selected: np.ndarray, weights: np.ndarray, bias: float):
        self.place = np.full(1 << FEATURE_BITS, -1, dtype=np.int32)
        self.place[selected] = np.arange(len(selected))
        self.weights, self.bias = weights, bias

    def score(self, bodies: list[bytes]) -> np.ndarray:
        out = np.full(len(bodies), self.bias)
        for a, b in slices(bodies):
            docs, feats = features(bodies[a:b])
            at = self.place[feats]
            hit = at >= 0
            pairs = np.unique(docs[hit].astype(np.int64) * len(self.weights) + at[hit])
            np.add.at(out, a + pairs // max(1, len(self.weights)), self.weights[pairs % max(1, len(self.weights))])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(sample: DataFrame, model) -> Classifier:
    """Classifier from rows ``body, toxic``: features are chosen by a two-share z test, then weighted by ridge logistic regression."""

    def tally(batches):
        cache: dict[bytes, bytes] = {}
        size = 1 << FEATURE_BITS
        seen, toxic, n, n_toxic = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
        for batch in batches:
            bodies = [restore_text(b, model.value, cache) for b in texts(batch.column(0))]
            labels = np.array(batch.column(1).to_pylist())
            for a, b in slices(bodies):
                docs, feats = presence(bodies[a:b])
                seen += np.bincount(feats, minlength=size)
                toxic += np.bincount(feats[labels[a:b][docs] == 1], minlength=size)
            n, n_toxic = n + len(labels), n_toxic + int(labels.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *seen[at]], pa.int64()), pa.array([n_toxic, *toxic[at]], pa.int64())], names=["feature", "n", "n_toxic"])

    counts = sample.mapInArrow(tally, "feature int, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    totals = {r.feature: r for r in counts.filter("feature = -1").collect()}
    n, pos = (totals[-1].n, totals[-1].n_toxic) if totals else (0, 0)
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not pos or pos == n:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), prior)
    expected = F.col("n") * (pos / n)
    z = (F.col("n_toxic") - expected) / F.sqrt(expected * (1 - pos / n) * (1 - F.col("n") / F.lit(float(n + 1))) + 0.5)
    best = counts.filter("feature >= 0 and n >= 3").withColumn("z", z).filter(F.abs("z") > 4.5).orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES)
    selected = np.array(sorted(r.feature for r in best.select("feature").collect()), dtype=np.int64)
    if not len(selected):
        return Classifier(selected, np.zeros(0), prior)
    place = np.full(1 << FEATURE_BITS, -1, dtype=np.int32)
    place[selected] = np.arange(len(selected))

    def rows(batches):
        cache: dict[bytes, bytes] = {}
        for batch in batches:
            bodies = [restore_text(b, model.value, cache) for b in texts(batch.column(0))]
            for a, b in slices(bodies):
                docs, feats = presence(bodies[a:b])
                at = place[feats]
                lists: list[list[int]] = [[] for _ in range(b - a)]
                for d, f in zip(docs[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
                    lists[d].append(f)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1).slice(a, b - a)], names=["features", "toxic"])

    fetched = sample.mapInArrow(rows, "features array<int>, toxic int").collect()  # MAX_LABELLED rows at most
    lists, y = [r.features for r in fetched], np.array([r.toxic for r in fetched], dtype=float)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.array([f for x in lists for f in x], dtype=np.int64)
    order = np.lexsort((col, row))
    return Classifier(selected, *_logistic(row[order], col[order], y, len(selected), prior))


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, size: int, prior: float, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the ridge-penalized log loss; no randomness, so fits agree."""
    w, bias = np.zeros(size), prior
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[col], minlength=len(y))
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([(np.bincount(col, weights=gap[row], minlength=size) + ridge * w) / len(y), [gap.mean()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is likelier toxic) and ``restored`` (characters changed by restoring).

    Labels are learned only from rows whose crc32(id) mod 5 is not 0; only the text is an input of the score. Null and
    empty texts get the score of the bias. Labels that are null or not 0 or 1 are dropped before fitting; of repeated
    label rows, and of rows of the corpus that repeat a labelled id, the smallest label and text count, so that
    :data:`MAX_LABELLED` rows are fitted at most. Without both labels every score is the share of toxic rows.
    ``corpus`` is what the character model is counted over (``docs`` unless given).
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    spark = docs.sparkSession
    corpus = docs if corpus is None else corpus
    model = spark.sparkContext.broadcast(CharModel(char_counts(corpus, text_col)))
    usable = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("toxic"))
    chosen = usable.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(MAX_LABELLED)
    picked = materialize(chosen.select(F.col(id_col).alias("_id"), "toxic"), "toxic-ids")
    bodies = corpus.select(F.col(id_col).alias("_id"), null_safe_text(text_col).alias("body"))
    sample = bodies.join(F.broadcast(picked), "_id").groupBy("_id", "toxic").agg(F.min("body").cast("binary").alias("body")).select("body", "toxic")
    classifier = spark.sparkContext.broadcast(fit(materialize(sample, "toxic-sample"), model))

    def score(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        cache: dict[bytes, bytes] = {}
        bodies = texts(batch.column(batch.schema.get_field_index(text_col)))
        restored = [restore_text(b, model.value, cache) for b in bodies]
        return {"score": pa.array(classifier.value.score(restored), pa.float64()), "restored": pa.array([a != b for a, b in zip(bodies, restored, strict=True)], pa.bool_())}

    return append_columns(docs, text_col, score, "score double, restored boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), id_col, text_col) if {"score", "restored"} & set(docs.columns) else docs
    scored = score_toxicity(packed, labels, id_col, text_col).filter(F.col("score") < 0.5)
    return scored.select(*docs.columns) if packed is docs else scored.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
