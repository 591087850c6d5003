"""Secret scans by grammar inference.

Labelled credentials are the values that the three base patterns find, up to :data:`SAMPLE_PER_KIND` of each kind,
chosen by hash over all documents. For each kind a prefix tree of character classes is built and states whose
outgoing frequencies are statistically compatible (Hoeffding bound) are merged into a probabilistic automaton. Every
token of every text that is as long as the shortest labelled credentials is then scored by its likelihood under the
automata against a background model of ordinary tokens; tokens that a credential format explains much better are
reported beside the base spans.

The background is a character bigram model counted over all texts outside base spans; each task sends its own table's
non-zero cells, which are summed by cell.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, materialize, null_safe_text, read, require
from .toxicity import slices

#: Labelled credentials of a kind that its automaton is learned from, at most.
SAMPLE_PER_KIND = 500
#: Significance of the compatibility test; bits per character, and bits of the whole token, by which a format must beat
#: the background, so that short tokens need more bits per character.
ALPHA = 0.05
MARGIN_BITS = 0.75
TOKEN_BITS = 15.0
MIN_TOKEN = 6

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, value start, value end) of the base patterns' matches, by start and kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def symbol(c: str) -> str:
    """Character class: hex digit letters and other letters apart, by case; punctuation stands for itself."""
    if c.isdigit():
        return "9"
    if "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "x"
    if "A" <= c <= "F":
        return "H"
    if "G" <= c <= "Z":
        return "X"
    return c


class Automaton:
    """Probabilistic automaton: state -> symbol -> (next state, count), with end counts."""

    SYMBOLS = 14

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.moves: list[dict[str, int]] = [{}]
        self.counts: list[Counter] = [Counter()]
        for w in words:
            self._add([symbol(c) for c in w])
        self._merge(alpha)
        self.seal()

    def _add(self, symbols: list[str]) -> None:
        state = 0
        for s in symbols:
            self.counts[state][s] += 1
            if s not in self.moves[state]:
                self.moves[state][s] = len(self.moves)
                self.moves.append({})
                self.counts.append(Counter())
            state = self.moves[state][s]
        self.counts[state][""] += 1

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding test of all outgoing shares of two states, and of the states that both reach."""
        stack, seen = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if (a, b) in seen or a == b:
                continue
            seen.add((a, b))
            na, nb = self.counts[a].total(), self.counts[b].total()
            if na and nb:
                bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
                if any(abs(self.counts[a][s] / na - self.counts[b][s] / nb) > bound for s in {*self.counts[a], *self.counts[b]}):
                    return False
            stack.extend((self.moves[a][s], self.moves[b][s]) for s in self.moves[a].keys() & self.moves[b].keys())
        return True

    def _fold(self, into: int, other: int) -> None:
        """Add a subtree's counts and moves to a state."""
        stack = [(into, other)]
        while stack:
            into, other = stack.pop()
            if into == other:
                continue
            self.counts[into].update(self.counts[other])
            for s, target in self.moves[other].items():
                if s in self.moves[into]:
                    stack.append((self.moves[into][s], target))
                else:
                    self.moves[into][s] = target

    def _merge(self, alpha: float) -> None:
        red = [0]
        while True:
            frontier = next(((r, s, t) for r in red for s, t in sorted(self.moves[r].items()) if t not in red), None)
            if frontier is None:
                break
            state, s, target = frontier
            like = next((r for r in red if self._compatible(r, target, alpha)), None)
            if like is None:
                red.append(target)
            else:
                self.moves[state][s] = like
                self._fold(like, target)
        number = {r: i for i, r in enumerate(red)}
        self.moves = [{s: number[t] for s, t in self.moves[r].items()} for r in red]
        self.counts = [self.counts[r] for r in red]

    def seal(self) -> None:
        """Turn counts into bits per symbol, smoothed at each state; the counts are dropped."""
        self.bits_of = []
        for counts in self.counts:
            n = counts.total() + 0.1 * self.SYMBOLS
            self.bits_of.append(({s: -math.log2((c + 0.1) / n) for s, c in counts.items()}, -math.log2(0.1 / n)))
        self.counts = []

    def bits(self, word: str) -> float:
        """Mean negative log2 likelihood per character; a move that was never seen starts over."""
        state, total = 0, 0.0
        for c in word:
            s = symbol(c)
            known, unknown = self.bits_of[state]
            total += known.get(s, unknown)
            state = self.moves[state].get(s, 0)
        return total / max(1, len(word))


# Characters of the background: those of credentials, numbered from 1, and all else (the edge), 0.
EDGE = 0
_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
N_CODES = len(_LETTERS) + 1
_CODE = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(_LETTERS):
    _CODE[ord(_c)] = _i + 1
_CLASSES = Counter(symbol(c) for c in _LETTERS)
#: Bits of a character within its class, where all of the class are equally likely; the automata leave them out.
_WITHIN = np.array([0.0] + [math.log2(_CLASSES[symbol(c)]) for c in _LETTERS])


class Background:
    """Character bigrams of ordinary text; counts[a, b], flattened.

    Every pair counts one time less than it occurs, so that a rare token is not explained by its own occurrence.
    """

    def __init__(self, counts: np.ndarray):
        pairs = np.maximum(counts.reshape(N_CODES, N_CODES) - 1.0, 0.0)
        single = pairs.sum(0)
        p1 = (single + 1) / (single.sum() + N_CODES)
        p2 = (pairs + 8 * p1) / (pairs.sum(1, keepdims=True) + 8)
        #: bits of a character after another, less those within its class, so that they compare with an automaton's
        self.cost = -np.log2(p2) - _WITHIN

    def candidates(self, joined: bytes) -> list[tuple[int, int, float]]:
        """(start, end, bits) of the tokens whose bits would pass if a format explained them for nothing.

        Tokens are the whole runs of credential characters with :data:`MIN_TOKEN` of them or more. No automaton gives
        less than 0 bits, so none that could pass is left out.
        """
        codes = _CODE[np.frombuffer(joined, dtype=np.uint8)]
        inside = codes != EDGE
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        total = np.concatenate([[0.0], np.cumsum(np.where(inside, self.cost[np.concatenate([[EDGE], codes[:-1]]), codes], 0.0))])
        bits = total[ends] - total[starts]
        held = np.flatnonzero((ends - starts >= MIN_TOKEN) & (bits >= needed(ends - starts) - 1e-6))
        return list(zip(starts[held].tolist(), ends[held].tolist(), bits[held].tolist(), strict=True))


def needed(length):
    """Bits by which a format must beat the background over a token of this length."""
    return np.maximum(MARGIN_BITS * length, TOKEN_BITS)


def blanked(text: str, spans: list[tuple[int, int, int, int, int]]) -> bytes:
    """The text as UTF-8 with its base spans (which are ASCII) overwritten by spaces."""
    parts, at = [], 0
    for start, _, end, _, _ in spans:
        if end > at:
            parts += [text[at:start], " " * (end - max(at, start))]
            at = end
    return "".join([*parts, text[at:]]).encode()


def learn(docs: DataFrame, text_col: str) -> tuple[dict[str, list[str]], Background]:
    """Values of each kind, the SAMPLE_PER_KIND with the smallest hashes, and the background of all texts."""

    def values(batches):
        total = np.zeros(N_CODES**2, dtype=np.int64)
        for batch in batches:
            kinds, found = [], []
            for start in range(0, batch.num_rows, 256):
                bodies = []
                for text in batch.column(0).slice(start, 256).to_pylist():
                    spans = base_spans(text)
                    for _, k, _, a, b in spans:
                        kinds.append(KINDS[k])
                        found.append(text[a:b])
                    bodies.append(blanked(text, spans))
                codes = _CODE[np.frombuffer(b"\n".join([b"", *bodies, b""]), dtype=np.uint8)].astype(np.int32)
                total += np.bincount(codes[:-1] * N_CODES + codes[1:], minlength=N_CODES**2)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(found, pa.string()), pa.array([0] * len(kinds), pa.int64())], names=["kind", "value", "n"])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(["cell"] * len(cells), pa.string()), pa.array([str(c) for c in cells], pa.string()), pa.array(total[cells], pa.int64())], names=["kind", "value", "n"])

    rows = docs.select(null_safe_text(text_col).alias("text")).mapInArrow(values, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    rows = materialize(rows, "secrets-labelled")
    out: dict[str, list[str]] = {}
    for kind in KINDS:
        top = rows.filter(F.col("kind") == kind).orderBy(F.md5("value"), "value").limit(SAMPLE_PER_KIND)
        out[kind] = [r.value for r in top.collect()]
    counts = np.zeros(N_CODES**2, dtype=np.int64)
    for r in rows.filter("kind = 'cell'").collect():  # as many rows as there are pairs of characters, 4,761 at most
        counts[int(r.value)] = r.n
    return out, Background(counts)


def scan_secrets(docs: DataFrame, text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end) in code points, end exclusive, by start and kind.

    Kinds are assign, access and hex (base patterns) and grammar (runs of 6 or more credential characters, cut at
    base spans, whose format likelihood beats ordinary tokens by :data:`MARGIN_BITS` bits a character and
    :data:`TOKEN_BITS` bits in all). Null text is empty. Automata are learned from ``corpus`` (``docs`` unless given); a kind with fewer
    than five credentials has none, and without any the base spans are all there is.
    """
    require(docs, text_col)
    sample, ordinary = learn(docs if corpus is None else corpus, text_col)
    formats = [Automaton(v) for v in sample.values() if len(v) >= 5]
    models = docs.sparkSession.sparkContext.broadcast((formats, ordinary))
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        automata, background = models.value
        found, bodies = [], []
        for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
            base = base_spans(text or "")
            found.append([(start, k, end) for start, k, end, _, _ in base])
            bodies.append(blanked(text or "", base))
        for first, last in slices(bodies) if automata else ():
            joined = b"\n".join([b"", *bodies[first:last], b""])
            at, seen, chars = -1, 0, 0  # document of the slice, bytes and its code points passed
            limits = np.cumsum([1] + [len(b) + 1 for b in bodies[first:last]]).tolist()
            for start, end, bits in background.candidates(joined):
                token = joined[start:end].decode()
                if bits - min(a.bits(token) for a in automata) * len(token) < needed(len(token)):
                    continue
                while limits[at + 1] <= start:
                    at, seen, chars = at + 1, limits[at + 1], 0
                chars, seen = chars + len(joined[seen:start].decode()), start
                found[first + at].append((chars, len(KINDS), chars + len(token)))
        out = [[{"kind": (*KINDS, "grammar")[k], "start": s, "end": e} for s, k, e in sorted(spans)] for spans in found]
        return {"secrets": pa.array(out, kind_of)}

    return append_columns(docs, text_col, scan, "secrets array<struct<kind:string,start:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs)
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(of(*KINDS)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
