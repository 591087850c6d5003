"""Token alignment, line de-duplication and the divergence audit on odd inputs and against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from factloom.llm import divergence, line_dedup, warc
from factloom.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, lang string, source string, chunk string, pair long, rank int"
RNG = random.Random(7)


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, "clash", 7, 1)


def said(n):
    return " ".join(RNG.choice(["the", "Token", "isation", "züge", "1234", "e.g.", "naïve", "▁", "x" * 30, "  ", "\t", "日本"]) for _ in range(n))


ODD = [
    row(3, "Same line of text here\nshort\n\tSAME LINE OF TEXT HERE \n"),
    row(1, "same line of text here\nanother line, also repeated\nshort"),
    row(1, "same line of text here\nanother line, also repeated\nshort"),
    row(2, None, None, None),
    row(4, "", "en", ""),
    row(None, "another line, also repeated\nno id, a line of its own"),
    row(None, "another line, also repeated\nÄNOTHER line, of letters"),
    row(5, "änother line, of letters\n" + "another line, also repeated\n" * 200, "de", "s3"),
    row(6, "no end <|endoftext|> </s> <0x0A>▁ 　 ok", "de", "s4"),
    row(7, "trailing  \n\n" + "a" * 5000, "de", "s4"),
    *[row(100 + k, said(60) + "\n" + said(5) + "\n" + said(3), RNG.choice(["en", "de", ""]), f"s{RNG.randrange(4)}") for k in range(40)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_sql(sql):
    import pandas as pd

    documents = pd.DataFrame([r[:4] for r in ODD], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841  read by name
    found = duckdb.sql(sql)
    names = sorted(found.columns)
    return names, sorted(repr(r) for r in found.project(", ".join(names)).fetchall())


def rows_of(df, names):
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_lines_against_sql(odd, empty, monkeypatch):
    names, expected = by_sql(line_dedup.ORACLE)
    digest = lambda: line_dedup.dedup_lines(odd).withColumn("kept_sha256", F.sha2("kept_text", 256))
    assert rows_of(digest(), names) == expected
    # with frequent keys judged in place
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 1)
    monkeypatch.setattr(line_dedup, "RANGE_LINES", 20)
    assert rows_of(digest(), names) == expected
    assert line_dedup.dedup_lines(empty).count() == 0


def test_bitmap_has_the_lines(odd):
    got = line_dedup.dedup_lines(odd).filter("doc_id = 5").withColumn("at", line_dedup.positions(F.col("dropped"))).first()
    assert got.at == list(range(1, 201)) and got.n_lines == 202 and got.kept_text == "änother line, of letters\n"
    assert len(got.dropped) == 4


def test_divergence_against_sql(odd, empty):
    names, expected = by_sql(divergence.ORACLE)
    assert rows_of(divergence.audit(odd), names) == expected
    assert divergence.audit(empty).count() == 0


def test_paths_against_pairs():
    """The walk over sorted paths gives what all pairs of each row give, with settling at any time and with large numbers."""
    rng, gap = random.Random(2), lambda p, q: (p - q) ** 2 // q
    for most in (50, 10**9):
        share = {(s, n): 1 + most * (n + 1) // 997 for s in range(6) for n in range(5)}
        rows = Counter(tuple((f"s{s}", n) for s in range(6) if (n := rng.randrange(4))) for _ in range(300))
        expected, tree = Counter(), divergence.Paths()
        p = lambda x: share[int(x[0][1:]), x[1]]
        for path, times in sorted(rows.items()):
            if path:
                tree.add("en", list(path), [(p(x), share[int(x[0][1:]), 0]) for x in path], times)
            if rng.random() < 0.1:
                tree._settle()
            for x in path:
                for y in path:
                    if x != y:
                        x0, y0 = share[int(x[0][1:]), 0], share[int(y[0][1:]), 0]
                        expected["en", x[0], y[0]] += times * (gap(p(x), p(y)) - gap(p(x), y0) - gap(x0, p(y)) + gap(x0, y0))
        tree.close()
        assert {k: v for k, v in tree.sums.items() if v} == {k: v for k, v in expected.items() if v}


def brute_alignment(texts):
    first = tokenizers.Tokenizer.from_file(f"{ta.FOLDER}/{ta.BYTE_LEVEL}")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/{ta.PIECES}")
    pair, held, counts = ta.pair_of(ta.FOLDER), [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        ends = []
        for ids, known in ((a, pair.bytes_a), (b, pair.bytes_b)):
            ends.append(np.cumsum([len(known[i]) for i in ids]).tolist())
            if text and b"".join(known[i] for i in ids) != (" " + text).encode():
                a = []
        if not a:
            b, ends = [], [[], []]
        groups, at = [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            upto = (ends[0].index(end) + 1, ends[1].index(end) + 1)
            groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
            at = upto
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(links.keys())
        held.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    name = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return [(na, nb, len(g), sum(k.values()), sum(n for p, n in k.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in k.items()), hashlib.sha256(name(g).encode()).hexdigest() if g else "", name(g)) for na, nb, g, k in held]


def test_alignment_against_brute_force(odd, empty, monkeypatch):
    expected = sorted((repr(r[0]), *x) for r, x in zip(ODD, brute_alignment([r[1] or "" for r in ODD]), strict=True))
    plain = sorted((repr(r[0]), *r[1:]) for r in ta.align_tokens(odd, with_groups=True).collect())
    assert plain == expected and ta.align_tokens(empty).count() == 0
    # many chunks and pieces, every group of several tokens handled as a wide one
    for name, value in (("CHUNK_BYTES", 2000), ("PIECE_BYTES", 300), ("WIDE_GROUP", 2)):
        monkeypatch.setattr(ta, name, value)
    pair = ta.pair_of(ta.FOLDER)
    batches = list(ta._chunk_rows(pair, [r[0] for r in ODD], [(r[1] or "").encode() for r in ODD], True))
    counts = dict(zip(batches[1].column("pair").to_pylist(), batches[1].column("n_docs").to_pylist(), strict=True))
    known, sums = sorted(counts), []
    for at, times in zip(batches[0].column("at").to_pylist(), batches[0].column("times").to_pylist(), strict=True):
        sums.append(sum(int(n) * counts[known[k]] for k, n in zip(np.cumsum(ta.unpack(at)), ta.unpack(times), strict=True)))
    assert sorted(sums) == sorted(x[6] for x in expected)


def test_runs_against_sets():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.randrange(1, 200)
        a, b = (sorted({size, *rng.sample(range(1, size + 1), rng.randrange(0, size))}) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({*b, *a[: len(a) // 2]})
        last_a, last_b = ta.group_ends(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert [a[i] for i in last_a] == common == [b[j] for j in last_b]


def test_words_are_split_as_the_tokenizer_merges():
    pair = ta.pair_of(ta.FOLDER)
    for text in (" a", "a  b", "  ", "a ", "\n x", "ab  c   d", "y" * 200 + "  z", said(300)):
        a, b = pair.encode([text.encode()])
        whole = pair.second.encode(text)
        lossless = b"".join(pair.bytes_b[i] for i in whole) == b" " + text.encode()
        assert b[0].tolist() == (whole if lossless else []) and bool(len(a[0])) == lossless
    assert pair.encode([b"\xff bad"])[0][0].tolist() == []


def test_salvage_grows_in_proportion():
    """Damaged bytes of every kind that starts a search: each part of them is searched once."""
    import time

    payload = b"<html>kept</html>"
    good = warc.record(1, "http://a", payload, warc.base32_sha1(payload), len(payload), None, False) + b"\n"
    for unit in (b"WARC/1.1\r\n", b"\x1f\x8b\x08 no member ", b"WARC/1.0\r\nContent-Length: 5\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"):
        junk = unit * ((4 << 20) // len(unit))
        for tail in (b"", b"\r\n\r\n"):
            began = time.time()
            found = list(warc.salvage(good + junk + tail + good))
            assert time.time() - began < 30
            assert [x[2]["payload"] for x in found if x[2]] == [payload] * 2
            assert [(a, b) for a, b, r, _ in found if r is None] == [(len(good), len(good + junk + tail))]


def test_damaged_archives_of_equal_payloads(spark, tmp_path):
    """Revisits and responses behind a damaged record are read, and the gap is logged with its bytes."""
    pages = spark.createDataFrame([(k, f"http://{k}", "same" if k % 3 else f"own {k}") for k in range(1, 40)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_warc(pages, path)
    whole = {(r.record_id, r.record_type) for r in warc.read_warc(spark, path).collect()}
    assert sum(kind == "revisit" for _, kind in whole) == 25
    name = max((p for p in (tmp_path / "archive").rglob("part-*") if p.suffix != ".crc"), key=lambda p: p.stat().st_size)
    data = bytearray(name.read_bytes())
    at = data.index(b"Content-Length", len(data) // 2)
    data[at : at + 14] = b"Content-Lxngth"
    name.write_bytes(bytes(data))
    crc = name.with_name(f".{name.name}.crc")
    crc.unlink(missing_ok=True)
    rows = warc.read_warc(spark, str(tmp_path / "archive")).collect()
    gaps = [r for r in rows if r.gap is not None]
    assert len(gaps) == 1 and gaps[0].end > gaps[0].start
    assert len({(r.record_id, r.record_type) for r in rows if r.gap is None}) == len(whole) - 1
