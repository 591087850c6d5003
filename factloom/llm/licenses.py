"""License scans by ordered signature rules.

Several hundred regular expressions in order of priority, each gated by a keyword: a text is searched for the few
distinct keywords first, and only rules whose keyword occurs are run. Detections that lie within a detection of higher
priority, or of the same priority and greater length, are suppressed.

Rules see the text with every run of white space, and the comment mark that begins a line, folded to one space, so
phrases that wrap are whole; spans are mapped back to the text.

The base phrases are matched on words and always reported; rules add labels of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import append_columns, fold_words, read, require, texts

# Base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# License names of the SPDX list, with the words by which texts call them.
NAMED = {
    "afl": r"academic free licen[cs]e",
    "agpl": r"(?:gnu )?affero general public licen[cs]e",
    "apache": r"apache(?: software)? licen[cs]e",
    "apsl": r"apple public source licen[cs]e",
    "artistic": r"artistic licen[cs]e",
    "bsl": r"boost software licen[cs]e",
    "busl": r"business source licen[cs]e",
    "cddl": r"common development and distribution licen[cs]e",
    "cecill": r"cecill(?:-[bc])?(?: licen[cs]e)?",
    "cpl": r"common public licen[cs]e",
    "ecl": r"educational community licen[cs]e",
    "epl": r"eclipse public licen[cs]e",
    "eupl": r"european union public licen[cs]e",
    "gfdl": r"(?:gnu )?free documentation licen[cs]e",
    "gpl": r"gnu general public licen[cs]e",
    "ipl": r"ibm public licen[cs]e",
    "isc": r"isc licen[cs]e",
    "lgpl": r"(?:gnu )?(?:lesser|library) general public licen[cs]e",
    "lppl": r"latex project public licen[cs]e",
    "mit": r"(?:mit|expat|x11) licen[cs]e",
    "mpl": r"mozilla public licen[cs]e",
    "ms-pl": r"microsoft public licen[cs]e",
    "ms-rl": r"microsoft reciprocal licen[cs]e",
    "mulan": r"mulan (?:psl|permissive software licen[cs]e)",
    "odbl": r"open (?:data commons )?(?:open )?database licen[cs]e",
    "ofl": r"(?:sil )?open font licen[cs]e",
    "osl": r"open software licen[cs]e",
    "php": r"php licen[cs]e",
    "postgresql": r"postgresql licen[cs]e",
    "python": r"python software foundation licen[cs]e",
    "qpl": r"q public licen[cs]e",
    "ruby": r"ruby licen[cs]e",
    "sspl": r"server side public licen[cs]e",
    "upl": r"universal permissive licen[cs]e",
    "vim": r"vim licen[cs]e",
    "w3c": r"w3c software (?:notice and )?licen[cs]e",
    "wtfpl": r"do what the fuck you want to public licen[cs]e",
    "zlib": r"zlib(?:/libpng)? licen[cs]e",
    "zpl": r"zope public licen[cs]e",
}
# Versions in which the families above exist.
VERSIONS = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "agpl": "1.0 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 2.0",
    "bsl": "1.0", "busl": "1.1", "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1", "cpl": "1.0", "ecl": "1.0 2.0", "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "ipl": "1.0", "lgpl": "2.0 2.1 3.0", "lppl": "1.0 1.1 1.2 1.3",
    "mpl": "1.0 1.1 2.0", "mulan": "1.0 2.0", "odbl": "1.0", "ofl": "1.0 1.1", "osl": "1.0 1.1 2.0 2.1 3.0", "php": "3.0 3.01",
    "python": "2.0", "qpl": "1.0", "sspl": "1.0", "upl": "1.0", "zpl": "1.1 2.0 2.1",
}
# Creative Commons conditions and versions.
CC_CONDITIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "share-?\\s*alike", "nc": "non-?\\s*commercial", "nd": "no-?\\s*deriv(?:s|atives|ative works)"}
# Identifiers that stand alone, and sentences by which a license without a name is known.
TAGS = ("0BSD", "AAL", "Beerware", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "CC0-1.0", "curl", "FTL", "HPND", "ICU", "IJG", "ISC", "JSON", "libpng-2.0", "MIT", "MIT-0", "MS-PL", "MS-RL", "NCSA", "OpenSSL", "PDDL-1.0", "PostgreSQL", "Ruby", "Sleepycat", "TCL", "Unicode-DFS-2016", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "Xnet", "Zlib")
SENTENCES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software"),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy[^.]{0,200}without restriction[^.]{0,200}\.\s*the software is provided"),
    ("isc", "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd-3-clause", "neither the name", r"neither the names? of [^.]{1,120} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "bsd", r"\bbsd licen[cs]e\b"),
    ("bsd-2-clause", "bsd", r"\b(?:simplified bsd|bsd[- ]?2[- ]clause|2[- ]clause bsd)\b"),
    ("bsd-3-clause", "bsd", r"\b(?:new bsd|modified bsd|bsd[- ]?3[- ]clause|3[- ]clause bsd)\b"),
    ("bsd-4-clause", "bsd", r"\b(?:original bsd|bsd[- ]?4[- ]clause|4[- ]clause bsd)\b"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("lgpl", "free software foundation", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("agpl", "free software foundation", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e,? v(?:\.|ersion)? ?2\.0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"\b(?:placed in|dedicated to|released (?:in)?to) the public domain\b"),
    ("cc0-1.0", "cc0", r"\bcc0(?: 1\.0)?(?: universal)?\b"),
    ("beerware", "beer", r"buy me a beer in return"),
    ("proprietary", "all rights reserved", r"\ball rights reserved\b"),
    ("copyright", "copyright", r"\bcopyright (?:\(c\)|©)?\s*(?:19|20)\d\d\b"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    weight: float


def _rules() -> list[Rule]:
    """Tags (priority 4) before sentences and versioned names (3), links and long forms (2), bare names (1)."""
    rows: list[tuple[str, str, str, int, float]] = []
    for family, versions in VERSIONS.items():
        word = next(w for w in re.split(r"[^a-z0-9]+", re.sub(r"\(\?:[^)]*\)\??|\[[^\]]*\]", " ", NAMED[family])) if len(w) > 2)
        for v in versions.split():
            number = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "")
            tail = r"(?![\d.]*\d)"
            rows.append((f"{family}-{v}", word, rf"\b{NAMED[family]}(?:,| \()?\s*(?:version|v\.?)\s*{number}{tail}", 3, 0.95))
            rows.append((f"{family}-{v}", family, rf"\b{re.escape(family)}[- ]?v?{number}{tail}(?:\+|-only|-or-later| or later)?", 3, 0.9))
            rows.append((f"{family}-{v}", "spdx", rf"spdx-licen[cs]e-identifier:\s*{re.escape(family)}-{re.escape(v)}{tail}(?:-only|-or-later|\+)?", 4, 1.0))
        rows.append((family, word, rf"\b{NAMED[family]}", 1, 0.7))
    for family in NAMED.keys() - VERSIONS.keys():
        keyword = next(w for w in re.split(r"[^a-z0-9]+", NAMED[family].replace("(?:mit|expat|x11)", "licen")) if len(w) > 2)
        rows.append((family, keyword, rf"\b{NAMED[family]}", 1, 0.7))
    for condition in CC_CONDITIONS:
        short = condition.replace("-", r"[- ]")
        long = r"[\s,-]+".join(CC_WORDS[w] for w in condition.split("-"))
        for v in CC_VERSIONS:
            number = re.escape(v)
            rows.append((f"cc-{condition}-{v}", "cc", rf"\bcc[- ]{short}[- ]v?{number}\b", 3, 0.95))
            rows.append((f"cc-{condition}-{v}", "creativecommons", rf"creativecommons\.org/licenses/{condition}/{number}\b", 2, 0.95))
            rows.append((f"cc-{condition}-{v}", "creative commons", rf"\bcreative commons {long}(?:\s+licen[cs]e)?,?\s+(?:version\s+|v)?{number}\b", 2, 0.95))
            rows.append((f"cc-{condition}-{v}", "spdx", rf"spdx-licen[cs]e-identifier:\s*cc-{condition}-{number}\b", 4, 1.0))
        rows.append((f"cc-{condition}", "cc", rf"\bcc[- ]{short}\b", 1, 0.75))
        rows.append((f"cc-{condition}", "creative commons", rf"\bcreative commons {long}\b", 1, 0.75))
    for tag in TAGS:
        low = tag.lower()
        rows.append((low, "spdx", rf"spdx-licen[cs]e-identifier:\s*{re.escape(low)}(?![\w.-])", 4, 1.0))
    rows += [(label, keyword, pattern, 3 if " " in keyword else 2, 0.9 if label not in ("proprietary", "copyright", "public-domain") else 0.3) for label, keyword, pattern in SENTENCES]
    rows += [("licensed", "licensed under", r"\blicensed under (?:the )?[^\n.]{1,80}", 0, 0.4), ("licensed", "released under", r"\breleased under (?:the )?[^\n.]{1,80}", 0, 0.4)]
    rows.sort(key=lambda r: (-r[3], r[0], r[2]))
    return [Rule(label, keyword, re.compile(pattern, re.ASCII), priority, weight) for label, keyword, pattern, priority, weight in rows]


RULES = _rules()
_BY_KEYWORD: dict[str, list[Rule]] = {}
for _rule in RULES:
    _BY_KEYWORD.setdefault(_rule.keyword, []).append(_rule)
_PHRASES = [(b" " + phrase.encode() + b" ", label, len(phrase.split())) for phrase, label in BASE_PHRASES]
_PHRASE_HINTS = [(phrase.split()[-1].encode(), phrase.split()[0].encode()) for phrase, _ in BASE_PHRASES]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label, _ in _PHRASES:
        at, seen, blanks = joined.find(phrase), 0, 0
        while at >= 0:
            blanks, seen = blanks + joined.count(b" ", seen, at), at
            out.append((blanks, label))
            at = joined.find(phrase, at + 1)
    return sorted(out)


# What is folded to one space: white space, with the comment marks at the start of its lines.
_GAP = re.compile(r"[ \t\r\f\v]*(?:\n[ \t\r\f\v]*(?://+!?|/\*+|\*+(?!/)|#+|;+|--+|%+|>+|(?:dnl|rem)(?=\s))?[ \t\r\f\v]*)+|[ \t\r\f\v]{2,}|[\t\r\f\v]")


def fold_gaps(low: str) -> tuple[str, list[int], list[int]]:
    """The text with its gaps folded to one space, and for the end of each gap its place in the folded and in the given text."""
    parts, folded_at, given_at = [], [0], [0]
    last = size = 0
    for m in _GAP.finditer(low):
        parts.append(low[last : m.start()])
        parts.append(" ")
        size += m.start() - last + 1
        last = m.end()
        folded_at.append(size)
        given_at.append(last)
    parts.append(low[last:])
    return "".join(parts), folded_at, given_at


def detections(low: str) -> list[tuple[int, int, Rule]]:
    """Spans of the rules in a lower-cased text, without those inside a span of a rule that goes before."""
    low, folded_at, given_at = fold_gaps(low)

    def given(place: int) -> int:
        k = bisect_right(folded_at, place) - 1
        return given_at[k] + place - folded_at[k]

    found = [(m.start(), m.end(), rule) for keyword, rules in _BY_KEYWORD.items() if keyword in low for rule in rules for m in rule.pattern.finditer(low)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
    # the furthest end of the kept spans that start at or before a place: maxima over a binary indexed tree of the starts
    numbers = {start: k + 1 for k, start in enumerate(sorted({x[0] for x in found}))}
    furthest = [-1] * (len(numbers) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        k, reach = numbers[start], -1
        while k:
            reach, k = max(reach, furthest[k]), k & (k - 1)
        if reach < end:
            kept.append((start, end, rule))
            k = numbers[start]
            while k < len(furthest):
                furthest[k], k = max(furthest[k], end), k + (k & -k)
    # an end is the place after the last character, so that a gap after the span stays outside
    return sorted(((given(s), given(e - 1) + 1, rule) for s, e, rule in kept), key=lambda x: (x[0], x[1], x[2].label))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score, license_spans``.

    A-Z is lower-cased; null text is empty. ``score`` is the confidence that the text carries a license: one minus the
    product of (1 - weight) over the distinct labels' best rules, 0.7 for a base phrase.
    """
    require(docs, text_col)
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_spans array<struct<label:string,start:int,end:int>>"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out: list[tuple] = []
        for body in texts(batch.column(batch.schema.get_field_index(text_col))):
            words = fold_words(body)
            low = body.decode().translate(lower) if not body.isascii() else body.lower().decode()
            folded = low.encode() if not body.isascii() else body.lower()
            places = base_places(words) if any(a in folded and b in folded for a, b in _PHRASE_HINTS) else []
            spans = detections(low)
            best = {label: 0.7 for _, label in places}
            for _, _, rule in spans:
                best[rule.label] = max(best.get(rule.label, 0.0), rule.weight)
            left = 1.0
            for _, weight in sorted(best.items()):
                left *= 1 - weight
            starts = [p for p, _ in places]
            base = sorted({label for _, label in places})
            out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(best)), 1 - left if best else 0.0, [{"label": r.label, "start": s, "end": e} for s, e, r in spans]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]
        return {n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True) if out else ((),) * 8, kinds, strict=True)}

    return append_columns(docs, text_col, scan, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
