"""WARC archives: a writer, and a reader that salvages what is left of damaged ones.

The reader checks every record (version line, header, length, trailer, digest). When a check fails it searches for the
next gzip member or version line that can be read, goes on from there, and logs the bytes in between as a gap.

The writer goes through Spark's text sink, so archives reach any store that Spark does and a lost task leaves nothing
behind: a record is one row, and the line end that the sink adds is the last byte of the record's trailer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, require, shared_path

#: Records of one archive file by the size of their payloads: none of those files holds more than some 64 MB, but for
#: the payloads that are larger by themselves.
RECORDS_PER_FILE = ((32 << 10, 2_000), (1 << 20, 64), (1 << 62, 1))
WARC_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "file string, start long, end long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None, revisit: bool) -> bytes:
    """A response or revisit record without the last byte of its trailer."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest}>", f"WARC-Date: {WARC_DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Ahead:
    """The first place of something at or behind a position. Positions only grow, so each part of the data is searched once."""

    def __init__(self, size: int, search: Callable[[int], int]):
        self.size, self.search, self.found = size, search, -1

    def __call__(self, at: int) -> int:
        if self.found < at:
            place = self.search(at)
            self.found = place if place >= 0 else self.size
        return self.found


def _plain_record(data: bytes, at: int, blank: _Ahead) -> tuple[int, dict | str]:
    """(end, record) of the record that starts at ``at``, or (at, reason) if a check fails."""
    if not _VERSION.match(data, at):
        return at, "no version line"
    stop = blank(at)
    if stop >= len(data):
        return at, "header has no end"
    if _VERSION.search(data, at + 1, stop + 2):  # the nearest one ends the search
        return at, "malformed header line"
    fields: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        key = name.strip().lower().decode("latin-1")
        if not colon or not key or line.endswith((b"WARC/1.0", b"WARC/1.1")):
            return at, "malformed header line"
        if key in fields and key in ("warc-record-id", "content-length", "warc-type"):
            return at, "header runs into another"
        fields[key] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return at, "no content length"
    start, end = stop + 4, stop + 4 + int(length)
    if end + 4 > len(data):
        return at, "record is cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return at, "no record trailer"
    block = data[start:end]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        if not blank:
            return at, "no http header"
        size = int(told[1]) if told else len(payload)
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and digest and digest != base32_sha1(payload):
        return at, "payload digest differs"
    return end + 4, {
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest or None,
        "payload_bytes": size if kind == "revisit" else len(payload),
        "payload": None if kind == "revisit" else payload,
    }


def _member(data: bytes, at: int) -> tuple[int, bytes | None]:
    """(end, content) of the gzip member at ``at``; content is None if it can't be read whole."""
    inflate, pos, parts = zlib.decompressobj(wbits=31), at, []
    try:
        while not inflate.eof and pos < len(data):
            parts.append(inflate.decompress(data[pos : pos + 65536]))
            pos += min(65536, len(data) - pos)
    except zlib.error:
        return at, None
    return (pos - len(inflate.unused_data), b"".join(parts)) if inflate.eof else (at, None)


def salvage(data: bytes, nested: bool = False) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, gap reason) of all records and gaps of an archive, in order; a gap has no record."""
    at, gap_from, reason = 0, None, None
    blank = _Ahead(len(data), lambda k: data.find(b"\r\n\r\n", k))
    member = _Ahead(len(data), lambda k: -1 if nested else data.find(_MEMBER, k))

    def next_version(k: int) -> int:
        match = _VERSION.search(data, k)
        return match.start() if match else -1

    version = _Ahead(len(data), next_version)
    while at < len(data):
        found: list[tuple[int, int, dict | None, str | None]] = []
        end = at
        if not nested and data.startswith(_MEMBER, at):
            end, content = _member(data, at)
            if content is None:
                why = "gzip member is damaged"
            else:
                inner = list(salvage(content, nested=True))
                found = [(at, end, r, None if g is None else f"in member: {g}") for _, _, r, g in inner]
                why = None
        else:
            end, got = _plain_record(data, at, blank)
            why = got if isinstance(got, str) else None
            if why is None:
                found = [(at, end, got, None)]
        if why is None:
            if gap_from is not None:
                yield gap_from, at, None, reason
                gap_from = None
            yield from found
            at = end
            continue
        if gap_from is None:
            gap_from, reason = at, why
        at = min(version(at + 1), member(at + 1))
    if gap_from is not None:
        yield gap_from, len(data), None, reason


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_revisit: int = 0) -> None:
    """Archives of ``pages`` under ``path``, one record per row.

    Null bodies are empty payloads. Of payloads that are equal and have at least ``least_revisit`` bytes, the rows
    with the smallest id are responses and the others revisit them; null ids come last. Null urls are left out.
    """
    require(pages, id_col, url_col, body_col)
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    narrow = rows.select("page_id", "url", "sha", "size")
    firsts = narrow.filter(F.col("size") >= least_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = materialize(firsts.select("sha", "first"), "warc-firsts")
    revisits = materialize(narrow.join(firsts, "sha").filter(~F.col("page_id").eqNullSafe(F.col("first"))), "warc-revisits")
    gone = revisits.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha")).distinct()
    responses = rows.join(gone, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti")
    both = responses.withColumn("first", F.lit(None).cast("long")).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name)).to_pylist()
            out = []
            for page, url, body, sha, size, first in zip(column("page_id"), column("url"), column("payload"), column("sha"), column("size"), column("first"), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.append(record(page, url, body, digest, size, first, first is not None))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    largest, least = narrow.agg(F.max("size")).first()[0] or 0, -1
    for most, records in RECORDS_PER_FILE:
        # the bytes of a record that is no response count for nothing
        some = both.filter((F.length("payload") > least) & (F.length("payload") <= most) | F.col("payload").isNull() & F.lit(least < 0))
        archives = some.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
        archives.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)
        least = most
        if largest <= most:
            break


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives under ``path``; a gap has its reason in ``gap`` and only a file, start and end."""
    names = [f.strip().split(" ")[0] for f in READ_SCHEMA.split(",")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no in range(batch.num_rows):
                file, data = batch.column(0)[no].as_py(), batch.column(1)[no].as_py()
                rows, held = [], 0
                for start, end, got, gap in salvage(data or b""):
                    got = got or {}
                    rows.append((file, start, end, *(got.get(n) for n in names[3:9]), got.get("payload") if with_payload else None, gap))
                    held += end - start
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, READ_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path, with_payload=False).filter("gap is null")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1)
    return found.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]*):', 1) as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to").try_cast("long")).alias("refers_to"),
    )


_BASE32 = "array_to_string(list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS INT) >> (15 - 5 * CAST(j AS INT))) & 31 AS INT) + 1, 1)), lambda a, b: a || b)), '')"
ORACLE = f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
