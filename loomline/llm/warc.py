"""WARC archives: a writer for text payloads and a reader that salvages damaged files.

The reader takes a file as a run of WARC records, plain or in gzip members. A
record passes when its version line, headers (folded ones too), length, trailer
and digests hold. Digests are checked by the algorithm they name, in base32 or
hexadecimal; one of an algorithm that isn't at hand is not. The payload is the
block, or, of HTTP messages, the body; revisits name the payload of another
record, so theirs is not checked. After a failed check it searches onward from the
byte after the failed start for the next version line or gzip member that passes,
goes on there, and reports the bytes between as a quarantined gap with the reason.
Nothing else of a file is lost to a damaged record.

A gzip member is inflated in steps. What came out before an error is read as any
other content, so a file that is one damaged member gives the records before the
damage; its rest is a gap from the last byte that could be inflated. Gaps inside a
member have their place in the member's content, besides the member's own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import materialise, no_text_as_empty, scratch_path

MEMBER = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/[0-9]\.[0-9]\r\n|\x1f\x8b\x08")
VERSION = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")

STEP = 1 << 16
#: Bytes of content that are inflated of one member; what is beyond is a gap.
MEMBER_BYTES = 1 << 30
#: Digits of the largest length that is taken for one.
DIGITS = 18

RECORDS = "archive string, start long, length long, inner_start long, inner_length long, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, full_length long, payload binary"


@dataclass
class Found:
    """A record at [start, end) of its file, or, with a gap reason, bytes set aside; inner: the place in a member's content."""

    start: int
    end: int
    gap: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    inner: tuple[int, int] | None = None

    @property
    def full_length(self) -> int | None:
        """As stated for revisits, else that of the payload."""
        if self.gap is not None:
            return None
        stated = self.headers.get("x-full-payload-length", "")
        return int(stated) if _is_length(stated) else len(self.payload or b"")


def _is_length(text: str) -> bool:
    return text.isascii() and text.isdigit() and len(text) <= DIGITS


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digest_holds(stated: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` is that of the data; true for an unknown algorithm."""
    algorithm, colon, value = stated.partition(":")
    name = algorithm.strip().lower().replace("-", "")
    if not colon or name not in hashlib.algorithms_available or name.startswith("shake"):
        return bool(colon)
    found = hashlib.new(name, data, usedforsecurity=False).digest()
    value = value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _http_body(block: bytes) -> bytes | None:
    """The body of an HTTP message as it stands; null where it is transfer-encoded, which changes what its digest covers."""
    head, blank, body = block.partition(b"\r\n\r\n")
    return None if not blank or b"\ntransfer-encoding:" in head.lower() else body


def _record(data: bytes, at: int) -> Found | str:
    """The record at a place of uncompressed data, or why there is none."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    headers, line, name = {}, version.end(), None
    while (line_end := data.find(b"\r\n", line)) != line:
        if line_end < 0:
            return "headers do not end"
        if data[line] in b" \t" and name is not None:  # a folded line goes on with the one before
            headers[name] = f"{headers[name]} {data[line:line_end].decode('utf-8', 'replace').strip()}".strip()
        else:
            field_name, colon, value = data[line:line_end].partition(b":")
            if not colon:
                return "malformed header"
            name = field_name.decode("utf-8", "replace").strip().lower()
            headers[name] = value.decode("utf-8", "replace").strip()
        line = line_end + 2
    length = headers.get("content-length", "")
    if not _is_length(length):
        return "no content length"
    body = line + 2
    end = body + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "truncated" if end + 4 > len(data) else "no trailer at the stated length"
    block = data[body:end]
    if "warc-block-digest" in headers and not _digest_holds(headers["warc-block-digest"], block):
        return "block digest differs"
    if "warc-type" not in headers:
        return "no record type"
    if "warc-payload-digest" in headers and headers["warc-type"] != "revisit" and "warc-segment-number" not in headers:
        http = headers.get("content-type", "").lower().startswith("application/http")
        payload = _http_body(block) if http else block
        if payload is not None and not _digest_holds(headers["warc-payload-digest"], payload):
            return "payload digest differs"
    return Found(at, end + 4, headers=headers, payload=block)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at a place, where it ends in the file, and what cut it short.

    Of a damaged member: what came out before the error, and the byte after the
    last one that was taken in.
    """
    engine, out, pos = zlib.decompressobj(31), [], at
    step, size = STEP, 0
    while not engine.eof and pos < len(data):
        if size > MEMBER_BYTES:
            return b"".join(out), pos, "member too large"
        before = engine.copy()
        try:
            out.append(engine.decompress(data[pos : pos + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), pos, "corrupt member"
            engine, step = before, max(1, step // 16)  # the same bytes again, in shorter steps
            continue
        pos = min(pos + step, len(data)) - len(engine.unused_data)
        size += len(out[-1])
    return b"".join(out), pos, None if engine.eof else "truncated member"


def _at(data: bytes, at: int) -> tuple[list[Found], int, str | None]:
    """The records that begin at a place (one, or those of a gzip member), where they end, and, if there is none or the rest is lost, why."""
    if not data.startswith(MEMBER, at):
        found = _record(data, at)
        return ([], at, found) if isinstance(found, str) else ([found], found.end, None)
    content, end, why = _inflate(data, at)
    inside = list(salvage(content, nested=True))
    if not any(x.gap is None for x in inside):
        return [], at, why or "member without a record"
    return [Found(at, end, x.gap and f"in member: {x.gap}", x.headers, x.payload, (x.start, x.end)) for x in inside], end, why


def salvage(data: bytes, nested: bool = False) -> Iterator[Found]:
    """Every record of a file in order, and the gaps between them."""
    at, bad, why = 0, None, ""
    while at < len(data):
        found, end, wrong = _at(data, at) if not (nested and data.startswith(MEMBER, at)) else ([], at, "nested member")
        if found and bad is not None:
            yield Found(bad, at, why)
            bad = None
        yield from found
        if wrong is None:
            at = end
            continue
        if bad is None:
            bad, why = end, wrong
        following = START.search(data, max(end, at + 1))
        at = following.start() if following else len(data)
    if bad is not None:  # of no bytes where a member only lacks its end
        yield Found(bad, len(data), why)


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, as .warc.gz files hold it."""
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(record) + engine.flush()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the archives under a path; a gap row has its reason in ``gap`` and null in the record's columns.

    start and length are the place in the file, for what a gzip member holds that of
    the member (or of what could be inflated of it), and inner_start and inner_length
    the place in the member's content. Lengths that are no number of at most 18
    digits count as missing. Of a member no more than MEMBER_BYTES are inflated.
    Empty files give no rows, an empty folder none. Headers a record lacks are
    null, repeated ones count once, the last; records that repeat each give a row.
    A file is one task's work, so writers bound its size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), *((n, pa.int64()) for n in ("start", "length", "inner_start", "inner_length")), *((n, pa.string()) for n in ("gap", "record_type", "record_id", "target_uri", "refers_to", "payload_digest")), ("full_length", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                out, size = [], 0
                for x in salvage(content.as_py() or b""):
                    h = x.headers.get
                    begin, end = x.inner or (None, None)
                    out.append((archive.as_py(), x.start, x.end - x.start, begin, None if end is None else end - begin, x.gap, h("warc-type"), h("warc-record-id"), h("warc-target-uri"), h("warc-refers-to"), h("warc-payload-digest"), x.full_length, x.payload))
                    size += len(x.payload or b"")
                    if size > 4 << 20 or len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, RECORDS)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1, in SQL functions: 40 bits are eight digits."""
    chunks = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from_bytes: int = 0, file_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 200_000
) -> None:
    """Write one WARC record per row to files of about ``file_bytes`` under a path of any file system Spark writes to.

    Of records with equal payloads of at least ``revisit_from_bytes`` bytes, the
    one with the largest id is a response and the others revisit it; smaller
    ones are all responses. Rows that tie on the largest id are all responses, a
    null id is below every other. A null payload is empty. A null URL leaves out
    its header; control characters and spaces in one are percent-encoded.
    Payloads are text of any length, written as UTF-8. Rows that repeat each give
    a record, an empty table none; other columns aren't read.
    """
    payload = no_text_as_empty(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha"))
    narrow = rows.select("id", "sha", "bytes")
    sizes = narrow.agg(F.avg("bytes").alias("mean"))
    originals = narrow.where(F.col("bytes") >= revisit_from_bytes).groupBy("sha").agg(F.max("id").alias("original"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    originals = materialise(originals, "originals")
    mean = sizes.first()["mean"] or 0
    # each row of originals is under 64 bytes: within the bound they are sent to every executor, beyond it both sides are shuffled
    small = originals.count() <= broadcast_rows
    rows = rows.join(F.broadcast(originals) if small else originals, "sha", "left")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    block = F.when(revisit, "").otherwise(F.col("payload"))
    url = F.col("url")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.when(F.col("url").rlike("[\\x00-\\x20\\x7F]"), url).otherwise(F.col("url"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.concat(F.lit("WARC-Payload-Digest: "), digest),
            F.concat(F.lit("WARC-Block-Digest: "), F.when(revisit, F.lit("sha1:" + sha1_base32(b""))).otherwise(digest)),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("original")))),
            F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.lit("Content-Type: text/html; charset=utf-8"),
            F.concat(F.lit("X-Full-Payload-Length: "), F.col("bytes").cast("string")),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r"),  # the writer's line end completes the trailer
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 600)))).text(path)


def archive_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read those back: one row per record, or per gap (none, unless a file was damaged).

    Null payloads count as empty, empty ones are alike as any others; null ids,
    repeated rows and ties are as ``write_archives`` has them, payloads and URLs of
    any length are kept whole. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col, revisit_from_bytes=revisit_from_bytes)
    return read_archives(spark, path)


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
