"""WARC: a converter of legacy ARC archives.

ARC files are parsed by their version-specific header lines (version 1: URL, address, date, type, length; version 2 with
result code, checksum, location, offset and file name besides) and the declared lengths; each record becomes a WARC record
with synthesised identifier, timestamp, type and digests. Of records with equal payloads of MIN_REVISIT bytes or more the
one with the least page id is a response, the others revisit it (profile identical-payload-digest).

Archives are written and read by Spark's own writers and readers, WARC gzipped, in parts of about PART_BYTES before
compression, so that one part fits a task. Which record a payload refers to comes from a table of the digests that occur
more than once, summed map-side; Spark splits a hot digest's join to it.

Defined results: a null html is an empty payload; a null or blank url is written "about:blank", blanks and line ends in it
are percent-encoded; repeated rows with the least page id are all responses; rows without a page id revisit if a row with
an id has their payload, else they are responses; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.llm import shared

PART_BYTES = 8 << 20
MIN_REVISIT = 100
#: Pages have no date of their own: seconds after this day, by page id.
FIRST_DAY = datetime(2020, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What the header lines of the two ARC versions name.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string"


def arc_header(version: int, url: str, date: str, kind: str, length: int, code: int = 200, offset: int = 0, name: str = "-") -> str:
    """The header line of a record, without its line end."""
    if version == 1:
        return f"{url} 0.0.0.0 {date} {kind} {length}"
    return f"{url} 0.0.0.0 {date} {kind} {code} - - {offset} {name} {length}"


def arc_volume(version: int, name: str) -> str:
    """The version block that opens an ARC file."""
    block = f"{version} 0 doppel\n{ARC_FIELDS[version]}\n"
    return arc_header(version, f"filedesc://{name}", FIRST_DAY.strftime("%Y%m%d%H%M%S"), "text/plain", len(block), name=name) + "\n" + block


def arc_records(data: bytes) -> Iterator[tuple[int, str, str, str, bytes]]:
    """(version, url, 14-digit date, content type, block) of each record but version blocks. Lengths are trusted, separators are line ends."""
    at, version = 0, 1
    while at < len(data):
        if data[at] == 10:
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc://"):
            size = int(parts[-1])
            version = int(data[end + 1 : end + 1 + size].split(b" ", 1)[0])
        else:
            if len(parts) != len(ARC_FIELDS[version].split()):
                raise ValueError(f"{len(parts)} fields in a header line of ARC version {version}")
            size = int(parts[-1])
            yield version, parts[0], parts[2], parts[3], data[end + 1 : end + 1 + size]
        if end + 1 + size > len(data):
            raise ValueError("an ARC record is cut short")
        at = end + 1 + size


def split_http(block: bytes) -> tuple[str, bytes]:
    """HTTP header (with its empty line) and payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    return head.decode("utf-8") + "\r\n\r\n", body


def header_of(http: str, name: str) -> str | None:
    m = re.search(rf"(?mi)^{re.escape(name)}:[ \t]*([^\r\n]*)", http)
    return m[1].strip() if m and m[1].strip() else None


def iso(date: str) -> str:
    return datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{url}|{date}|{digest}'.encode()).hexdigest()[:32])}>"


def warc_record(page_id: int | None, url: str, date: str, http: str, payload: bytes, digest: str, refers: tuple[int, str, str] | None) -> bytes:
    """A response, or, given (page id, url, date) of the response with the same payload, a revisit."""
    block = http.encode() + (b"" if refers else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, date, digest)}", f"WARC-Date: {iso(date)}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers, digest)}", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {iso(refers[2])}", f"X-Refers-To-Page: {refers[0]}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(named fields, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8")
        if not head.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        size = int(header_of(head, "Content-Length"))
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block
        at = end + 8 + size


def _write(rows: DataFrame, path: str, compression: str) -> None:
    """Rows (line, part): a folder for each part, each task's files of their own. A line's own end is the separator after it."""
    rows.write.partitionBy("part").option("compression", compression).option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")


def _gunzip(data: bytes) -> bytes:
    """Gzipped archives, of one member or of many, unpacked; others as they are."""
    out = []
    if data[:2] != b"\x1f\x8b":
        return data
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def clean_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "about:blank"


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "none") -> None:
    """Legacy archives of the pages: parts of even number in version 1, of odd number in version 2."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), shared.whole_text(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = -1, PART_BYTES
        for b in batches:
            lines, parts = [], []
            for page, url, html in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
                opening = ""
                if size >= PART_BYTES:
                    part, size = part + 1, 0
                    opening = arc_volume(1 + part % 2, f"part-{part}.arc") + "\n"
                payload = html.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page: {'' if page is None else page}\r\n\r\n"
                date = (FIRST_DAY + timedelta(seconds=(page or 0) % (1 << 28))).strftime("%Y%m%d%H%M%S")
                line = arc_header(1 + part % 2, clean_url(url), date, "text/html", len(http.encode()) + len(payload), offset=size, name=f"part-{part}.arc")
                lines.append(f"{opening}{line}\n{http}{html}")
                parts.append(part)
                size += len(payload) + len(http) + len(line)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(parts, pa.int32())], names=["line", "part"])

    _write(rows.mapInArrow(shared.trimmed(run), "line string, part int"), path, compression)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC archives: page id, url, date, HTTP header, payload and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for _, url, date, _, block in arc_records(_gunzip(content.as_py())):
                    http, payload = split_http(block)
                    page = header_of(http, "X-Page")
                    rows.append((int(page) if page else None, url, date, http, payload, hashlib.sha256(payload).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "date", "http", "payload", "digest"])

    return _files(spark, path).mapInArrow(shared.trimmed(run), "page_id long, url string, date string, http string, payload binary, digest string")


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Reads ARC archives and writes the same records as WARC archives."""
    records = read_arc(spark, arc)
    # which digests occur more than once, and their first record: one row for each digest and task before the shuffle
    first = records.filter(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = shared.cut(first.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "first")
    joined = records.join(first, "digest", "left").select("page_id", "url", "date", "http", "payload", "digest", F.col("first.page_id").alias("f_page"), F.col("first.url").alias("f_url"), F.col("first.date").alias("f_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, 0
        for b in batches:
            lines, parts = [], []
            for page, url, date, http, payload, digest, f_page, f_url, f_date in zip(*(c.to_pylist() for c in b.columns), strict=True):
                refers = (f_page, f_url, f_date) if f_page is not None and page != f_page else None
                if size >= PART_BYTES:
                    part, size = part + 1, 0
                record = warc_record(page, url, date, http, payload, digest, refers)
                size += len(record)
                lines.append(record[:-1].decode("utf-8"))  # the writer ends each line with the last line feed
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(parts, pa.int32())], names=["line", "part"])

    _write(joined.mapInArrow(shared.trimmed(run), "line string, part int"), warc, "gzip")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC archives (columns of READ). A response's digest is computed anew and must equal the declared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in warc_records(_gunzip(content.as_py())):
                    if hashlib.sha256(block).hexdigest() != header_of(head, "WARC-Block-Digest").removeprefix("sha256:"):
                        raise ValueError("a block doesn't match its digest")
                    http, payload = split_http(block)
                    kind, digest = header_of(head, "WARC-Type"), header_of(head, "WARC-Payload-Digest").removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't match its digest")
                    size = len(payload) if kind == "response" else int(header_of(http, "Content-Length"))
                    page, refers = header_of(http, "X-Page"), header_of(head, "X-Refers-To-Page")
                    rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, header_of(head, "WARC-Record-ID"), header_of(head, "WARC-Target-URI"), header_of(head, "WARC-Date")))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = [x.split()[0] for x in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(shared.trimmed(run), READ)


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through legacy archives to WARC archives in the shared folder, and what those hold when read back."""
    spark = pages.sparkSession
    arc, warc = shared.fresh_path(spark, "arc"), shared.fresh_path(spark, "warc")
    write_arc(pages, arc, id_col=id_col, url_col=url_col, html_col=html_col)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
