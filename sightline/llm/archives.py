"""Legacy web archives to WARC: parses ARC files by their version's header line and declared lengths and synthesises the
equivalent WARC records, written as gzip files and read back.

Method. An ARC file begins with a version block; its last line names the fields of all record lines (version 1: five,
version 2: ten). A record is a line of these fields and then as many bytes as the last field declares. Each becomes a WARC
record: the identifier is derived from what identifies the record, the 12- or 14-digit date becomes an ISO time, the type
follows from the content (an HTTP response, else a resource) and digests are computed. Of records with the same payload
of at least ``LEAST_REVISIT`` bytes, that of the smallest page id keeps its payload; the others become revisits of it.

Scale. Archives are values of about ``SEGMENT`` bytes, each a whole ARC file, and WARC files hold at most ``FILE_RECORDS`` records, so
a task holds a few at a time. Files are written and read by Spark in the shared folder. Only digests and ids are grouped;
a digest that a third of all pages share is added up before the shuffle and its rows are split by the join's skew handling.

A null or empty html is an empty payload. A null URL is written as ``urn:missing``; blanks, controls and characters
outside ASCII in URLs are percent-encoded. A record without a page id is a revisit if any other of its payload has one, else a response.
Rows with the same page id and payload are one record twice: both are responses, or both revisits of another.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import shared_path

SEGMENT = 1 << 20
FILE_RECORDS = 2000
LEAST_REVISIT = 100
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_ID = "X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "url string, ip string, date string, content_type string, page_id long, head binary, payload binary, payload_bytes long, payload_digest string"
READ = "record_id string, record_type string, target string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long, sound boolean"


# ---- writing ARC ----------------------------------------------------------------------------------------------


def arc_record(version: int, url: str | None, date: str, content_type: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:missing"
    own = [target, "0.0.0.0", date, content_type]
    if version == 2:
        own += ["200", "-", "-", str(offset), name]
    return " ".join([*own, str(len(block))]).encode() + b"\n" + block


def arc_file(version: int, name: str, date: str, records: Iterable[bytes]) -> bytes:
    about = f"{version} 0 sightline\n{FIELDS[version]}\n".encode()
    return b"\n".join([arc_record(version, f"filedesc://{name}", date, "text/plain", about, 0, name), *records, b""])


def pages_to_arc(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """(content): ARC files of the html of ``pages`` (page_id, url, html), versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            version = 1 + number % 2
            records = (arc_record(version, url, date, "text/html", block) for url, block in part)
            return pa.RecordBatch.from_arrays([pa.array([arc_file(version, f"part-{number}.arc", date, records)], pa.binary())], ["content"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                own = f"{PAGE_ID}: {page_id}\r\n" if page_id is not None else ""
                block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n{own}\r\n".encode() + (html or b"")
                part.append((url, block))
                size += len(block)
                if size >= SEGMENT:
                    yield flush()
                    part, size, number = [], 0, number + 1
        if part:
            yield flush()

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html")).mapInArrow(run, "content binary")


# ---- reading ARC ----------------------------------------------------------------------------------------------


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an ARC file. The field names are those of the version block; a record line has
    fields separated by single blanks, counted from the right, so a URL may hold blanks."""
    names = FIELDS[1].split(" ")
    at = 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":  # between records
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc:"):
            size = int(line.rsplit(" ", 1)[1])
            about = content[end + 1 : end + 1 + size].decode("utf-8", "replace").splitlines()
            names = next((x for x in about if x.startswith("URL ")), FIELDS[int(about[0].split(" ")[0])]).split(" ")
            at = end + 1 + size
            continue
        fields = dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True))
        size = int(fields["Archive-length"])
        block = content[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record of {fields['URL']} is cut short: {len(block)} of {size} bytes")
        yield fields, block
        at = end + 1 + size


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its empty line, payload, header fields) of an HTTP response; all is payload if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, blank, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head + blank, payload, fields


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def parse_arc(archives: DataFrame) -> DataFrame:
    """One row for each record of the ARC files in ``content``."""
    schema = _schema(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in arc_records(content.as_py() or b""):
                    head, payload, http = _http(block)
                    page_id = int(http[PAGE_ID]) if PAGE_ID in http else None
                    rows.append((fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], page_id, head, payload, len(payload), hashlib.sha256(payload).hexdigest()))
                yield _table(rows, schema)

    return archives.select("content").mapInArrow(run, PARSED)


# ---- WARC -----------------------------------------------------------------------------------------------------


def warc_date(date: str) -> str:
    """The ISO time of a 14-, 12- or 8-digit ARC date; missing parts are the first possible."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def warc_record(row: dict) -> bytes:
    """A record without the empty lines that end it. ``refers_to`` makes it a revisit, without its payload."""
    revisit, head = row["refers_to"] is not None, row["head"]
    block = head if revisit else head + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response" if head else "resource"),
        ("WARC-Record-ID", record_id(row["url"], row["date"], row["page_id"], row["payload_digest"])),
        ("WARC-Date", warc_date(row["date"])), ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", "sha256:" + row["payload_digest"]), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Type", "application/http;msgtype=response" if head else row["content_type"]),
        (PAGE_ID, row["page_id"]), ("X-Payload-Length", row["payload_bytes"]),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", row["refers_to"])]
    fields.append(("Content-Length", len(block)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + block


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in content[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def to_warc(parsed: DataFrame) -> DataFrame:
    """(record): a WARC record for each row of ``parse_arc``; repeated payloads become revisits."""
    sure = parsed.filter(F.col("payload_bytes") >= LEAST_REVISIT)
    first = sure.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    rows = parsed.join(first.select("payload_digest", "first"), "payload_digest", "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in batch.to_pylist()], pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Gzip files of WARC records. Two line ends close a record, which is what the text sink writes after each row."""
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the files under ``path``. ``sound``: both digests agree with the bytes read."""
    schema = _schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in warc_records(gzip.decompress(content.as_py())):
                    revisit, (_, payload, _) = fields["WARC-Type"] == "revisit", _http(block)
                    digest, stated = hashlib.sha256(payload).hexdigest(), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    sound = fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and (revisit or digest == stated)
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    rows.append((
                        fields["WARC-Record-ID"], fields["WARC-Type"], fields["WARC-Target-URI"], fields["WARC-Date"], number(PAGE_ID),
                        number("X-Payload-Length") if revisit else len(payload), stated if revisit else digest, number("X-Refers-To-Page-Id"), sound,
                    ))
                yield _table(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, READ)


def converted(pages: DataFrame) -> DataFrame:
    """The records of ``pages`` after a way through ARC and WARC files."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(to_warc(parse_arc(pages_to_arc(pages))), path)
    return read_warc(pages.sparkSession, path)


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d AND p.n >= {LEAST_REVISIT}
"""
