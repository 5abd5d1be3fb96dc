"""WARC archives in which a payload is stored once and later captures revisit it.

Writing: only headers (id, URL, digest and size of the payload) are shuffled, by payload digest; their partial minima give the
first capture of each repeated payload. Those few rows are joined to the pages, which are written with fresh headers: a response
record with its HTTP header and payload, or a revisit record that names the response and has no payload. Records are
written by Spark's text writer with the record end as line end, one gzip archive per task and ``records_per_file`` rows,
so any file system that Spark can write will do.

Reading: each archive is decompressed as a stream and cut by Content-Length; payloads are hashed and compared with their
header. ``resolve_revisits`` joins revisit records to the responses that they name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm._base import as_batch, few_arrow_rows, materialize, need_columns

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
#: Rows of a result batch of the reader.
READ_ROWS = 1000

RECORD_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, page_id long, payload_digest string, payload_bytes long, refers_to_id string, payload binary"


# ---- writing -----------------------------------------------------------------------------------------------------------


def _record_id(kind: str, *parts: Column) -> Column:
    """A name-based record id: the same record has the same id when its task is run again."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _safe_uri(url: Column) -> Column:
    """The URL without characters that would end or bend a header line."""
    for c in map(chr, (*range(33), 127)):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def _line(name: str, value: Column | str) -> Column:
    """One header line; nothing for a null value."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def page_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes) of pages; a null html is an empty payload."""
    need_columns(pages, "page_id", "url", "html")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    return out.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})


def originals(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(payload_digest, payload_bytes, first_id, first_uri) of payloads that several captures share, by headers alone."""
    long_enough = headers.where(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest", "payload_bytes")
    # captures without an id come last
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url"))
    out = long_enough.groupBy("payload_digest", "payload_bytes").agg(first.alias("f"), F.count("*").alias("n"))
    return out.where("n > 1 and f.page_id is not null").select("payload_digest", "payload_bytes", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_uri"))


def warc_records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, record_type, record): the record of each page as text, without the two line ends that close it."""
    captured = page_payloads(pages)
    # written first, so that its true size decides whether it is broadcast and payloads stay where they are
    first = materialize(originals(captured, min_bytes), "originals")
    rows = captured.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    own = _record_id("response", F.col("page_id"), F.col("payload_digest"))
    named = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    again = F.when(revisit, named(_record_id("response", F.col("first_id"), F.col("payload_digest"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    record = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", named(F.when(revisit, _record_id("revisit", F.col("page_id"), F.col("payload_digest"), F.col("url"))).otherwise(own))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", _safe_uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", again),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, _safe_uri(F.col("first_uri")))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Page-ID", F.col("page_id")),
        _line("Content-Type", "application/http;msgtype=response"),
        _line("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))),
        F.lit(CRLF),
        http,
        # the writer passes bytes on as they are
        F.when(revisit, "").otherwise(F.col("payload").cast("string")),
    )
    return rows.select("page_id", "record_type", record.alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``min_bytes`` that with the smallest page_id is stored, the others revisit it. A null html is an empty
    payload, a null URL or id leaves its header line out. A row without an id revisits the smallest id of its payload; where no capture has an
    id, all are stored. Rows that repeat the smallest page_id are stored again. Control characters and spaces of a URL are written as
    percent codes. An empty table gives archives without records. Other columns are not read.
    """
    out = warc_records(pages, date, min_bytes).select("record")
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# ---- reading -----------------------------------------------------------------------------------------------------------


def parse_records(stream: io.BufferedIOBase, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; damage raises ValueError."""
    while line := stream.readline():
        if not line.strip():  # an archive without records is one empty line
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: a record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            key, colon, value = line.partition(b":")
            if not colon:
                raise ValueError(f"{name}: header line {line[:40]!r}")
            fields[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"{name}: a record has no length")
        n = int(fields["content-length"])
        block, end = stream.read(n), stream.read(4)
        if len(block) != n or end != b"\r\n\r\n":
            raise ValueError(f"{name}: a record is cut or has a wrong length")
        yield fields, block


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


def _reader(keep_payload: bool):
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RECORD_SCHEMA.split(", "))])

    def row(fields: dict[str, str], block: bytes, name: str) -> list:
        kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "")
        digest, size, payload = stated.removeprefix("sha256:") or None, None, None
        if kind == "response":
            payload = http_payload(block)
            size, found = len(payload), hashlib.sha256(payload).hexdigest()
            if stated.startswith("sha256:") and found != digest:
                raise ValueError(f"{name}: payload of {fields.get('warc-record-id')} does not match its digest")
            digest = found
        page = fields.get("page-id")
        return [kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), None if page is None else int(page), digest, size, fields.get("warc-refers-to"), payload if keep_payload else None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = io.BytesIO(content.as_buffer())
                raw = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for fields, block in parse_records(io.BufferedReader(raw, 1 << 20), name):
                    rows.append(row(fields, block, name))
                    held += len(block) if keep_payload else 0
                    if len(rows) == READ_ROWS or held > 1 << 24:
                        yield as_batch(schema, list(zip(*rows, strict=True)))
                        rows, held = [], 0
                if rows:
                    yield as_batch(schema, list(zip(*rows, strict=True)))

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of all archives below ``path``, gzip (of one or many members) or plain.

    Digest and size of a response come from its payload, and a payload that does not match its stated SHA-256 stops the job; of a revisit the stated digest
    is returned, and no size. Other kinds of record are returned with their type.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    need_columns(files, "path", "content")
    return files.select("path", "content").mapInArrow(_reader(keep_payload), RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each response and revisit record.

    A revisit gets size and page_id of the response that it names, if that has the digest that the revisit states, and else nulls. Revisits
    of one response may be many: the responses that are named at all are found first, one row each, and only these are joined back.
    """
    seen = records.where("record_type in ('response', 'revisit')")
    revisits = seen.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    responses = seen.where("record_type = 'response'").groupBy("record_id", "payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"))
    found = materialize(responses.join(named, "record_id").withColumnRenamed("record_id", "refers_to_id"), "named-responses")
    whole = revisits.drop("payload_bytes").join(found, ["refers_to_id", "payload_digest"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return seen.where("record_type = 'response'").select(*cols, F.lit(None).cast("long").alias("refers_to")).unionByName(whole.select(*cols, "refers_to"))


def archive_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to archives below ``path``, read them back, and resolve the revisits."""
    write_archives(pages, path)
    spark = pages.sparkSession
    with few_arrow_rows(spark, 1):  # a row is an archive
        records = materialize(read_archives(spark, path).drop("payload"), "warc-headers")
    return resolve_revisits(records)
