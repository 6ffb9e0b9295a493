"""Legacy archive converter: ARC files to WARC records, and readers for both.

ARC files hold a version block and records of one header line each: five
fields in version 1 (URL, IP, date, type, length), ten in version 2 (result
code, checksum, location, offset and file name come before the length).  The
converter parses each file's own version, takes every content by its declared
length and makes the equivalent WARC record: identifier, timestamp, type,
block and payload digests.  Of records with equal payloads of at least
``REVISIT_BYTES`` the one with the largest page id is the response and the
others revisit it.

Files are written by Spark's text writer (a record is one value, the record
separator of the format the line separator) and read by its binary reader, so
any store that Spark reaches will do.

Defined cases: a null or empty page body is an empty payload; a null URL is
written as ``-`` (ARC's mark for no value) and read back as null; white space
and control characters in URLs are percent-encoded, as both formats need; a
null page id sorts before all others; of repeated rows one is the response;
extra columns are left behind; an empty table writes an archive without
records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices

REVISIT_BYTES = 1000
DATE = "20240101000000"  # of pages without a fetch date
NO_VALUE = "-"
BATCH_BYTES = 8 << 20

# Header lines and WARC field names are fixed by the formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
CRLF = "\r\n"
WARC_END = CRLF * 2

ARC_RECORD = ("arc_file string, arc_offset long, page_id long, url string, ip string, date string, mime string, "
              "block binary, payload_start int, payload_digest binary")
WARC_RECORD = ("record_id string, record_type string, url string, date string, page_id long, payload_bytes long, "
               "payload_digest string, refers_to long, refers_to_id string, payload binary")

_ID = "X-Page-Id"  # HTTP header that carries the page's id
_REFERS = "WARC-Refers-To-Page-Id"  # extension field


# --- writing ARC -----------------------------------------------------------------------------


def _http_head(page_id, n: int) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {n}"]
    if page_id is not None:
        lines.append(f"{_ID}: {page_id}")
    return (CRLF.join(lines) + WARC_END).encode()


def _uri(url) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or NO_VALUE


def write_arc(pages: DataFrame, path: str, version: int | None = None) -> None:
    """Pages (page_id, url, html) as gzipped ARC files, one per partition.

    ``version`` None alternates versions 1 and 2 by partition.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))

    def records(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        v = version or 1 + part % 2
        name = f"part-{part:05d}.arc"
        about = f"{v} 0 converter\n{' '.join(ARC_FIELDS[v])}\n"
        more = "200 - - 0 " + name + " " if v == 2 else ""
        first = f"filedesc://{name} 0.0.0.0 {DATE} text/plain {more}{len(about.encode())}\n{about}"
        yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
        for batch in batches:
            for piece in slices(batch, 2, BATCH_BYTES):
                out = []
                for page_id, url, html in zip(*(c.to_pylist() for c in piece.columns)):
                    body = html.encode()
                    block = _http_head(page_id, len(body)) + body
                    more = f"200 {hashlib.md5(block).hexdigest()} - 0 {name} " if v == 2 else ""
                    out.append(f"{_uri(url)} 0.0.0.0 {DATE} text/html {more}{len(block)}\n".encode() + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    rows.mapInArrow(records, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


# --- reading ---------------------------------------------------------------------------------


class _Stream:
    """Bytes of a file's content, decompressed as they are needed."""

    def __init__(self, content: bytes):
        import zlib

        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self.rest, self.buffer = (content, b"") if self.zip else (b"", content)
        self.pos = self.at = 0  # in the buffer, in the file

    def _more(self, n: int):
        """Have ``n`` bytes ready, if there are so many."""
        import zlib

        parts, have = [self.buffer[self.pos:]], len(self.buffer) - self.pos
        while have < n and self.rest:
            parts.append(self.zip.decompress(self.rest, max(1 << 20, n - have)))
            have += len(parts[-1])
            self.rest = self.zip.unconsumed_tail
            if self.zip.eof:  # the next member, if any
                self.rest = self.zip.unused_data
                self.zip = zlib.decompressobj(31)
        self.buffer, self.pos = b"".join(parts), 0

    def take(self, n: int) -> bytes:
        if len(self.buffer) - self.pos < n and self.rest:
            self._more(n)
        out = self.buffer[self.pos:self.pos + n]
        self.pos += len(out)
        self.at += len(out)
        return out

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.pos)) < 0 and self.rest:
            self._more(2 * (len(self.buffer) - self.pos) + 1)
        return self.take((end + 1 if end >= 0 else len(self.buffer)) - self.pos)

    def done(self) -> bool:
        if self.pos == len(self.buffer) and self.rest:
            self._more(1)
        return self.pos == len(self.buffer)


def _batched(rows, schema):
    import pyarrow as pa

    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(files: DataFrame, parse, ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                yield from _batched(parse(name, _Stream(batch.column(1)[i].as_py())), arrow)

    return files.mapInArrow(run, ddl)


def _http_fields(head: bytes) -> dict:
    return {k.strip().lower(): v.strip() for k, _, v in
            (line.partition(":") for line in head.decode("utf-8", "replace").split(CRLF)[1:])}


def arc_records(name: str, stream: _Stream):
    """The records of one ARC file, by its own version and the declared lengths."""
    version = None
    while not stream.done():
        offset, line = stream.at, stream.line()
        if not line.strip():
            continue  # the separator after a record
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        block = stream.take(int(fields[-1]))
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if not fields[0].startswith("filedesc://") or version not in ARC_FIELDS:
                raise ValueError(f"{name}: no ARC version block")
            continue
        if len(fields) != len(ARC_FIELDS[version]):
            raise ValueError(f"{name}: {len(fields)} header fields at {offset}, version {version} has "
                             f"{len(ARC_FIELDS[version])}")
        record = dict(zip(ARC_FIELDS[version], fields))
        start = block.find(WARC_END.encode()) + 4 if block.startswith(b"HTTP/") else 0
        page_id = _http_fields(block[:start]).get(_ID.lower()) if start else None
        yield (name, offset, None if page_id is None else int(page_id),
               None if record["URL"] == NO_VALUE else record["URL"], record["IP-address"], record["Archive-date"],
               record["Content-type"], block, start, hashlib.sha1(memoryview(block)[start:]).digest())


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(_files(spark, path), arc_records, ARC_RECORD)


# --- converting ------------------------------------------------------------------------------


def _record_id(name: str, offset: int) -> str:
    """The same record gets the same identifier whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name.rsplit('/', 1)[-1]}#{offset}')}>"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _warc(kind: str, name: str, offset: int, url, date: str, block: bytes, digest: bytes, refers=None) -> bytes:
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(name, offset)), ("WARC-Date", stamp)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Payload-Digest", _base32(digest)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest()))]
    if refers is not None:
        page_id, other_name, other_offset = refers
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _record_id(other_name, other_offset))]
        if page_id is not None:
            fields.append((_REFERS, str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields) + CRLF
    return head.encode() + block


def convert(arc: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the ARC records as gzipped WARC files of responses and revisits."""
    size = F.length("block") - F.col("payload_start")
    slim = arc.where(size >= revisit_bytes).select(
        "payload_digest", F.struct(F.col("page_id").alias("page_id"), "arc_file", "arc_offset").alias("at"))
    # of equal payloads the largest page id answers for all (nulls sort first); partial aggregation
    # leaves one row per payload and task, and only payloads that repeat are joined
    chosen = slim.groupBy("payload_digest").agg(F.max("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    chosen = chosen.repartition("payload_digest").drop("n")
    revisits = (slim.join(chosen, "payload_digest").where("at <> first")
                .select(F.col("at.arc_file").alias("arc_file"), F.col("at.arc_offset").alias("arc_offset"), "first"))
    rows = arc.join(revisits, ["arc_file", "arc_offset"], "left").select(
        "arc_file", "arc_offset", "url", "date", "block", "payload_start", "payload_digest", "first")

    def records(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, 4, BATCH_BYTES):
                out = []
                for name, offset, url, date, block, start, digest, first in zip(*(c.to_pylist() for c in piece.columns)):
                    if first is None:
                        out.append(_warc("response", name, offset, url, date, block, digest))
                    else:  # the HTTP head only; its Content-Length still tells the payload's size
                        out.append(_warc("revisit", name, offset, url, date, block[:start], digest,
                                         (first["page_id"], first["arc_file"], first["arc_offset"])))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    (rows.mapInArrow(records, "value string").write.option("lineSep", WARC_END)
     .option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path))


def warc_records(name: str, stream: _Stream):
    """The records of one WARC file by their declared lengths; payload digests are recomputed."""
    while not stream.done():
        line = stream.line()
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {stream.at - len(line)}")
        fields = {}
        while (line := stream.line().decode("utf-8", "replace").rstrip("\r\n")):
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.take(int(fields["content-length"]))
        start = block.find(WARC_END.encode()) + 4 if block.startswith(b"HTTP/") else 0
        http = _http_fields(block[:start])
        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2])
        kind, payload = fields["warc-type"], None
        if kind == "response":
            payload = block[start:]
            if hashlib.sha1(payload).digest() != digest:
                raise ValueError(f"{name}: payload digest of {fields['warc-record-id']} is wrong")
        page_id, refers = http.get(_ID.lower()), fields.get(_REFERS.lower())
        yield (fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields["warc-date"],
               None if page_id is None else int(page_id),
               len(payload) if payload is not None else int(http.get("content-length", 0)), digest.hex(),
               None if refers is None else int(refers), fields.get("warc-refers-to"), payload)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(_files(spark, path), warc_records, WARC_RECORD)


def pages_to_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Pages through legacy ARC files (in the shared scratch folder) to WARC files under ``path``."""
    arc = scratch_path(pages.sparkSession, "arc")
    write_arc(pages, arc)
    convert(read_arc(pages.sparkSession, arc), path, revisit_bytes)
