"""WARC archives: a deduplicating writer and a salvage reader.

Writing: each row gives one record; of records with equal payloads of at least ``least`` bytes that of the
smallest id holds the payload, the others are revisits of it. Records are built from built-in functions and written
by Spark's text writer, so archives go to whatever store Spark writes to, and a lost task leaves nothing behind. Its line
separator is the end of a WARC record, or, as each record is a gzip member, the last byte of a member.

Reading: archives come as whole files of a bounded number of records. The reader checks each record (version
line, headers, length, end mark, SHA-256 of the payload). After a failed check it searches for the nearest of a valid gzip
member and a valid version line, whatever the file began with, goes on there, and logs the bytes between as a quarantined gap.

Null payloads are empty; a null id is written as an empty one and never the smallest; of rows equal in id and payload one
holds the payload. Control characters in a URL are escaped; a null URL is left out. Empty tables give no archives and no
records. Other columns may have any names.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm.common import short_batches, utf8

LEAST = 100
RECORDS = 1_000  # records of an archive
END = b"\r\n\r\n"
VERSION = b"WARC/1."
CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.\d+\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def planned(df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """``_id, _url, _payload, _bytes, _digest, _type, _refers`` of each row."""
    body = utf8(df[payload])
    rows = df.select(
        df[page_id].alias("_id"),
        df[url].alias("_url"),
        body.alias("_payload"),
        F.octet_length(body).cast("long").alias("_bytes"),
        F.sha2(body.cast("binary"), 256).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Equal payloads are found on digests alone, summed up before the shuffle.
    first = (
        rows.where((F.col("_bytes") >= least) & F.col("_id").isNotNull())
        .groupBy("_digest")
        .agg(F.min(F.struct("_id", "_row")).alias("_first"))
    )
    joined = rows.join(first, "_digest", "left")
    held = F.col("_first").isNull() | (F.col("_bytes") < least) | (F.col("_first._row") == F.col("_row"))
    return joined.select(
        "_id",
        "_url",
        "_payload",
        "_bytes",
        "_digest",
        F.when(held, "response").otherwise("revisit").alias("_type"),
        F.when(~held, F.col("_first._id")).alias("_refers"),
    )


def write_archives(
    rows: DataFrame, path: str, date: str = DATE, records: int = RECORDS, compression: str = "gzip"
) -> None:
    """Write what ``planned`` gives as archives of at most ``records`` records under ``path``.

    With ``gzip`` each record is a member, with ``none`` an archive is plain.
    """
    url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
    page = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(head, F.when(F.col("_type") == "response", F.col("_payload")).otherwise(F.lit("")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        page,
        F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.coalesce(
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("_refers").cast("string"), F.lit(">")),
            F.lit(""),
        ),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("_digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    if compression not in ("gzip", "none"):
        raise ValueError(f"unknown compression {compression}")
    made, mark = rows.select(record.alias("value")), END.decode()
    if compression == "gzip":
        made, mark = _members(made), "\0"
    made.write.option("lineSep", mark).option("maxRecordsPerFile", records).option("compression", "none").text(path)


def _zip(record: bytes) -> bytes:
    """The record as a gzip member. Its last byte is the top one of its length: from 16 MB on an empty member follows, so it is 0."""
    made = gzip.compress(record, 6, mtime=0)
    return made if made.endswith(b"\0") else made + gzip.compress(b"", mtime=0)


def _members(records: DataFrame) -> DataFrame:
    """The gzip members of the records without the last byte, which is 0."""
    import pyarrow as pa

    short_batches(records.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_zip(value.as_py() + END)[:-1] for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    return records.select(F.col("value").cast("binary")).mapInArrow(run, "value binary").select(F.col("value").cast("string"))


@dataclass
class Record:
    """A record, or with ``kind`` gap the bytes that were skipped and why."""

    kind: str
    offset: int
    length: int
    reason: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _header(line: bytes) -> tuple[str, str]:
    name, colon, value = line.partition(b":")
    if not colon:
        raise ValueError("header line without a colon")
    return name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()


def _headers(data: bytes, start: int) -> tuple[dict[str, str], int]:
    """The headers behind the first line and where they end, however long they are; the first bad line stops the search."""
    out, at = {}, data.find(b"\r\n", start)
    while at >= 0 and not data.startswith(END, at):
        low, at = at + 2, data.find(b"\r\n", at + 2)
        if at >= 0:
            name, value = _header(data[low:at])
            out[name] = value
    if at < 0:
        raise ValueError("headers do not end")
    return out, at


def _record(data: bytes, start: int) -> Record:
    """The record at ``start``; ValueError if a check fails."""
    if not VERSION_LINE.match(data, start):
        raise ValueError("no version line")
    headers, stop = _headers(data, start)
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no length")
    body = stop + len(END)
    end = body + int(size)
    if end > len(data):
        raise ValueError("truncated")
    if not data.startswith(END, end) and not (end < len(data) and data[end:] == END[: len(data) - end]):
        raise ValueError("no end mark")
    block, http = data[body:end], {}
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http, mark = _headers(block, 0)
        payload = block[mark + len(END) :]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha256:"):
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ValueError("payload digest differs")
    return Record("record", start, min(end + len(END), len(data)) - start, "", headers, http, payload)


def _plain(data: bytes) -> Iterator[Record]:
    """The records of uncompressed bytes and the gaps between them."""
    at = 0
    while at < len(data):
        try:
            record = _record(data, at)
            at += record.length
            yield record
        except ValueError as error:
            start, following = at, at
            while True:
                following = data.find(VERSION, following + 1)
                if following < 0:
                    at = len(data)
                    break
                try:
                    _record(data, following)
                except ValueError:
                    continue
                at = following
                break
            yield Record("gap", start, at - start, str(error))


def _member(data: bytes, start: int, step: int = CHUNK, rescue: bool = True) -> tuple[bytes, int, str]:
    """What the gzip member at ``start`` holds, where it ends, and what is wrong with it, if anything.

    Of a damaged member the content up to the damage is given, unless ``rescue`` is off.
    """
    machine, out = zlib.decompressobj(31), bytearray()
    for low in range(start, len(data), step):
        piece = data[low : low + step]
        try:
            out += machine.decompress(piece)
        except zlib.error as error:
            if step > 1 and rescue:  # byte by byte nothing before the damage is lost
                return _member(data, start, 1)
            return bytes(out), start, f"gzip: {error}"
        if machine.eof:
            return bytes(out), low + len(piece) - len(machine.unused_data), ""
    return bytes(out), start, "gzip: truncated"


def _holds_record(data: bytes, start: int) -> bool:
    """Whether a whole gzip member with a valid record starts here; an archived .gz payload holds none."""
    content, _, wrong = _member(data, start, rescue=False)
    return not wrong and any(record.kind == "record" for record in _plain(content))


def _restart(data: bytes, start: int, known: list[Record]) -> int:
    """The nearest place from ``start`` with a valid record or a valid gzip member, else the end.

    A deflate stream may hold records as they are: those recovered already (``known``) are passed over.
    """
    line, magic = data.find(VERSION, start), data.find(MAGIC, start)
    while line >= 0 or magic >= 0:
        if magic < 0 or 0 <= line < magic:
            try:
                record = _record(data, line)
                if not any((record.headers, record.payload) == (r.headers, r.payload) for r in known):
                    return line
            except ValueError:
                pass
            line = data.find(VERSION, line + 1)
        else:
            if _holds_record(data, magic):
                return magic
            magic = data.find(MAGIC, magic + 1)
    return len(data)


def salvage(data: bytes) -> Iterator[Record]:
    """All records that can be recovered, in order, and the gaps; offsets are of the file's bytes.

    Plain records and gzip members may follow each other. Records and gaps within a member have its place; of a
    damaged member the records before the damage are recovered and the member is logged as a gap.
    """
    at = 0
    while at < len(data):
        known = []
        if data.startswith(MAGIC, at):
            content, end, wrong = _member(data, at)
            found = list(_plain(content))
            # Whole records from before the damage pass their own checks.
            known = [record for record in found if record.kind == "record"] if wrong else []
            end = _restart(data, at + 1, known) if wrong else end
            for record in known if wrong else found:
                record.offset, record.length = at, end - at
                yield record
        else:
            try:
                record, wrong = _record(data, at), ""
                end = at + record.length
                yield record
            except ValueError as error:
                end, wrong = _restart(data, at + 1, known), str(error)
        if wrong:
            yield Record("gap", at, end - at, wrong)
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and gap of the archives under ``path``.

    ``file, kind`` (record or gap)``, offset, length, reason, record_type, record_id, refers_to, uri, digest, http_length,
    payload``.
    """
    import pyarrow as pa

    short_batches(spark, 2)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["file", "kind", "offset", "length", "reason", "record_type", "record_id", "refers_to", "uri", "digest", "http_length", "payload"]

    def values(path: str, r: Record) -> tuple:
        h = r.headers
        size = r.http.get("content-length", "")
        return (
            path, r.kind, r.offset, r.length, r.reason, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"),
            h.get("warc-target-uri"), h.get("warc-payload-digest"), int(size) if size.isdigit() else None, r.payload,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * 6 + [pa.int64(), pa.binary()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                for record in salvage(content.as_py()):
                    held.append(values(path, record))
                    size += len(record.payload)
                    if size > 1 << 24 or len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)

    return files.mapInArrow(
        run,
        "file string, kind string, offset long, length long, reason string, record_type string, record_id string, refers_to string,"
        " uri string, digest string, http_length long, payload binary",
    )


def page_of(column: str):
    """The id in a record's URN."""
    return F.nullif(F.regexp_extract(column, "^<urn:page:(.*)>$", 1), F.lit(""))
