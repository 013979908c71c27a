"""Capture files (pcap) as a data source: batch, stream and sink.

``register(spark)`` makes ``spark.read.format("capture").load(folder)``, ``readStream`` and ``write`` work. Files are opened where
they lie, by Arrow's file systems (local and mounted folders, object stores, HDFS with its client), so no file goes through the driver.

* A file is cut into byte ranges (``splitBytes``); a task takes one, or neighbours if there are many. A range starts at the first place behind its border where a chain
  of plausible record headers begins, and owns the records that start in it; the range before ends there.
* Nothing is dropped silently: bytes that are no record, and frames that are no IP or ARP packet, give a row whose
  ``broken`` says why; its ``offset`` says where. Reading goes on behind them.
* As a stream, files are taken in the order of their names, up to ``filesPerTrigger`` a micro-batch; the offset is the last name.
  A file must be complete when it appears, and later ones must have later names, as rotating capture tools name them.

Columns: ``CAPTURE``; ``length`` is the length on the wire, ``payload`` what was captured behind the TCP or UDP header.
"""

from __future__ import annotations

import ipaddress
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from flowsentry.functions.scalar import parse_flags, timestamp_of

CAPTURE = (
    "file string, offset bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, l4 string, length int, "
    "flag_bits int, payload binary, src_mac string, ip_version int, flow_label int, next_header int, broken string"
)
FRAMES = "ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, l4 string, length int, flag_bits int, payload binary"

# Fixed values of the format: magic numbers by byte order and unit, header sizes, link type, protocol numbers.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
FILE_HEADER, RECORD_HEADER, ETHERNET, SNAPLEN = 24, 16, 1, 262_144
TRANSPORTS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMP"}
IPV4, IPV6, ARP, VLAN = 0x0800, 0x86DD, 0x0806, 0x8100

SPLIT_BYTES = 64 << 20
TASKS, TASK_BYTES = 256, 4 << 20  # beyond so many tasks short ranges share one, up to these bytes
BUFFER = 4 << 20
CHAIN = 6  # headers in a row that make a place a record's start
DAY = 86_400


class Head(NamedTuple):
    """What the file header says: byte order, ticks of a microsecond, longest record, link type, and the first time."""

    order: str
    ticks: int
    longest: int
    link: int
    first_s: int

    def record(self, data, at: int) -> tuple[int, int, int, int]:
        return struct.unpack_from(self.order + "IIII", data, at)

    def plausible(self, data, at: int) -> bool:
        seconds, part, held, length = self.record(data, at)
        near = abs(seconds - self.first_s) < 4000 * DAY
        return near and part < 1_000_000 * self.ticks and 0 < held <= self.longest and held <= length


def read_head(raw: bytes) -> Head | None:
    if len(raw) < FILE_HEADER or raw[:4] not in MAGICS:
        return None
    order, ticks = MAGICS[raw[:4]]
    longest, link = struct.unpack_from(order + "II", raw, 16)
    first = struct.unpack_from(order + "I", raw, FILE_HEADER)[0] if len(raw) >= FILE_HEADER + 4 else 0
    return Head(order, ticks, longest or SNAPLEN, link & 0xFFFF, first)


def next_record(data, at: int, head: Head, ends: bool) -> int | None:
    """The first place from ``at`` on where a chain of records starts; ``ends``: the file ends with ``data``."""
    for start in range(at, len(data) - RECORD_HEADER + 1):
        place, links = start, 0
        while links < CHAIN and place + RECORD_HEADER <= len(data) and head.plausible(data, place):
            place += RECORD_HEADER + head.record(data, place)[2]
            links += 1
        if links == CHAIN or (links and place == len(data) and ends) or (links and place + RECORD_HEADER > len(data) and not ends):
            return start
    return None


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the capture files of a folder, in the order of their names."""
    from pyarrow import fs

    files, place = _open(path)
    found = files.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    named = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(named)


class Range(InputPartition):
    def __init__(self, root: str, file: str, start: int, end: int):
        self.root, self.file, self.start, self.end = root, file, start, end


def ranges(root: str, files: list[tuple[str, int]], split_bytes: int) -> list[Range]:
    return [
        Range(root, name, low, min(low + split_bytes, size))
        for name, size in files
        for low in range(0, max(size, 1), split_bytes)
    ]


class Ranges(InputPartition):
    """Neighbouring ranges that one task reads, one after the other."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def packed(parts: list[Range]) -> list[Ranges]:
    """Ranges in their order: each a task, or neighbours in one if there are many."""
    most = 0 if len(parts) <= TASKS else min(TASK_BYTES, sum(part.end - part.start for part in parts) // TASKS)
    tasks, held = [], 0
    for part in parts:
        size = part.end - part.start
        if not tasks or held + size > most:
            tasks.append(Ranges([]))
            held = 0
        tasks[-1].parts.append(part)
        held += size
    return tasks


def records(part: Range) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int]], Head, int, list[tuple[int, int, str]]]]:
    """Buffers of a range: their bytes, the records (place, length held, length, seconds, part of a second), the file's
    head, where the buffer starts, and the gaps (place, bytes, why)."""
    files, _ = _open(part.root)
    with files.open_input_file(part.file) as file:
        size = file.size()
        head = read_head(file.read_at(FILE_HEADER + 4, 0))
        if head is None:
            if part.start == 0:
                yield b"", [], Head("<", 1, 0, ETHERNET, 0), 0, [(0, size, "no capture file")]
            return
        at, aligned = (FILE_HEADER, True) if part.start < FILE_HEADER else (part.start, False)
        while at < min(part.end, size):
            # The records that start in the range, and what tells a chain of them behind its end.
            ahead = min(BUFFER, part.end - at + CHAIN * (RECORD_HEADER + 2048))
            data = file.read_at(min(ahead + RECORD_HEADER + head.longest, size - at), at)
            ends = at + len(data) == size
            place, found, gaps = 0, [], []
            if not aligned:
                place = next_record(data, 0, head, ends)
                if place is None:
                    if ends:
                        return  # no record starts in what is left, which the range before reports
                    at += max(1, len(data) - RECORD_HEADER - head.longest)
                    continue
                aligned = True
            while at + place < part.end and place < len(data):
                whole = place + RECORD_HEADER <= len(data) and head.plausible(data, place)
                if whole and place + RECORD_HEADER + head.record(data, place)[2] <= len(data):
                    seconds, tick, held, length = head.record(data, place)
                    found.append((place, held, length, seconds, tick))
                    place += RECORD_HEADER + held
                    if place >= BUFFER:
                        break
                    continue
                if not ends and place:
                    break  # a record that goes on behind the buffer, or a gap near its end: read on from here
                following = next_record(data, place + 1, head, ends)
                stop = len(data) if following is None else following
                gaps.append((place, stop - place, "no record" if ends or following is not None else "no record in a buffer"))
                place = stop
            yield data, found, head, at, gaps
            at += place


def _addresses(raw: np.ndarray) -> pa.Array:
    """Texts of addresses, given as rows of bytes; each different one is written out once."""
    different, at = np.unique(raw, axis=0, return_inverse=True)
    texts = [str(ipaddress.ip_address(row.tobytes())) for row in different]
    return pa.array(np.array(texts, object)[at.reshape(-1)] if len(texts) else [], pa.string())


def decode(data: bytes, found, head: Head, base: int, gaps, file: str, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a buffer's records, field by field over all of them, and of its gaps."""
    n = len(found)
    place, held, length, seconds, tick = (np.array(c, np.int64) for c in zip(*found)) if n else [np.zeros(0, np.int64)] * 5
    octets = np.frombuffer(data + bytes(64), np.uint8)
    start, end = place + RECORD_HEADER, place + RECORD_HEADER + held

    def number(at: np.ndarray, size: int) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for i in range(size):
            value = value << 8 | octets[np.minimum(at + i, len(octets) - 1)]
        return value

    framed = np.full(n, head.link == ETHERNET)
    kind = np.where(framed, number(start + 12, 2), 0)
    tagged = framed & (kind == VLAN)
    kind = np.where(tagged, number(start + 16, 2), kind)
    ip = start + np.where(framed, 14 + 4 * tagged, 0)
    version = np.where(framed, np.select([kind == IPV4, kind == IPV6], [4, 6], 0), octets[np.minimum(ip, len(octets) - 1)] >> 4)
    arp = framed & (kind == ARP) & (ip + 28 <= end)
    inner = np.where(version == 4, (octets[np.minimum(ip, len(octets) - 1)] & 15).astype(np.int64) * 4, 40)
    good4 = (version == 4) & (inner >= 20) & (ip + inner <= end)
    good6 = (version == 6) & (ip + 40 <= end)
    good = good4 | good6 | arp
    next_header = np.where(good4, number(ip + 9, 1), number(ip + 6, 1))
    transport = ip + inner
    # Later fragments have no transport header.
    first = ~(good4 & ((number(ip + 6, 2) & 0x1FFF) > 0))
    ported = (good4 | good6) & first & np.isin(next_header, (6, 17)) & (transport + 4 <= end)
    tcp = ported & (next_header == 6) & (transport + 14 <= end)
    offset = np.where(tcp, (number(transport + 12, 1) >> 4) * 4, 8)
    body = np.where(ported, np.minimum(transport + offset, end), np.minimum(transport, end))

    def addresses(at4: np.ndarray, at6: np.ndarray) -> pa.Array:
        texts = np.full(n, None, object)
        for mask, at, size in ((good4 | arp, at4, 4), (good6, at6, 16)):
            if mask.any():
                raw = octets[at[mask][:, None] + np.arange(size)]
                texts[mask] = _addresses(raw).to_numpy(zero_copy_only=False)
        return pa.array(texts, pa.string())

    names = np.array([TRANSPORTS.get(int(h)) for h in next_header] if n else [], object)
    names = np.where(arp, "ARP", np.where(good4 | good6, names, None)) if n else names
    macs = [data[s + 6 : s + 12].hex(":") if f else None for s, f in zip(start.tolist(), (framed & (held >= 14)).tolist())]
    g = len(gaps)
    nothing = lambda t: pa.nulls(g, t)

    def column(values, kind, valid=None) -> pa.Array:
        mask = None if valid is None else ~valid
        return pa.concat_arrays([pa.array(values, kind, mask=mask), nothing(kind)])

    payload = [data[b:e] if ok else None for b, e, ok in zip(body.tolist(), end.tolist(), (good & ~arp).tolist())]
    broken = np.where(good, None, "no packet") if n else np.array([], object)
    columns = [
        pa.array([file] * (n + g)),
        pa.array([*(place + base).tolist(), *[base + at for at, _, _ in gaps]], pa.int64()),
        column(seconds * 1_000_000 + tick // head.ticks, pa.int64()),
        pa.concat_arrays([addresses(np.where(arp, ip + 14, ip + 12), ip + 8), nothing(pa.string())]),
        pa.concat_arrays([addresses(np.where(arp, ip + 24, ip + 16), ip + 24), nothing(pa.string())]),
        column(number(transport, 2), pa.int32(), ported),
        column(number(transport + 2, 2), pa.int32(), ported),
        column(names, pa.string()),
        column(length, pa.int32()),
        column(number(transport + 13, 1) & 63, pa.int32(), tcp),
        column(payload, pa.binary()),
        column(macs, pa.string()),
        column(version.astype(np.int64), pa.int32(), good4 | good6),
        column(number(ip, 4) & 0xFFFFF, pa.int32(), good6),
        column(next_header, pa.int32(), good4 | good6),
        pa.array([*broken.tolist(), *[f"{why}: {size} bytes" for _, size, why in gaps]], pa.string()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


class _Reading:
    def __init__(self, options, schema: pa.Schema):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.per_trigger = int(options.get("filesPerTrigger", 16))
        self.columns = schema

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        for part in task.parts:
            for data, found, head, base, gaps in records(part):
                yield decode(data, found, head, base, gaps, part.file, self.columns)


class CaptureReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return packed(ranges(self.path, files_of(self.path), self.split)) or [Ranges([])]


class CaptureStream(_Reading, DataSourceStreamReader):
    """The offset is the name of the last file taken."""

    offset = None

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        # A restarted query asks for the end before it says where it was: all that is there is its first micro-batch.
        names = [name for name, _ in files_of(self.path)]
        if self.offset is not None:
            names = [name for name in names if name > self.offset][: self.per_trigger] or [self.offset]
        self.offset = names[-1] if names else (self.offset or "")
        return {"file": self.offset}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        taken = [(name, size) for name, size in files_of(self.path) if start["file"] < name <= end["file"]]
        return packed(ranges(self.path, taken, self.split))

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


@lru_cache(1 << 16)
def _octets(address: str) -> bytes:
    return ipaddress.ip_address(address).packed


def _frame(row: dict) -> bytes:
    """An Ethernet frame with IPv4 or ARP; parts that the row lacks are 0."""
    source, target = _octets(row["src_ip"]), _octets(row["dst_ip"])
    macs = bytes([2, 0, *target, 2, 0, *source])
    if row["l4"] == "ARP":
        return macs + struct.pack(">HHHBBH", ARP, 1, IPV4, 6, 4, 1) + bytes([2, 0]) + source + source + bytes(6) + target
    ports, body = (row["src_port"] or 0, row["dst_port"] or 0), row["payload"] or b""
    if row["l4"] == "TCP":
        inner = struct.pack(">HHIIBBHHH", *ports, 0, 0, 0x50, row["flag_bits"] or 0, 0, 0, 0)
    elif row["l4"] == "UDP":
        inner = struct.pack(">HHHH", *ports, min(8 + len(body), 65_535), 0)
    else:
        inner = bytes(8)
    kind = {"TCP": 6, "UDP": 17}.get(row["l4"], 1)
    size = min(20 + len(inner) + len(body), 65_535)
    return macs + struct.pack(">HBBHHHBBH", IPV4, 0x45, 0, size, 0, 0, 64, kind, 0) + source + target + inner + body


class CaptureWriter(DataSourceArrowWriter):
    """One file a task, named for the task and moved into place when the job commits. Long frames are cut, as capture tools do."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.longest = int(options.get("snaplen", SNAPLEN))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, place = _open(self.path)
        files.create_dir(place)
        name = f"_part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}.pcap"
        with files.open_output_stream(f"{place}/{name}") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, self.longest, ETHERNET))
            for batch in batches:
                for row in batch.to_pylist():
                    frame = _frame(row)[: self.longest]
                    seconds, micros = divmod(row["ts_us"], 1_000_000)
                    out.write(struct.pack("<IIII", seconds, micros, len(frame), max(row["length"], len(frame))) + frame)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        files, place = _open(self.path)
        for message in messages:
            if message is not None:
                files.move(f"{place}/{message.file}", f"{place}/{message.file[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        files, place = _open(self.path)
        for message in messages:
            if message is not None:
                files.delete_file(f"{place}/{message.file}")


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return CAPTURE

    def _columns(self, schema) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options, self._columns(schema))

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options, self._columns(schema))

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def write_capture(packets: DataFrame, path: str, snaplen: int = SNAPLEN) -> None:
    """Packets with the columns ``FRAMES`` as capture files."""
    register(packets.sparkSession)
    names = [part.split()[0] for part in FRAMES.split(", ")]
    packets.select(*names).write.format("capture").option("snaplen", snaplen).mode("append").save(path)


def split_broken(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets, with the names of their flags and a time, and the rows that are none."""
    packets = captured.where(F.col("broken").isNull()).withColumns({"flags": parse_flags("flag_bits"), "ts": timestamp_of()})
    return packets, captured.where(F.col("broken").isNotNull())
