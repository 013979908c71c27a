"""Capture files: frames of all kinds, byte ranges, damage, streams."""

import random
import struct

import pytest

from flowsentry.plans import catalog, views
from flowsentry.sources import capture

SF_DIR = "/root/testdata/sf0.001"


def frames_of(spark, rows):
    base = {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 5000, "dst_port": 80, "l4": "TCP", "length": 60, "flag_bits": 16, "payload": None}
    names = [part.split()[0] for part in capture.FRAMES.split(", ")]
    data = [tuple({**base, "ts_us": 1_700_000_000_000_000 + n, **row}[name] for name in names) for n, row in enumerate(rows)]
    return spark.createDataFrame(data, capture.FRAMES)


def read(spark, path, **options):
    capture.register(spark)
    reader = spark.read.format("capture")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(str(path))


def pcap(packets, order="<", magic=0xA1B2C3D4, link=1, longest=65_535):
    body = b"".join(struct.pack(order + "IIII", s, t, len(f), n or len(f)) + f for s, t, f, n in packets)
    return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, longest, link) + body


def ethernet(inner, kind=0x0800):
    return bytes.fromhex("0200000000020a0b0c0d0e0f") + struct.pack(">H", kind) + inner


def ipv4(inner, kind, source=(1, 2, 3, 4), target=(5, 6, 7, 8), fragment=0, options=b""):
    head = struct.pack(">BBHHHBBH", 0x45 + len(options) // 4, 0, 20 + len(inner), 0, fragment, 64, kind, 0)
    return head + bytes(source) + bytes(target) + options + inner


def ipv6(inner, kind, label=7):
    return struct.pack(">IHBB", 0x60000000 | label, len(inner), kind, 64) + bytes(15) + b"\1" + bytes.fromhex("20010db8") + bytes(11) + b"\2" + inner


TCP = struct.pack(">HHIIBBHHH", 1234, 443, 0, 0, 0x60, 0x12, 0, 0, 0) + b"opts" + b"GET /"
UDP = struct.pack(">HHHH", 53, 5353, 12, 0) + b"body"


def test_frames_of_all_kinds(spark, tmp_path):
    packets = [
        (100, 5, ethernet(ipv4(TCP, 6, options=b"\1\1\1\1")), 1500),
        (100, 6, ethernet(b"\0\5" + struct.pack(">H", 0x0800) + ipv4(UDP, 17), 0x8100), 0),
        (100, 7, ethernet(ipv6(UDP, 17), 0x86DD), 0),
        (100, 8, ethernet(ipv4(b"later part", 17, fragment=100)), 0),
        (100, 9, ethernet(struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes(6) + bytes([9, 9, 9, 9]) + bytes(6) + bytes([8, 8, 8, 8]), 0x0806), 0),
        (100, 10, ethernet(b"??", 0x1234), 0),
        (100, 11, ethernet(ipv4(TCP, 6))[:30], 99),
        (100, 12, ethernet(ipv4(TCP[:10], 6)), 0),
    ]
    (tmp_path / "a.pcap").write_bytes(pcap(packets))
    rows = {row.ts_us % 1000: row for row in read(spark, tmp_path).collect()}
    assert len(rows) == 8
    assert (rows[5].src_ip, rows[5].dst_ip, rows[5].src_port, rows[5].dst_port, rows[5].l4) == ("1.2.3.4", "5.6.7.8", 1234, 443, "TCP")
    assert (rows[5].flag_bits, bytes(rows[5].payload), rows[5].length, rows[5].src_mac) == (0x12, b"GET /", 1500, "0a:0b:0c:0d:0e:0f")
    assert (rows[6].src_port, bytes(rows[6].payload), rows[6].ip_version) == (53, b"body", 4)
    assert (rows[7].src_ip, rows[7].dst_ip, rows[7].flow_label, rows[7].next_header, rows[7].dst_port) == ("::1", "2001:db8::2", 7, 17, 5353)
    assert (rows[8].src_port, rows[8].l4, bytes(rows[8].payload)) == (None, "UDP", b"later part")
    assert (rows[9].l4, rows[9].src_ip, rows[9].dst_ip, rows[9].payload) == ("ARP", "9.9.9.9", "8.8.8.8", None)
    assert rows[10].broken == rows[11].broken == "no packet" and rows[11].length == 99
    assert rows[12].broken is None and (rows[12].src_port, rows[12].flag_bits) == (1234, None)


@pytest.mark.parametrize("order, magic, ticks", [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000), (">", 0xA1B23C4D, 1000)])
def test_byte_orders_and_units(spark, tmp_path, order, magic, ticks):
    (tmp_path / "raw.pcap").write_bytes(pcap([(7, 999_999 * ticks, ipv4(UDP, 17), 0)], order, magic, link=101))
    row = read(spark, tmp_path).first()
    assert (row.ts_us, row.src_ip, row.dst_port, row.src_mac, row.offset) == (7_999_999, "1.2.3.4", 5353, None, 24)


def test_any_split_gives_every_record_once(spark, tmp_path):
    """Payloads that look like record headers, and splits of a few bytes to the whole file."""
    rng = random.Random(4)
    decoy = struct.pack("<IIII", 1_700_000_000, 5, 40, 40)
    rows = [{"payload": rng.randbytes(rng.randrange(300)) + decoy * rng.randrange(3), "l4": rng.choice(["TCP", "UDP"])} for _ in range(400)]
    capture.write_capture(frames_of(spark, rows).coalesce(2), str(tmp_path / "in"))
    whole = sorted(map(repr, read(spark, tmp_path / "in").collect()))
    assert len(whole) == 400 and all("broken=None" in row for row in whole)
    for split in (997, 20_000):
        found = read(spark, tmp_path / "in", splitBytes=split)
        assert found.rdd.getNumPartitions() > 3 and sorted(map(repr, found.collect())) == whole


def test_damage_is_reported_and_read_past(spark, tmp_path):
    capture.write_capture(frames_of(spark, [{"payload": bytes(50)}] * 200).coalesce(1), str(tmp_path))
    file = next(tmp_path.glob("part-*.pcap"))
    data = bytearray(file.read_bytes())
    size = (len(data) - 24) // 200
    data[24 + 50 * size + 3 : 24 + 51 * size + 30] = b"\xff" * (size + 27)  # two records lost
    file.write_bytes(data[:-20])  # and the last one cut
    (tmp_path / "other.txt").write_bytes(b"no capture at all")
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "head.pcap").write_bytes(pcap([]))
    for split in (1 << 20, 5000):
        rows = read(spark, tmp_path, splitBytes=split).collect()
        whole = [row for row in rows if row.broken is None]
        assert len({row.offset for row in whole}) == len(whole) == 197
        gaps = sorted((row.file.rsplit("/")[-1][:4], row.offset, row.broken) for row in rows if row.broken)
        assert ("part", 24 + 50 * size, f"no record: {2 * size} bytes") in gaps
        assert ("part", 24 + 199 * size, f"no record: {size - 20} bytes") in gaps
        assert {name for name, *_ in gaps} == {"part", "othe", "empt"} and len(gaps) == 4


def test_a_stream_takes_new_files_and_goes_on_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    capture.register(spark)

    def put(name, count, at):
        (folder / name).write_bytes(pcap([(at + n, 0, ethernet(ipv4(UDP, 17)), 0) for n in range(count)]))

    def run_once():
        stream = spark.readStream.format("capture").option("path", str(folder)).load()
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(row.ts_us // 1_000_000 for row in spark.read.parquet(out).collect())

    put("1.pcap", 3, 100)
    put("2.pcap", 2, 200)
    assert run_once() == [100, 101, 102, 200, 201]
    put("3.pcap", 2, 300)
    assert run_once() == [100, 101, 102, 200, 201, 300, 301]
    assert run_once() == [100, 101, 102, 200, 201, 300, 301]


def test_the_packet_view_through_capture_files(spark):
    assert catalog.QUERIES["s3_capture_files"](spark, SF_DIR).count() == views.view(spark, SF_DIR, "packets").count()
