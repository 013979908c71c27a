"""Runs that go on from each other against one run."""

import random

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import carry, detect, rollups
from flowsentry.plans import batch_job, catalog
from flowsentry.plans.dashboard import Dashboard
from flowsentry.plans.views import view
from flowsentry.sources import tables

SF_DIR = "/root/testdata/sf0.01"
SECOND = 1_000_000
MINUTE = 60 * SECOND


def rows(df):
    return sorted(tuple(row) for row in df.select(*detect.FINDING_COLUMNS).collect())


def chain(packets, cuts, root):
    """Findings of runs that end at the cuts, and the connection parts of all runs."""
    edges, found, parts, entry = [-1, *cuts, 1 << 60], [], [], None
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        part = packets.where((F.col("ts_us") > low) & (F.col("ts_us") <= high))
        goes_on = number < len(cuts)
        run = detect.run_findings(part, entry, goes_on)
        found += rows(run.findings)
        rollups.connection_parts(part, entry and entry.connections).write.parquet(f"{root}/parts/run={number}")
        parts = packets.sparkSession.read.parquet(f"{root}/parts/run={number}")
        if goes_on:
            carry.write(detect.leaves(run, rollups.open_connections(parts, run.border_us)), root, f"run={number}")
            entry = carry.read(packets.sparkSession, root, f"run={number}")
    return sorted(found), packets.sparkSession.read.parquet(f"{root}/parts")


def test_payload_packets_cut_inside_minutes(spark, tmp_path):
    packets = tables.to_table(view(spark, SF_DIR, "payload_packets"), "packets").withColumn("payload", F.unhex("payload_hex"))
    packets = packets.withColumn("length", F.octet_length("payload")).na.fill(0, ["length"]).cache()
    start = packets.agg(F.min("ts_us")).first()[0]
    found, parts = chain(packets, [start + 7 * SECOND + 3], str(tmp_path))
    expected = rows(detect.all_findings(packets))
    assert {"ftp_auth_fail", "arp_spoof"} <= {row[5] for row in expected}
    assert found == expected
    connections = rollups.merged_connections(parts.where("pkt_count > 0"))
    whole = rollups.connections(packets)
    assert sorted(map(tuple, connections.collect())) == sorted(map(tuple, whole.select(*connections.columns).collect()))


@pytest.fixture(scope="module")
def mixture(spark):
    """Rules that build up, dense around a few borders: counters, sums that reset, port sets, beacons, floods, idle hours."""
    rng = random.Random(11)
    rows, at = [], 10_000 * SECOND
    for step in range(1500):
        at += rng.choice([1000, 40_000, 300_000, 2 * SECOND, 25 * SECOND]) if step % 900 else 3601 * SECOND
        kind = rng.choice([0, 1, 1, 2, 3, 4, 5])
        base = {"ts_us": at, "src_ip": f"10.0.0.{rng.randrange(2)}", "dst_ip": f"10.0.1.{rng.randrange(2)}"}
        rows.append(
            base
            | [
                {"protocol": "SSH", "dst_port": 22},
                {"protocol": "DNS", "dst_port": 53},
                {"protocol": "TCP", "dst_port": rng.randrange(90), "flags": "SYN"},
                {"protocol": "TCP", "dst_port": rng.randrange(1, 400), "flags": "SYN"},
                {"protocol": "HTTPS", "length": rng.choice([900_000, 1_400_000])},
                {"protocol": "ICMP", "length": 1200},
            ][kind]
        )
    beacon = {"protocol": "HTTP", "src_ip": "10.9.9.9", "dst_ip": "10.0.1.1"}
    rows += [{**beacon, "ts_us": 10_000 * SECOND + n * 40 * SECOND + (n % 3) * SECOND} for n in range(200)]
    burst = {"protocol": "TCP", "flags": "SYN", "src_ip": "10.8.8.8", "dst_ip": "10.0.1.1", "dst_port": 80}
    rows += [{**burst, "ts_us": 10_500 * SECOND + n * 30_000} for n in range(900)]
    rows += [{**burst, "protocol": "ICMP", "src_ip": "10.7.7.7", "ts_us": 10_590 * SECOND + n * 80_000} for n in range(600)]
    rows.sort(key=lambda row: row["ts_us"])
    return [{**row, "pid": n} for n, row in enumerate(rows)]


def test_runs_cut_anywhere(spark, packets_of, mixture, tmp_path):
    """Cuts in the flood, between beacons, and late, with a run without packets among them."""
    packets = packets_of(mixture).drop("payload").cache()
    found, _ = chain(packets, [10_510 * SECOND + 7, 10_510 * SECOND + 8, mixture[1500]["ts_us"]], str(tmp_path))
    expected = rows(detect.all_findings(packets))
    raised = {row[5] for row in expected}
    assert {"port_scan", "syn_flood", "icmp_flood", "c2_beacon", "dns_recon", "ssh_brute_force", "exfil"} <= raised
    assert found == expected


def test_a_replayed_run_changes_nothing(spark, packets_of, mixture, tmp_path):
    packets, root = packets_of(mixture), str(tmp_path)
    cut = mixture[700]["ts_us"]
    early, late = packets.where(F.col("ts_us") <= cut), packets.where(F.col("ts_us") > cut)
    batch_job.analyze(early, root, "one", goes_on=True)
    for _ in range(2):
        batch_job.analyze(late, root, "two", after="one", goes_on=True)
        left = carry.read(spark, f"{root}/state", "run=two")
        state = {name: sorted(map(repr, getattr(left, name).collect())) for name in carry.Carried._fields[1:]}
        findings = rows(spark.read.parquet(f"{root}/findings"))
        if _:
            assert state == before and findings == found
        before, found = state, findings
    assert findings == rows(detect.all_findings(packets))
    with pytest.raises(ValueError):
        batch_job.analyze(early, root, "three", after="two")
    assert Dashboard(spark, root, 0).threats().groupBy("src_ip", "threat_type").count().where("count > 1").count() == 0


def test_what_is_left(spark, packets_of):
    """Sets and sums since the last hit, nothing of idle sources."""
    probes = [{"ts_us": n * SECOND, "dst_port": 1 + n} for n in range(60)]
    idle = [{"ts_us": 0, "src_ip": "10.0.0.9", "protocol": "SSH", "length": 70}]
    end = [{"ts_us": 3700 * SECOND, "src_ip": "10.0.0.5", "length": 9_000_000}, {"ts_us": 3701 * SECOND, "src_ip": "10.0.0.5", "length": 2_000_000}]
    last = [{"ts_us": 3702 * SECOND, "src_ip": "10.0.0.5", "length": 3, "protocol": "DNS", "dst_port": 53}]
    packets = packets_of([{**row, "pid": n} for n, row in enumerate(probes + idle + end + last)])
    run = detect.run_findings(packets, goes_on=True)
    parts = rollups.connection_parts(packets)
    left = detect.leaves(run, rollups.open_connections(parts, run.border_us))
    assert left.border_us == 3702 * SECOND
    # The 51st port is a hit, so 9 are left; port 80 of the other source is a set of its own.
    sets = {row.src_ip: sorted(row.ports) for row in left.ports.collect()}
    assert sets == {"10.0.0.1": list(range(52, 61)), "10.0.0.5": [80]}
    assert [tuple(row) for row in left.sources.collect()] == [("10.0.0.5", 3702 * SECOND, 1, 0, 3)]
    assert left.recent.count() == 3 and left.events.count() == 3
    assert {row.src_ip for row in detect.leaves(run, parts, 60).ports.collect()} == {"10.0.0.5"}


def test_catalog_query_cuts_attacks(spark):
    packets = view(spark, SF_DIR, "packets")
    parts = [part.count() for part in catalog._stretches(packets, 3)]
    assert sum(parts) == packets.count() and min(parts) > 2000
