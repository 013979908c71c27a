"""Bounds and odd inputs, by hand."""

import ipaddress
import random
import uuid

import pytest
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.functions import addresses, payload, scalar
from flowsentry.operators import alerts, detect, filters, gaps, lookups, rates, rollups, sessions, stats

SECOND = 1_000_000
HOUR = 3600 * SECOND


def pids(df):
    return sorted(row["pid"] for row in df.collect())


# Sliding counts


def test_an_event_exactly_a_window_ago_does_not_count(packets_of):
    df = packets_of([{"ts_us": 0}, {"ts_us": 1}, {"ts_us": 10 * SECOND}, {"ts_us": 10 * SECOND}])
    rows = {row["pid"]: row["recent_10"] for row in rates.recent_count(df, [10]).collect()}
    assert rows == {0: 1, 1: 2, 2: 3, 3: 3}


@pytest.mark.parametrize("seed", range(3))
def test_sliding_counts_match_brute_force(spark, packets_of, seed):
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randrange(200 * SECOND), rng.randrange(40) * 5 * SECOND]) for _ in range(400))
    rows = [{"ts_us": t, "src_ip": f"s{rng.randrange(3)}"} for t in times]
    found = rates.recent_count(packets_of(rows), [5, 10, 60]).collect()
    assert len(found) == len(rows)
    for row in found:
        for window in (5, 10, 60):
            low = row["ts_us"] - window * SECOND
            expected = sum(r["src_ip"] == row["src_ip"] and low < r["ts_us"] <= row["ts_us"] for r in rows)
            assert row[f"recent_{window}"] == expected


def test_windows_must_fit_the_cells(packets_of):
    with pytest.raises(ValueError):
        rates.sliding_counts(packets_of([{}]), [7])


@pytest.mark.parametrize("count, hits", [(200, 0), (201, 1), (203, 3)])
def test_syn_flood_needs_more_than_200(packets_of, count, hits):
    df = packets_of([{"ts_us": 55 * SECOND + n * 40_000, "flags": "SYN"} for n in range(count)])
    assert detect.syn_flood(df).count() == hits


def test_flood_across_a_minute_border_counts_both_sides(packets_of):
    times = [59 * SECOND + n * 9_000 for n in range(110)] + [60 * SECOND + n * 9_000 for n in range(110)]
    df = packets_of([{"ts_us": t, "flags": "SYN"} for t in times])
    assert pids(detect.syn_flood(df)) == list(range(200, 220))


def test_pruning_changes_no_finding(packets_of):
    rng = random.Random(5)
    rows = [
        {
            "ts_us": int(rng.choice([60, 119, 180, 300]) * SECOND + rng.random() * 4 * SECOND),
            "protocol": rng.choice(["TCP", "ICMP", "UDP", "HTTP"]),
            "flags": "SYN",
            "src_ip": rng.choice(["a", "a", "b", "c"]),
        }
        for _ in range(3000)
    ]
    df = packets_of(rows)
    rules = [rule._replace(threshold=rule.threshold // 4) for rule in detect.RATE_RULES]
    found = {(row["pid"], row["rule"]) for row in detect.rate_findings(df, rules).collect()}
    counted = rates.recent_count(df, [5, 10, 60]).collect()
    expected = {
        (row["pid"], rule.rule)
        for row in counted
        for rule in rules
        if row["protocol"] == rule.protocol and row[f"recent_{rule.seconds}"] > rule.threshold
    }
    assert expected and found == expected


# Sessions, counters, sums, sets


def test_a_gap_of_exactly_an_hour_keeps_the_session(packets_of):
    df = packets_of([{"ts_us": 7}, {"ts_us": 7 + HOUR}, {"ts_us": 8 + 2 * HOUR}])
    hours = sessions.session_hours(df)
    found = {row["pid"]: row["sid"] for row in sessions.with_session_ids(df, hours).collect()}
    assert found == {0: 0, 1: 0, 2: 1}


def test_ssh_counter_restarts_after_an_idle_hour(packets_of):
    times = [n * SECOND for n in range(6)] + [2 * HOUR + n * SECOND for n in range(6)]
    df = packets_of([{"ts_us": t, "protocol": "SSH"} for t in times])
    assert pids(detect.ssh_brute_force(df)) == [4, 10]


@pytest.mark.parametrize("ports, hits", [(50, 0), (51, 1), (102, 2), (101, 1)])
def test_port_scan_needs_more_than_50_ports(packets_of, ports, hits):
    df = packets_of([{"dst_port": n + 1} for n in range(ports)])
    assert detect.port_scan(df).count() == hits


def test_port_zero_and_missing_ports_do_not_count(packets_of):
    rows = [{"dst_port": n + 1} for n in range(50)] + [{"dst_port": 0}, {"dst_port": None}]
    assert detect.port_scan(packets_of(rows)).count() == 0


def test_exfil_fires_above_the_limit_and_restarts(packets_of):
    df = packets_of([{"length": 5_000_000}] * 2 + [{"length": 1}] + [{"length": 10_000_000}, {"length": 1}])
    assert pids(detect.exfil(df)) == [2, 4]


def test_beacon_needs_six_events(packets_of):
    def beacon(count):
        return packets_of([{"ts_us": n * 60 * SECOND, "protocol": "HTTP"} for n in range(count)])

    assert detect.c2_beacon(beacon(5)).count() == 0
    assert pids(detect.c2_beacon(beacon(7))) == [5, 6]


@pytest.mark.parametrize("gap, hits", [(20, 0), (21, 1), (299, 1), (300, 0)])
def test_beacon_gap_bounds_are_strict(packets_of, gap, hits):
    df = packets_of([{"ts_us": n * gap * SECOND, "protocol": "HTTP"} for n in range(6)])
    assert detect.c2_beacon(df).count() == hits


@pytest.mark.parametrize("limit", [12, None])
@pytest.mark.parametrize("seed", range(3))
def test_gaps_match_brute_force(packets_of, seed, limit):
    rng = random.Random(seed)
    busy, quiet = [rng.randrange(HOUR, 2 * HOUR) for _ in range(60)], [rng.randrange(5 * HOUR) for _ in range(40)]
    # Some events share a microsecond, some lie exactly an hour apart.
    times = sorted([*busy, *quiet, HOUR, HOUR, 2 * HOUR, 2 * HOUR, busy[0] + HOUR])
    packets = packets_of([{"ts_us": t} for t in times])
    stats = gaps.sparse_interarrival_stats(packets, limit) if limit else gaps.interarrival_stats(packets)
    found = {row["pid"]: row for row in stats.collect()}
    for pid, now in enumerate(times):
        history = [t for t in times if now - HOUR <= t <= now]
        if not 2 <= len(history) <= (limit or len(times)):
            assert pid not in found
            continue
        steps = [(b - a) / SECOND for a, b in zip(history, history[1:])]
        mean = sum(steps) / len(steps)
        assert found[pid]["n_events"] == len(history)
        assert found[pid]["avg_gap"] == pytest.approx(mean)
        assert found[pid]["var_gap"] == pytest.approx(sum((s - mean) ** 2 for s in steps) / len(steps), abs=1e-5)


# Addresses


def test_private_addresses_match_the_standard_library(spark):
    rng = random.Random(3)
    texts = ["", "abc", "1.2.3", "01.2.3.4", "256.1.1.1", "1.2.3.4.5", "1.2.3.4 ", "192.0.0.9", "192.0.0.90", "100.64.0.1"]
    texts += ["::", "::1", ":::", "1::2::3", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0", "fe80::1%", "::1.2.3"]
    texts += ["2001:db8::1", "2001:4:112::7", "2001:20::1", "fe00::", "febf::1", "12345::", "1:2:3:4:5:6:1.2.3.4"]
    octets = [0, 9, 10, 16, 31, 32, 51, 100, 113, 127, 168, 169, 172, 192, 198, 203, 240, 254, 255, 256]
    texts += [".".join(str(rng.choice(octets)) for _ in range(4)) for _ in range(500)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]

    def expected(text):
        try:
            return ipaddress.ip_address(text).is_private
        except ValueError:
            return False

    df = spark.createDataFrame([(text,) for text in texts], "ip string")
    for row in df.select("ip", addresses.is_private("ip").alias("private")).collect():
        assert row["private"] == expected(row["ip"]), row["ip"]


# Payloads


def one(spark, column, **values):
    kinds = {int: "bigint", str: "string", bytes: "binary", float: "double"}
    schema = ", ".join(f"{name} {kinds.get(type(value), 'bigint')}" for name, value in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_entropy(spark):
    column = payload.payload_entropy("p")
    assert one(spark, column, p=b"") == 0.0
    assert one(spark, column, p=b"aaaa") == 0.0
    assert one(spark, column, p=b"abab") == 1.0
    assert one(spark, column, p=bytes(range(256))) == 8.0
    assert one(spark, column, p=b"abc") == 1.585


@pytest.mark.parametrize(
    "data, name",
    [
        (b"GET / HTTP/1.1", "HTTP"),
        (b"POST /x", "HTTP"),
        (b"HTTP/1.0 200", "HTTP"),
        (b"GETTING", None),
        (b"\x16\x03\x01", "TLS"),
        (b"\x16\x02\x01", None),
        (b"..SSH-2.0", "SSH"),
        (b"", None),
    ],
)
def test_payload_signature(spark, data, name):
    assert one(spark, payload.payload_signature("p"), p=data) == name


@pytest.mark.parametrize(
    "version, label, header, expected",
    [(6, 0, 6, False), (6, 1, 6, True), (6, 0, 44, True), (6, 0, None, True), (4, 1, 0, False)],
)
def test_ipv6_anomaly(spark, version, label, header, expected):
    assert one(spark, payload.ipv6_anomaly("v", "l", "h"), v=version, l=label, h=header) is expected


def test_classification_order(spark):
    rows = [(8080, 22, "TCP"), (40000, 22, "TCP"), (40000, 40001, "UDP"), (80, 80, None), (None, None, "TCP")]
    df = spark.createDataFrame(rows, "dst_port int, src_port int, l4 string")
    names = [row["port_protocol"] for row in lookups.port_protocol(df).collect()]
    assert names == ["HTTP", "SSH", "UDP", "UNKNOWN", "TCP"]


@pytest.mark.parametrize("bits, text", [(0, "NONE"), (2, "SYN"), (18, "SYN|ACK"), (63, "SYN|ACK|RST|FIN|PSH|URG"), (64, "NONE")])
def test_flags(spark, bits, text):
    assert one(spark, scalar.parse_flags("b"), b=bits) == text


@pytest.mark.parametrize("version, hit", [("0300", True), ("0301", True), ("0302", True), ("0303", False), ("0304", False)])
def test_old_tls(packets_of, version, hit):
    hello = f"160301004A02000046{version}AABB"
    df = packets_of([{"protocol": "TLS", "payload_hex": hello}])
    assert detect.tls_old_version(df).count() == int(hit)


def test_old_tls_ignores_client_hello_and_short_payloads(packets_of):
    df = packets_of([{"protocol": "TLS", "payload_hex": h} for h in ("160301004A010000460301", "1603", None)])
    assert detect.tls_old_version(df).count() == 0


def test_ftp_failures_per_minute(packets_of):
    bad, good = "353330204E6F", "323330204F6B"
    rows = [{"ts_us": n * SECOND, "payload_hex": bad} for n in range(5)]
    rows += [{"ts_us": 70 * SECOND + n, "payload_hex": bad} for n in range(4)]
    rows += [{"ts_us": 80 * SECOND, "payload_hex": good}]
    assert pids(detect.ftp_auth_fail(packets_of(rows, protocol="FTP"))) == [4]


def test_arp_spoof(packets_of):
    rows = [{"ts_us": n * SECOND, "src_ip": ip} for n, ip in enumerate("aabb")]
    mac = F.when(F.col("pid") == 1, "m2").otherwise("m1")
    assert pids(detect.arp_spoof(packets_of(rows, protocol="ARP").withColumn("src_mac", mac))) == [1]


# Filters, tops, rollups


def test_limits(packets_of):
    df = packets_of([{}, {}, {}])
    assert filters.recent_events(df, 0).count() == 0
    with pytest.raises(ValueError):
        filters.recent_events(df, -1)


def test_wildcards_and_letter_case_in_search(packets_of):
    df = packets_of([{"flags": "SYN"}, {"flags": "SAN"}, {"flags": None, "src_ip": "syn"}])
    assert pids(filters.search_events(df, query="s_n")) == [0, 1, 2]
    assert pids(filters.search_events(df, src_ip="10.0")) == [0, 1]
    assert pids(filters.search_events(df, protocol="tcp")) == []


def test_literal_search(packets_of):
    df = packets_of([{"flags": "S_N"}, {"flags": "SYN"}, {"flags": "xs_ny"}])
    assert pids(df.where(scalar.like_contains("flags", "s_n", wildcards=False))) == [0, 2]


def test_since_is_strict_and_prunes_days(spark, packets_of):
    day = 86400 * SECOND
    df = packets_of([{"ts_us": n * day} for n in range(5)])
    assert pids(filters.since(df, 4 * day, 86400)) == [4]
    dated = df.withColumn("dt", F.to_date(scalar.timestamp_of()))
    assert pids(filters.since(dated, 4 * day, 2 * 86400)) == [3, 4]


def test_overview_defaults(spark, packets_of):
    from flowsentry import schemas

    empty = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    row = stats.overview_stats(
        packets_of([{}]),
        empty["alerts"],
        empty["threats"],
        empty["mitre_events"],
        empty["performance_metrics"],
        as_of_us=0,
    ).first()
    assert row["packets_per_min"] == 0 and row["accuracy_pct"] == 99.2 and row["active_threats"] == 0


def test_unknown_technique(spark):
    df = spark.createDataFrame([("nope",), ("ddos",)], "mitre_key string")
    ids = {row["mitre_key"]: row["technique_id"] for row in lookups.mitre_lookup(df).collect()}
    assert ids == {"nope": "T0000", "ddos": "T1498"}


def test_technique_catalog_has_14_rows(spark):
    assert dims.technique_catalog(spark).select("technique_id").distinct().count() == 14


def test_every_rule_has_a_known_technique():
    assert {key for _, key, _ in dims.RULES} <= {row[0] for row in dims.TECHNIQUES}


def test_connection_directions(packets_of):
    a, b = {"src_ip": "9.9.9.9", "dst_ip": "1.1.1.1"}, {"src_ip": "1.1.1.1", "dst_ip": "9.9.9.9"}
    ports = {"src_port": 5, "dst_port": 80}
    rows = [{**a, **ports, "length": 10}, {**b, "src_port": 80, "dst_port": 5, "length": 70, "flags": "FIN|ACK"}]
    row = rollups.connections(packets_of(rows)).collect()
    assert len(row) == 1
    assert (row[0]["src_ip"], row[0]["dst_port"], row[0]["bytes_sent"], row[0]["bytes_recv"], row[0]["state"]) == (
        "9.9.9.9", 80, 10, 70, "CLOSED",
    )


def test_geo_ranges_at_their_ends(spark, packets_of):
    low = 167772160
    ranges = spark.createDataFrame(
        [(low, low + 1, "RU", "x", 1.0, 2.0), (low + 3, low + 200_000, "US", "y", 3.0, 4.0)],
        "lo long, hi long, country string, city string, latitude double, longitude double",
    )
    ips = ["9.255.255.255", "10.0.0.0", "10.0.0.1", "10.0.0.2", "10.0.0.3", "10.1.0.0", "10.3.13.64", "10.3.13.67", "bad"]
    packets = packets_of([{"src_ip": ip} for ip in ips])
    everything = lookups.geo_enrich(packets, ranges).collect()
    assert len(everything) == len(ips) and sum(row["country"] is None for row in everything) == 4
    placed = lookups.geo_enrich(packets, ranges, keep_unmatched=False)
    found = {row["src_ip"]: (row["country"], row["is_threat"]) for row in placed.collect()}
    assert found == {
        "10.0.0.0": ("RU", 1),
        "10.0.0.1": ("RU", 1),
        "10.0.0.3": ("US", 0),
        "10.1.0.0": ("US", 0),
        "10.3.13.64": ("US", 0),
    }


def test_alerts_and_hits_share_keys(packets_of):
    df = packets_of([{"protocol": "ICMP", "length": 2000}, {"protocol": "NTP", "length": 500}])
    findings = detect.row_rules(df)
    ids = {row["id"] for row in alerts.build_alerts(findings).collect()}
    hits = alerts.build_mitre_events(findings).collect()
    assert {row["alert_id"] for row in hits} == ids and len({row["id"] for row in hits}) == 2


def test_ties_at_the_rank_border(packets_of):
    """Histories that a rank limit cuts among packets of one time must not look shorter."""
    times = [0, 5, 5, 5, 5, 9, 9, 9, 20, 20, 20, 20, 20, 20, 20, 31]
    df = packets_of([{"ts_us": t * SECOND} for t in times])
    for most in range(2, 9):
        want = gaps.interarrival_stats(df).where(F.col("n_events").between(2, most)).select("pid", "n_events")
        got = gaps.sparse_interarrival_stats(df, most).select("pid", "n_events")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_backslashes_in_search_are_characters(packets_of):
    df = packets_of([{"flags": "a\\b"}, {"flags": "ab"}, {"flags": "a\\"}, {"flags": "a%"}])
    assert pids(filters.search_events(df, query="a\\b")) == [0]
    assert pids(filters.search_events(df, query="a\\")) == [0, 2]


def test_running_numbers_match_brute_force(packets_of):
    rng = random.Random(5)
    rows = [{"ts_us": rng.randrange(60) * SECOND // 2, "src_ip": f"s{rng.randrange(2)}"} for _ in range(200)]
    found = {row["pid"]: row["measure"] for row in rates.numbered(packets_of(rows), ["src_ip"]).collect()}
    for source in ("s0", "s1"):
        own = sorted((r["ts_us"], pid) for pid, r in enumerate(rows) if r["src_ip"] == source)
        assert [found[pid] for _, pid in own] == list(range(1, len(own) + 1))


def test_all_findings_read_the_packets_three_times(spark, packets_of):
    """Counted by the rows that leave the input; a shuffle that samples would show as well."""
    rows = [{"ts_us": n * 10_000, "flags": "SYN", "dst_port": 1 + n % 70} for n in range(1000)]
    rows += [{"ts_us": n * SECOND, "protocol": p, "src_ip": "b"} for n in range(300) for p in ("DNS", "SSH")]
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    packets = packets_of(rows).drop(*detect.PAYLOAD_COLUMNS)
    assert detect.all_findings(packets.mapInArrow(count, packets.schema)).count() > 0
    assert passed.value == 3 * len(rows)


def test_newest_rows_come_from_the_last_days(spark, packets_of, tmp_path):
    from flowsentry.sources import tables

    day = 86400 * SECOND
    tables.append(packets_of([{"ts_us": n * day + k} for n in range(20) for k in range(5)]), "packets", str(tmp_path))
    stored, days = tables.scan_packets(spark, str(tmp_path)), tables.days(spark, str(tmp_path))
    assert len(days) == 20 and days == sorted(days) and tables.days(spark, str(tmp_path / "none")) == []

    def jobs_of(function):
        group = f"newest-{uuid.uuid4()}"
        spark.sparkContext.setJobGroup(group, "newest rows")
        found = function()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, jobs

    for limit, spans in ((0, 0), (3, 1), (5, 1), (12, 2), (1000, 5)):
        found, jobs = jobs_of(lambda: filters.recent_events(stored, limit, days))
        assert sorted(pids(found)) == sorted(range(100))[max(0, 100 - limit) :] == sorted(pids(filters.recent_events(stored, limit)))
        assert jobs == spans
    # A filter goes on over the days until it has enough: no row is lost, none is read twice.
    wanted = stored.where("pid % 9 = 0")
    found, jobs = jobs_of(lambda: filters.newest(wanted, 4, "pid", days))
    assert [row["pid"] for row in found.collect()] == [99, 90, 81, 72] and jobs == 3
    assert filters.newest(wanted, filters.PAGE + 1, "pid", days).count() == 12


def test_a_filter_on_an_address_skips_row_groups(spark, packets_of, tmp_path):
    """Files and row groups without the address are skipped by its Bloom filter: the scan gives fewer rows than the day has."""
    from flowsentry.sources import tables

    rows = [{"ts_us": n * 1000, "src_ip": f"10.0.{n // 1000}.{n % 7}"} for n in range(8000)]
    path = str(tmp_path / "packets")
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # so few rows would be one file
    try:
        tables.append(packets_of(rows), "packets", path)
    finally:
        spark.conf.set(coalesced, "true")
    wanted = tables.scan_packets(spark, path).where(F.col("src_ip") == "10.0.3.5")
    assert wanted.count() == 143
    plan = wanted.select("pid")
    plan.collect()
    scanned = plan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 143 <= scanned <= 3000


def test_prepare_resets_the_batches_that_another_operator_has_bounded(spark):
    from flowsentry.session import prepare

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    assert prepare(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_broken_messages_go_to_quarantine(spark):
    from flowsentry.sources import tables

    good = '{"pid": 1, "ts_us": 5, "src_ip": "a", "dst_ip": "b", "protocol": "TCP", "length": 7}'
    raw = spark.createDataFrame([(good.encode(),), (b"not json",), (b'{"pid": 2}',), (None,)], "value binary")
    packets, broken = tables.parse_messages(raw)
    assert [(row["pid"], row["length"], row["flags"]) for row in packets.collect()] == [(1, 7, None)]
    assert broken.columns == ["value"] and broken.count() == 3


def test_declared_thresholds_of_arp_ftp_and_udp(spark, packets_of):
    arp = [{"protocol": "ARP", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.1" if n < 6 else "10.0.0.3"} for n in range(9)]
    few = [{"protocol": "ARP", "src_ip": "10.0.0.2", "dst_ip": "10.0.0.2"}] * 5
    ftp = [{"protocol": "FTP", "src_ip": "10.0.0.4", "src_port": 20, "dst_port": 3000 + n} for n in range(21)]
    control = [{"protocol": "FTP", "src_ip": "10.0.0.5", "src_port": 21, "dst_port": 3000 + n} for n in range(40)]
    asked = [{"protocol": "UDP", "src_ip": "10.0.0.6", "dst_ip": "10.0.0.7", "length": 50}]
    answers = [{"protocol": "UDP", "src_ip": "10.0.0.7", "dst_ip": "10.0.0.6", "length": 500 + n} for n in (0, 1)]
    silent = [{"protocol": "UDP", "src_ip": "10.0.0.8", "dst_ip": "10.0.0.9", "length": 9000}]
    packets = packets_of([{**row, "ts_us": n * 100_000} for n, row in enumerate(arp + few + ftp + control + asked + answers + silent)])
    found = {(row["src_ip"], row["metric"]): row["value"] for row in rollups.threshold_rules(packets).collect()}
    assert found == {("10.0.0.1", "gratuitous"): 6.0, ("10.0.0.4", "data_conn"): 21.0, ("10.0.0.6", "amp_factor"): 20.02}
