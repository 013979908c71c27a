"""Streams over several micro-batches against the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from flowsentry.functions import payload
from flowsentry.operators import detect, lookups, ordered
from flowsentry.plans import catalog
from flowsentry.sources import tables
from flowsentry.streaming import jobs, live, rollups, state

SF_DIR = "/root/testdata/sf0.01"
SECOND = 1_000_000


@pytest.fixture(scope="module")
def ordered_files(spark, tmp_path_factory):
    """The packet view in five files, in the order of time."""
    path = str(tmp_path_factory.mktemp("ordered") / "packets")
    packets = tables.to_table(catalog.view(spark, SF_DIR, "packets"), "packets").drop("dt").cache()
    edges = packets.approxQuantile("ts_us", [0.2, 0.4, 0.6, 0.8], 0.0)
    for low, high in zip([0, *edges], [*edges, 1e18]):
        part = packets.where((F.col("ts_us") >= low) & (F.col("ts_us") < high))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    packets.unpersist()
    return path


def files_of(spark, tmp_path, batches, schema_of=None):
    path = str(tmp_path / "in")
    for batch in batches:
        tables.to_table(batch, "packets").drop("dt").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def run(stream, tmp_path):
    return jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))


def rows_of(df):
    return sorted(tuple(row) for row in df.select(*detect.FINDING_COLUMNS).collect())


@pytest.mark.parametrize(
    "streaming, batch",
    [
        (rollups.stream_row_rules, [detect.row_rules]),
        (state.stream_port_scan, [detect.port_scan]),
        (
            state.stream_source_rules,
            [
                lambda packets: detect.rate_findings(packets, detect.RATE_RULES),
                detect.c2_beacon,
                detect.dns_recon,
                detect.ssh_brute_force,
                detect.exfil,
            ],
        ),
    ],
)
def test_stream_gives_the_batch_findings(spark, ordered_files, tmp_path, streaming, batch):
    stream = tables.packet_stream(spark, ordered_files, max_files=1)
    found = run(streaming(stream), tmp_path)
    packets = catalog.view(spark, SF_DIR, "packets")
    assert rows_of(found) == rows_of(detect.union_findings(*[rule(packets) for rule in batch]))


def test_late_rows_are_dropped(spark, packets_of, tmp_path):
    on_time = packets_of([{"ts_us": n * 60 * SECOND} for n in range(10)])
    # A micro-batch drops what is older than the watermark of the one before it.
    between = packets_of([{"ts_us": 599 * SECOND}])
    late = packets_of([{"ts_us": 30 * SECOND}, {"ts_us": 570 * SECOND}, {"ts_us": 1200 * SECOND}])
    path = files_of(spark, tmp_path, [on_time, between, late])
    for watermark, first_minute in (("1 minute", 1), ("1 hour", None)):
        folder = tmp_path / watermark.replace(" ", "")
        folder.mkdir()
        stream = tables.packet_stream(spark, path, watermark, max_files=1)
        found = run(rollups.stream_protocol_stats(stream), folder)
        counts = {row["bucket"]: row["pkt_count"] for row in found.collect()}
        assert counts.get(0) == first_minute
        if watermark == "1 minute":
            # The second late row is younger than the watermark and still counts.
            assert counts[540] == 3


def test_state_of_an_idle_source_is_dropped(spark, packets_of, tmp_path):
    ssh = {"protocol": "SSH"}
    early = packets_of([{**ssh, "ts_us": n * SECOND} for n in range(4)])
    other = packets_of([{"ts_us": 4000 * SECOND, "src_ip": "other"}, {"ts_us": 8000 * SECOND, "src_ip": "other"}])
    back = packets_of([{**ssh, "ts_us": 9000 * SECOND + n} for n in range(5)])
    path = files_of(spark, tmp_path, [early, other, back])
    stream = tables.packet_stream(spark, path, max_files=1)
    found = run(state.stream_counters(stream), tmp_path).collect()
    # Without the reset the fifth attempt would be the first packet of the last batch.
    assert [row["ts_us"] for row in found] == [9000 * SECOND + 4]


def test_alert_writer_keeps_alerts_and_hits_together(spark, ordered_files, tmp_path):
    stream = tables.packet_stream(spark, ordered_files, max_files=2)
    paths = [str(tmp_path / name) for name in ("alerts", "hits", "checkpoint")]
    jobs.alert_writer(rollups.stream_row_rules(stream), *paths).trigger(availableNow=True).start().awaitTermination()
    alerts, hits = tables.scan_alerts(spark, paths[0]), tables.scan_mitre(spark, paths[1])
    expected = detect.row_rules(catalog.view(spark, SF_DIR, "packets")).count()
    assert alerts.count() == hits.count() == expected
    assert hits.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_anti").count() == 0


def test_rollup_in_update_mode(spark, ordered_files, tmp_path):
    stream = tables.packet_stream(spark, ordered_files, watermark="40 days", max_files=1)
    path, expected = str(tmp_path / "rollup"), catalog.QUERIES["a13_protocol_stats"](spark, SF_DIR)
    for checkpoint in ("checkpoint", "a new one"):  # a new checkpoint counts batches from 0 again
        writer = jobs.rollup_writer(rollups.stream_protocol_stats(stream), path, str(tmp_path / checkpoint), ["bucket", "protocol"])
        writer.trigger(availableNow=True).start().awaitTermination()
        found = jobs.read_rollup(spark, path)
        assert found.groupBy("bucket", "protocol").count().where("count > 1").count() == 0
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select(*found.columns).collect()))


def test_a_rollup_survives_a_crash_between_staging_and_the_table(spark, packets_of, tmp_path, monkeypatch):
    batches = [packets_of([{"ts_us": (60 + n + 30 * part) * SECOND} for n in range(40)]) for part in range(3)]
    stream = tables.packet_stream(spark, files_of(spark, tmp_path, batches), "1 hour", max_files=1)
    path, checkpoint = str(tmp_path / "rollup"), str(tmp_path / "checkpoint")

    def run_once():
        writer = jobs.rollup_writer(rollups.stream_protocol_stats(stream), path, checkpoint, ["bucket", "protocol"])
        writer.trigger(availableNow=True).start().awaitTermination()

    remove = tables.remove
    monkeypatch.setattr(tables, "remove", lambda *args: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run_once()
    monkeypatch.setattr(tables, "remove", remove)
    run_once()
    found = {row["bucket"]: row["pkt_count"] for row in jobs.read_rollup(spark, path).collect()}
    assert found == {60: 70, 120: 50}


def test_the_live_job_commits_all_tables_or_none(spark, packets_of, tmp_path, monkeypatch):
    """The writer dies between two tables of the second micro-batch; a restart completes it."""
    batches = [packets_of([{"ts_us": (n + 10 * part) * SECOND, "pid": n + 10 * part, "protocol": "ICMP", "length": 2000} for n in range(5)]) for part in range(3)]
    stream = tables.packet_stream(spark, files_of(spark, tmp_path, batches), max_files=1)
    root, checkpoint = str(tmp_path / "live"), str(tmp_path / "checkpoint")

    def counts():
        return [live.read_committed(spark, root, name).count() for name in ("findings", "alerts", "mitre_events")]

    def run_once():
        live.live_writer(rollups.stream_row_rules(stream), root, checkpoint).trigger(availableNow=True).start().awaitTermination()

    write, calls = live._write, []

    def dying(rows, path):
        calls.append(path)
        if len(calls) == 5:
            raise OSError("lost")
        write(rows, path)

    monkeypatch.setattr(live, "_write", dying)
    with pytest.raises(Exception, match="lost"):
        run_once()
    assert counts() == [5, 5, 5]
    assert spark.read.parquet(f"{root}/findings").count() == 10  # written, and not seen
    monkeypatch.setattr(live, "_write", write)
    run_once()
    assert counts() == [15, 15, 15]
    alerts, hits = (live.read_committed(spark, root, name) for name in ("alerts", "mitre_events"))
    assert hits.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_anti").count() == 0


def test_a_replayed_commit_writes_nothing(spark, packets_of, tmp_path, monkeypatch):
    """The writer dies after the commit, before the checkpoint knows: the batch comes again."""
    batch = packets_of([{"protocol": "ICMP", "length": 2000}])
    stream = tables.packet_stream(spark, files_of(spark, tmp_path, [batch]), max_files=1)
    root, checkpoint = str(tmp_path / "live"), tmp_path / "checkpoint"
    writer = live.live_writer(rollups.stream_row_rules(stream), root, str(checkpoint))
    writer.trigger(availableNow=True).start().awaitTermination()
    for name in ("0", ".0.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    writer = live.live_writer(rollups.stream_row_rules(stream), root, str(checkpoint))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert live.read_committed(spark, root, "alerts").count() == spark.read.parquet(f"{root}/alerts").count() == 1


def test_port_sets_keep_one_entry_a_port_and_may_end(spark, packets_of, tmp_path):
    """A set goes on over micro-batches; with an idle limit it ends, also for a pause inside a micro-batch."""
    first = packets_of([{"ts_us": (10 + n) * SECOND, "dst_port": 1 + n} for n in range(30)])
    second = packets_of([{"ts_us": (110 + n) * SECOND, "dst_port": 20 + n, "pid": 100 + n} for n in range(40)])
    third = packets_of([{"ts_us": (9000 + n) * SECOND, "dst_port": 500 + n, "pid": 200 + n} for n in range(60)])
    path = files_of(spark, tmp_path, [first, second, third])
    expected = detect.port_scan(first.unionByName(second).unionByName(third))
    for idle, pids in ((None, sorted(row["pid"] for row in expected.collect())), (600, [131, 250]), (50, [250])):
        folder = tmp_path / str(idle)
        folder.mkdir()
        stream = tables.packet_stream(spark, path, max_files=1)
        found = run(state.stream_port_scan(stream, idle_seconds=idle), folder)
        assert sorted(row["pid"] for row in found.collect()) == pids


def test_state_writes_follow_new_rows(spark, packets_of, tmp_path):
    """A micro-batch updates the cells and ports of its own rows, not all that is kept."""
    start = 1_000_000 * SECOND
    batches = [packets_of([{"ts_us": start + (60 * part + n) * SECOND // 2, "dst_port": 1 + n % 40, "pid": 1000 * part + n} for n in range(60)]) for part in range(6)]
    stream = tables.packet_stream(spark, files_of(spark, tmp_path, batches), max_files=1)
    for name, function, most in (("rates", state.stream_rates, 20), ("ports", state.stream_port_scan, 45)):
        query = function(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        updated = [step["stateOperators"][0]["numRowsUpdated"] for step in query.recentProgress if step["numInputRows"]]
        assert len(updated) == 6 and max(updated) <= most, updated
        if name == "ports":
            assert max(updated[1:]) <= 1  # the ports are known


def test_a_busy_source_spreads_over_blocks(spark, packets_of, tmp_path):
    """Half of all rows are of one source: its backlog goes to many keys, none of which has much more than its share."""
    rows = [{"ts_us": 1_000_000 * SECOND + n * SECOND, "src_ip": "busy" if n % 2 else f"10.0.0.{n % 250}"} for n in range(20_000)]
    blocks = packets_of(rows).groupBy("src_ip", F.expr(f"ts_us div {state.BLOCK_US}")).count()
    assert blocks.agg(F.max("count")).first()[0] <= 150


def test_entropy_before_every_stream(spark, ordered_files, tmp_path):
    """The user function of the entropy, once used, must not travel with the stateful rules."""
    documents = spark.createDataFrame([(b"abc",)], "payload binary")
    assert documents.select(payload.payload_entropy("payload")).first()[0] == 1.585
    for number, function in enumerate((state.stream_port_scan, state.stream_rates, state.stream_counters, state.stream_beacon)):
        folder = tmp_path / str(number)
        folder.mkdir()
        stream = tables.packet_stream(spark, ordered_files, max_files=5)
        assert run(function(stream), folder).count() > 0


def test_geo_lookup_on_borders(spark, packets_of):
    ranges = spark.createDataFrame(
        [(10 << 24, (10 << 24) + 5, "A"), ((10 << 24) + 6, (10 << 24) + 200_000, "B"), ((10 << 24) + 300_000, (10 << 24) + 300_000, "KP")],
        "lo long, hi long, country string",
    ).selectExpr("*", "country AS city", "1.0D AS latitude", "2.0D AS longitude")
    numbers = [0, 5, 6, 65_535, 65_536, 131_072, 200_000, 200_001, 299_999, 300_000, 300_001]
    ips = [".".join(str((10 << 24) + n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers]
    packets = packets_of([{"src_ip": ip} for ip in [*ips, "::1", "no address"]])
    for keep in (True, False):
        columns = ["pid", "country", "city", "latitude", "longitude", "is_threat"]
        looked = lookups.geo_lookup(packets, ranges, keep).select(*columns)
        enriched = lookups.geo_enrich(packets, ranges, keep_unmatched=keep).select(*columns)
        assert sorted(map(repr, looked.collect())) == sorted(map(repr, enriched.collect()))


def test_hits_meet_their_alerts_on_streams(spark, tmp_path):
    """A hit waits for its alert as long as one can come; it is an orphan when the watermark has passed that."""
    def stream(name, rows, schema):
        path = str(tmp_path / name)
        for part in rows:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return source.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", "10 seconds")

    end = (10_000 * SECOND, "-1")
    alerts = stream("alerts", [[(100 * SECOND, "a", "HIGH")], [(130 * SECOND, "b", "LOW")], [(*end, "LOW")]], "ts_us long, id string, severity string")
    hits = stream(
        "hits",
        [[(101 * SECOND, "a", "1"), (102 * SECOND, "b", "2"), (103 * SECOND, None, "3"), (104 * SECOND, "c", "4")], [(300 * SECOND, "a", "5")], [(*end, "6")]],
        "ts_us long, alert_id string, id string",
    )
    found = run(rollups.stream_hits(alerts, hits, "60 seconds"), tmp_path)
    matched = {row["id"]: row["severity"] for row in found.collect() if row["ts_us"] < 9000 * SECOND}
    assert matched == {"1": "HIGH", "2": "LOW", "4": None, "5": None}


def test_port_windows(spark, packets_of, tmp_path):
    scan = [{"ts_us": n * 1000, "dst_port": 1 + n} for n in range(300)]
    end = [{"ts_us": 600 * SECOND}]
    path = files_of(spark, tmp_path, [packets_of(scan + end)])
    found = run(rollups.stream_port_windows(tables.packet_stream(spark, path)), tmp_path).collect()
    assert [(row["bucket"], row["src_ip"]) for row in found] == [(0, "10.0.0.1")]
    assert abs(found[0]["ports"] - 300) < 45


def test_a_late_packet_after_a_burst_finds_its_history(spark, packets_of, tmp_path):
    """A burst just before the newest event must not push a late beacon's history out."""
    http = {"protocol": "HTTP"}
    start = 1000 * SECOND
    regular = [{**http, "ts_us": start + n * 25 * SECOND} for n in range(8)]
    burst = [{"ts_us": start + 201 * SECOND + n * 90_000} for n in range(190)]
    late = [{**http, "ts_us": start + 200 * SECOND, "pid": 1000}]
    path = files_of(spark, tmp_path, [packets_of(regular + burst), packets_of(late)])
    found = run(state.stream_beacon(tables.packet_stream(spark, path, max_files=1)), tmp_path)
    expected = detect.c2_beacon(packets_of(regular + burst).unionByName(packets_of(late)))
    assert rows_of(found) == rows_of(expected) and 1000 in {row["pid"] for row in expected.collect()}


def test_live_runs_over_a_busy_source(spark, packets_of, tmp_path, monkeypatch):
    """Half of all packets are of one source; late and waiting packets, a writer that dies before its commit."""
    rng = random.Random(3)
    rows, at = [], 1_000_000 * SECOND
    for n in range(1200):
        at += rng.choice([1_000, 200_000, 3 * SECOND, 31 * SECOND])
        kind = rng.choice([{"protocol": "SSH"}, {"protocol": "DNS"}, {"protocol": "HTTPS", "length": 800_000}, {"protocol": "TCP", "dst_port": 1 + n % 300}])
        rows.append({"pid": n, "ts_us": at, "src_ip": "10.0.0.1" if n % 2 else f"10.0.1.{n % 5}", **kind})
    rows += [{"pid": 5000 + n, "ts_us": rows[400]["ts_us"] + n * 20_000, "protocol": "TCP", "flags": "SYN", "dst_port": 80} for n in range(700)]
    rows.sort(key=lambda row: row["ts_us"])
    cuts = [0, 700, 1300, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    # Some rows come a file later than their time, within the delay; one comes too late.
    parts[1] += [parts[0].pop() for _ in range(20)]
    lost = {"pid": 9999, "ts_us": rows[10]["ts_us"], "protocol": "ICMP", "length": 2000}
    parts[2] = [*parts[2], lost]
    end = {"pid": -1, "ts_us": rows[-1]["ts_us"] + 7200 * SECOND, "protocol": "END", "src_ip": "0.0.0.0"}
    path = files_of(spark, tmp_path, [packets_of(part) for part in [*parts, [end]]])
    root, checkpoint = str(tmp_path / "live"), str(tmp_path / "checkpoint")

    def run_once():
        stream = tables.packet_stream(spark, path, max_files=1)
        live.runs_writer(stream, root, checkpoint, delay_seconds=600).trigger(availableNow=True).start().awaitTermination()

    commit, calls = live._commit, []

    def dying(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        commit(*args)

    monkeypatch.setattr(live, "_commit", dying)
    with pytest.raises(Exception, match="lost"):
        run_once()
    monkeypatch.setattr(live, "_commit", commit)
    run_once()
    expected = detect.all_findings(packets_of(rows))
    raised = {row["rule"] for row in expected.collect()}
    assert {"port_scan", "syn_flood", "dns_recon", "ssh_brute_force", "exfil"} <= raised
    assert rows_of(live.read_committed(spark, root, "findings")) == rows_of(expected)
    stored = live.read_committed(spark, root, "packets")
    assert sorted(row["pid"] for row in stored.select("pid").collect()) == sorted(row["pid"] for row in rows)
    assert live.read_committed(spark, root, "alerts").count() == live.read_committed(spark, root, "mitre_events").count() == expected.count()
    # State and waiting packets of the last two commits are all that is left.
    assert len(list((tmp_path / "live" / "state" / "sources").glob("query=*/batch=*"))) == 2
    parts = live.read_committed_parts(spark, root).where("pkt_count > 0")
    assert parts.agg(F.sum("pkt_count")).first()[0] == len(rows)


def test_folds_of_a_busy_source_are_even(spark, packets_of):
    """In the runs a source with half of all rows is laid out over many tasks, none above twice the median."""
    rows = [{"ts_us": n * SECOND, "src_ip": "busy" if n % 2 else f"10.0.0.{n % 250}", "length": 700} for n in range(20_000)]
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # so few rows would be one task's
    try:
        laid = ordered.lay_out(packets_of(rows).select("src_ip", "ts_us", "pid", "length"), ["src_ip"], ["ts_us", "pid"])
    finally:
        spark.conf.set(coalesced, "true")
    sizes = sorted(row["count"] for row in laid.groupBy("part").count().collect())
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
