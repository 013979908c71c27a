"""The batch job and the dashboard over what it wrote."""

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import detect, filters, stats
from flowsentry.plans import catalog
from flowsentry.plans.dashboard import Dashboard
from flowsentry.plans.batch_job import acknowledge, analyze
from flowsentry.plans.views import view
from flowsentry.sources import tables

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    analyze(view(spark, SF_DIR, "packets"), folder, "first", view(spark, SF_DIR, "geo_ranges"))
    return folder


@pytest.fixture(scope="module")
def dashboard(spark, root):
    return Dashboard(spark, root, catalog.latest(view(spark, SF_DIR, "packets")))


def test_alerts_and_hits_belong_together(spark, root):
    alerts, hits = tables.scan_alerts(spark, f"{root}/alerts"), tables.scan_mitre(spark, f"{root}/mitre_events")
    findings = spark.read.parquet(f"{root}/findings").count()
    assert alerts.count() == hits.count() == findings == 3423
    assert alerts.join(hits, alerts["id"] == hits["alert_id"], "left_anti").count() == 0


def test_packets_of_findings_are_marked(spark, root):
    marked = tables.scan_packets(spark, f"{root}/packets")
    assert marked.count() == 10000
    found = spark.read.parquet(f"{root}/findings").select("pid").distinct()
    assert marked.join(found, "pid", "left_semi").where("is_malicious = 0").count() == 0


REPORTS = [
    "overview",
    "packets_per_minute",
    "protocol_distribution",
    "top_talkers",
    "geo_traffic",
    "threat_timeline",
    "severity_breakdown",
    "recent_alerts",
    "alerts_by_type",
    "alerts_hourly",
    "mitre_techniques",
    "mitre_heatmap",
    "recent_events",
    "search_events",
    "performance",
    "threats",
    "connections",
]


@pytest.mark.parametrize("report", REPORTS)
def test_report_has_rows(dashboard, report):
    assert getattr(dashboard, report)().count() > 0


def test_totals_come_from_rollups(spark, root, dashboard):
    """The same rows as over all packets, and no packet file is opened."""
    packets = tables.scan_packets(spark, f"{root}/packets")
    for found, whole in (
        (dashboard.top_talkers(7), stats.top_talkers(packets, 7)),
        (dashboard.protocol_distribution(), stats.protocol_distribution(packets)),
    ):
        assert [tuple(row) for row in found.collect()] == [tuple(row) for row in whole.select(*found.columns).collect()]
        assert found.inputFiles() and not [name for name in found.inputFiles() if "/packets/" in name]


def test_overview_counts(dashboard):
    row = dashboard.overview().first()
    assert row["total_packets"] == 10000 and row["unacked_alerts"] == 3423


def test_acknowledged_alerts(spark, root, dashboard):
    ids = [row["id"] for row in dashboard.recent_alerts(3).collect()]
    acknowledge(spark, root, [*ids, ids[0]], 1)
    after = Dashboard(spark, root, dashboard.as_of_us)  # finds the table of acknowledgements
    assert after.overview().first()["unacked_alerts"] == 3420
    assert [row["acknowledged"] for row in after.recent_alerts(4).collect()] == [1, 1, 1, 0]


def test_bound_on_time_prunes_days(spark, root):
    packets = tables.scan_packets(spark, f"{root}/packets")
    recent = filters.since(packets, catalog.latest(packets), 86400)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThan(ts_us" in plan
    assert len(recent.inputFiles()) >= 1


def test_two_columns_read_two_columns(spark, root):
    plan = (
        tables.scan_packets(spark, f"{root}/packets")
        .groupBy("src_ip")
        .agg(F.sum("length").alias("bytes"))
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "ReadSchema: struct<src_ip:string,length:int>" in plan


def test_row_rules_are_pushed_to_the_scan(spark, root):
    packets = tables.scan_packets(spark, f"{root}/packets")
    plan = detect.smtp_large(packets)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(protocol,SMTP)" in plan and "GreaterThan(length,500000)" in plan


def test_rank_limits_come_before_the_shuffle(spark, root):
    packets = tables.scan_packets(spark, f"{root}/packets")
    plan = detect.c2_beacon(packets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 182, Partial") == 2


def test_defaults_and_missing_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a", "DE")], "id long, ts_us long, src_ip string, country string")
    tables.sink_geo(rows.withColumn("city", F.lit("x")), str(tmp_path / "geo"))
    row = tables.scan_geo(spark, str(tmp_path / "geo")).first()
    assert (row["pkt_count"], row["is_threat"], row["city"], str(row["dt"])) == (1, 0, None, "1970-01-01")


def test_a_repeated_run_changes_nothing(spark, packets_of, tmp_path):
    root = str(tmp_path)
    day = [{"ts_us": n * 1_000_000, "protocol": "SSH"} for n in range(6)]
    later = [{"ts_us": (n + 5) * 1_000_000, "protocol": "ICMP", "length": 2000, "pid": 100 + n} for n in range(3)]
    for run, rows in (("one", day), ("two", later), ("two", later)):
        analyze(packets_of(rows), root, run)
    assert tables.scan_packets(spark, f"{root}/packets").count() == 9
    assert tables.scan_alerts(spark, f"{root}/alerts").count() == 1 + 3
    stats = Dashboard(spark, root, 0).protocol_stats()
    assert stats.groupBy("bucket", "protocol").count().where("count > 1").count() == 0
    assert stats.agg(F.sum("pkt_count")).first()[0] == 9


def test_sparse_days_are_written_by_many_tasks(spark, tmp_path):
    """Many short days are few bytes; they spread over the tasks, and few rows still make one file a day."""
    names = ["minPartitionSize", "minPartitionNum"]
    before = [spark.conf.get(f"spark.sql.adaptive.coalescePartitions.{name}", None) for name in names]
    day = 86_400_000_000
    for number, days, least in ((0, 120, 3), (1, 3, 1)):
        rows = spark.range(days * 48).select("id", (F.col("id") * (day // 48)).alias("ts_us"), F.rand(7).alias("cpu_pct"))
        path = tmp_path / f"{number}"
        tables.append(rows, "performance_metrics", str(path))
        files = [file.name for file in path.glob("dt=*/*.parquet")]
        tasks = {name.split("-")[1] for name in files}
        assert days <= len(files) < days + len(tasks) and len(tasks) >= least
        assert tables.scan_perf(spark, str(path)).count() == days * 48
    assert len(tasks) == 1
    assert before == [spark.conf.get(f"spark.sql.adaptive.coalescePartitions.{name}", None) for name in names]
