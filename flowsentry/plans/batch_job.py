"""The batch job: from packets to all derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS
from flowsentry.operators import alerts, carry, detect, lookups, rollups
from flowsentry.sources import tables


def analyze(
    packets: DataFrame,
    root: str,
    run: str,
    geo_ranges: DataFrame | None = None,
    after: str | None = None,
    goes_on: bool = False,
    port_idle_seconds: int | None = None,
) -> None:
    """Detect, and write packets, alerts, technique hits, threats and rollups of the run under ``root``.

    Every table has a folder per run, which a repeated run replaces, so a replay changes nothing. The
    findings are written first, so detection runs once and its result survives lost executors;
    everything else reads that table.

    ``after`` names the run before, which was told that it ``goes_on``: this run then starts from the state that one has
    left, and its packets must be later. So runs cut anywhere between two times find what one run over all packets
    finds. A run that goes on leaves the findings of the minute it ends in (rules on whole minutes) to the next one.
    ``port_idle_seconds`` ends the port sets of pairs that have been idle for longer, which otherwise never end.
    """
    spark = packets.sparkSession

    def path(table: str) -> str:
        return f"{root}/{table}/run={run}"

    entry = None if after is None else carry.read(spark, f"{root}/state", f"run={after}")
    found_by = detect.run_findings(packets, entry, goes_on)
    found_by.findings.write.mode("overwrite").parquet(path("findings"))
    findings = spark.read.parquet(path("findings"))
    found = alerts.build_alerts(findings)
    tables.sink_alerts(found, path("alerts"), "overwrite")
    tables.sink_mitre(alerts.build_mitre_events(findings), path("mitre_events"), "overwrite")
    tables.sink_packets(lookups.mark_malicious(packets, findings), path("packets"), "overwrite")
    stored = tables.scan_packets(spark, path("packets"))
    rollups.source_stats(stored).write.mode("overwrite").parquet(path("source_stats"))
    rollups.connection_parts(packets, entry and entry.connections).write.mode("overwrite").parquet(path("connection_parts"))
    for table, rows in (
        ("threats", alerts.threat_sessions(findings)),
        ("protocol_stats", rollups.protocol_stats(packets)),
    ):
        rows.write.mode("overwrite").parquet(path(table))
    minutes = rollups.perf_minutely(packets, found)
    per_minute = minutes.withColumns({"id": F.col("bucket"), "ts_us": F.col("bucket") * MICROS})
    tables.append(per_minute, "performance_metrics", path("performance_metrics"), "overwrite")
    if geo_ranges is not None:
        placed = lookups.geo_enrich(packets, geo_ranges, keep_unmatched=False).withColumnRenamed("pid", "id")
        tables.sink_geo(placed, path("geo_traffic"), "overwrite")
    if goes_on:
        parts = spark.read.parquet(path("connection_parts"))
        open_ = rollups.open_connections(parts, found_by.border_us)
        carry.write(detect.leaves(found_by, open_, port_idle_seconds), f"{root}/state", f"run={run}")


def connections(spark: SparkSession, root: str) -> DataFrame:
    """The connections of all runs; one that goes on over a border is one row."""
    return rollups.merged_connections(spark.read.parquet(f"{root}/connection_parts").where("pkt_count > 0"))


ACKS = "alert_id string, ts_us long"


def acknowledge(spark: SparkSession, root: str, alert_ids: list[str], ts_us: int) -> None:
    """Append acknowledgements; alerts themselves are never rewritten."""
    acks = spark.createDataFrame([(key, ts_us) for key in alert_ids], ACKS)
    acks.write.mode("append").parquet(f"{root}/acks")
