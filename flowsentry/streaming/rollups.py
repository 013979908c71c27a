"""Windowed rollups of packet streams, with native streaming aggregation.

All of them expect a watermark on ``ts`` and give a row once the watermark has passed it. Rows
are aggregated before the shuffle, so a busy source or minute is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS
from flowsentry.operators import detect, lookups
from flowsentry.operators.rollups import CONNECTION_KEYS, connection_measures, connection_rows, with_ends
from flowsentry.operators.sessions import IDLE_SECONDS
from flowsentry.sources import tables

# Sessions end after more than an idle hour, so a gap of exactly an hour still belongs to one.
IDLE_GAP = f"{IDLE_SECONDS * MICROS + 1} microseconds"


def _bucket(window: str = "window") -> Column:
    return F.unix_seconds(F.col(f"{window}.start")).alias("bucket")


def stream_row_rules(packets: DataFrame) -> DataFrame:
    """Rules on a single packet."""
    return detect.row_rules(packets)


def stream_minute_rules(packets: DataFrame) -> DataFrame:
    """Rules on whole minutes, FTP login failures and ARP spoofing, once the watermark has passed the minute."""
    minute = F.window("ts", "1 minute")
    failures = detect.ftp_failures(packets).groupBy("src_ip", "dst_ip", minute).agg(*detect.failure_measures())
    speakers = detect.arp_packets(packets).groupBy("src_ip", minute).agg(*detect.speaker_measures())
    return detect.ftp_findings(failures).unionByName(detect.arp_findings(speakers))


def stream_protocol_stats(packets: DataFrame) -> DataFrame:
    return (
        packets.groupBy(F.window("ts", "1 minute"), "protocol")
        .agg(F.count(F.lit(1)).alias("pkt_count"), F.sum("length").alias("byte_count"))
        .select(_bucket(), "protocol", "pkt_count", "byte_count")
    )


def stream_perf(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Packets and alerts per minute."""
    tagged = packets.select("ts", F.lit(0).alias("kind")).unionByName(alerts.select("ts", F.lit(1).alias("kind")))
    return (
        tagged.groupBy(F.window("ts", "1 minute"))
        .agg(
            F.count_if(F.col("kind") == 0).alias("packets_pm"),
            F.count_if(F.col("kind") == 1).alias("alerts_pm"),
        )
        .select(_bucket(), "packets_pm", "alerts_pm")
    )


def stream_rate_windows(packets: DataFrame, rule: detect.RateRule, slide: str = "1 second") -> DataFrame:
    """Sliding windows in which a source exceeds a rate: one row per window, not per packet."""
    return (
        packets.groupBy(F.window("ts", f"{rule.seconds} seconds", slide), "src_ip")
        .agg(F.count(F.lit(1)).alias("packets"), F.count_if(rule.trigger()).alias("triggers"))
        .where((F.col("packets") > rule.threshold) & (F.col("triggers") > 0))
        .select(_bucket(), "src_ip", "packets", "triggers")
    )


def stream_port_windows(packets: DataFrame, limit: int = 50, window: str = "1 minute") -> DataFrame:
    """Windows in which a source probes about more than ``limit`` ports of a target."""
    tcp = packets.where((F.col("protocol") == "TCP") & (F.col("dst_port") != 0))
    return (
        tcp.groupBy(F.window("ts", window), "src_ip", "dst_ip")
        .agg(F.approx_count_distinct("dst_port").alias("ports"))
        .where(F.col("ports") > limit)
        .select(_bucket(), "src_ip", "dst_ip", "ports")
    )


def stream_geo(packets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Geo rows of the packets whose source is in a range; the ranges are at rest."""
    placed = lookups.geo_lookup(packets, ranges, keep_unmatched=False).withColumnRenamed("pid", "id")
    return tables.geo_rows(placed)


def stream_hits(alerts: DataFrame, hits: DataFrame, within: str) -> DataFrame:
    """Technique hits with the severity of their alert, NULL for those that have none.

    Alert and hit lie at most ``within`` apart. Both sides keep their rows that long, by their watermarks; a hit
    without an alert comes out when the watermark has passed the time in which one could come. Hits that name no alert
    are none of these.
    """
    reach = F.expr(f"INTERVAL {within}")
    named = hits.where(F.col("alert_id").isNotNull())
    mine = alerts.select(F.col("id").alias("_alert"), F.col("ts").alias("_ts"), "severity")
    near = (F.col("_ts") >= F.col("ts") - reach) & (F.col("_ts") <= F.col("ts") + reach)
    return named.join(mine, (F.col("alert_id") == F.col("_alert")) & near, "left")


def stream_orphan_hits(alerts: DataFrame, hits: DataFrame, within: str) -> DataFrame:
    """Technique hits whose alert does not exist."""
    return stream_hits(alerts, hits, within).where(F.col("_alert").isNull()).select(*hits.columns)


def stream_sessions(packets: DataFrame) -> DataFrame:
    """Sessions of a source whose idle hour is over, which is when their state is dropped."""
    return (
        packets.groupBy(F.session_window("ts", IDLE_GAP), "src_ip")
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count(F.lit(1)).alias("pkt_count"),
        )
        .select("src_ip", "first_us", "last_us", "pkt_count")
    )


def stream_connections(packets: DataFrame) -> DataFrame:
    """Connections that an idle hour has ended."""
    measured = (
        with_ends(packets)
        .groupBy(F.session_window("ts", IDLE_GAP), *CONNECTION_KEYS)
        .agg(*connection_measures())
    )
    return connection_rows(measured)
