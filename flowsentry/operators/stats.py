"""Dashboard aggregates. Each reads its table once, with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS, round_half_even, time_bucket, truthy_default
from flowsentry.operators.filters import bucket_order, since, top_k

DEFAULT_ACCURACY = 0.992


def count_rows() -> Column:
    return F.count(F.lit(1))


def overview_stats(
    packets: DataFrame,
    alerts: DataFrame,
    threats: DataFrame,
    mitre_events: DataFrame,
    performance: DataFrame,
    as_of_us: int,
    packet_counts: DataFrame | None = None,
) -> DataFrame:
    """One row of key figures: one row per table, stacked and folded into one.

    ``packet_counts`` is the rollup per minute and protocol (``pkt_count``), if there is one: the total then comes
    from it. The last hour and day are read through ``since``, which opens only their days.
    """

    def younger(seconds: int):
        return F.col("ts_us") > as_of_us - seconds * MICROS

    unacked = F.col("acknowledged") == 0
    if packet_counts is None:
        total = packets.agg(count_rows().alias("total_packets"))  # no column: row counts of the files' footers
    else:
        total = packet_counts.agg(F.coalesce(F.sum("pkt_count"), F.lit(0)).alias("total_packets"))
    packet_row = since(packets, as_of_us, 3600).agg(
        count_rows().alias("packets_last_hour"),
        F.count_if(F.col("is_malicious") == 1).alias("malicious_pkt_hour"),
    )
    alert_row = alerts.agg(
        F.count_if(younger(86400)).alias("alerts_24h"),
        F.count_if(unacked & (F.col("severity") == "CRITICAL")).alias("critical_unacked"),
        F.count_if(unacked).alias("unacked_alerts"),
    )
    threat_row = threats.agg(F.count_if(F.col("blocked") == 0).alias("active_threats"))
    confidence = truthy_default(F.avg("confidence"), DEFAULT_ACCURACY)
    mitre_row = since(mitre_events, as_of_us, 3600).agg(
        round_half_even(confidence * 100, 2).alias("accuracy_pct")
    )
    rate = F.coalesce(F.avg("packets_pm"), F.lit(0.0))
    performance_row = since(performance, as_of_us, 600).agg(
        round_half_even(rate).cast("bigint").alias("packets_per_min")
    )
    rows = packet_row
    for other in (total, alert_row, threat_row, mitre_row, performance_row):
        rows = rows.unionByName(other, allowMissingColumns=True)
    figures = [
        "total_packets",
        "packets_last_hour",
        "packets_per_min",
        "active_threats",
        "alerts_24h",
        "critical_unacked",
        "unacked_alerts",
        "malicious_pkt_hour",
        "accuracy_pct",
    ]
    return rows.agg(*[F.max(name).alias(name) for name in figures])


def packets_per_minute(packets: DataFrame, as_of_us: int, minutes: int = 30) -> DataFrame:
    recent = since(packets, as_of_us, minutes * 60)
    counts = recent.groupBy(time_bucket("ts_us", 60).alias("bucket")).agg(count_rows().alias("cnt"))
    return bucket_order(counts)


def protocol_distribution(packets: DataFrame, k: int = 16) -> DataFrame:
    return top_k(packets.groupBy("protocol").agg(count_rows().alias("cnt")), "cnt", k, ["protocol"])


def top_talkers(packets: DataFrame, k: int = 10) -> DataFrame:
    """Sources with the most packets, their bytes and malicious packets."""
    talkers = packets.groupBy("src_ip").agg(
        count_rows().alias("pkt_count"),
        F.sum("length").alias("bytes"),
        F.sum("is_malicious").alias("threat_count"),
    )
    return top_k(talkers, "pkt_count", k, ["src_ip"])


def protocols_of_rollup(protocol_stats: DataFrame, k: int = 16) -> DataFrame:
    """The same as ``protocol_distribution``, from packets per minute and protocol."""
    return top_k(protocol_stats.groupBy("protocol").agg(F.sum("pkt_count").alias("cnt")), "cnt", k, ["protocol"])


def talkers_of_rollup(source_stats: DataFrame, k: int = 10) -> DataFrame:
    """The same as ``top_talkers``, from sums per day and source."""
    sums = [F.sum(name).alias(name) for name in ("pkt_count", "bytes", "threat_count")]
    return top_k(source_stats.groupBy("src_ip").agg(*sums), "pkt_count", k, ["src_ip"])


def geo_traffic(geo: DataFrame) -> DataFrame:
    return (
        geo.groupBy("country")
        .agg(
            F.sum("pkt_count").alias("total"),
            F.sum("is_threat").alias("threats"),
            F.avg("latitude").alias("lat"),
            F.avg("longitude").alias("lon"),
        )
        .orderBy(F.desc("total"), "country")
    )


def threat_timeline(alerts: DataFrame, as_of_us: int, hours: int = 24) -> DataFrame:
    recent = since(alerts, as_of_us, hours * 3600)
    bucket = time_bucket("ts_us", 3600).alias("bucket")
    return bucket_order(recent.groupBy(bucket, "severity").agg(count_rows().alias("cnt")), "severity")


def severity_breakdown(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(count_rows().alias("cnt"))


def alerts_by_type(alerts: DataFrame, k: int = 12) -> DataFrame:
    return top_k(alerts.groupBy("alert_type").agg(count_rows().alias("cnt")), "cnt", k, ["alert_type"])


def alerts_hourly(alerts: DataFrame, as_of_us: int) -> DataFrame:
    recent = since(alerts, as_of_us, 86400)
    return bucket_order(
        recent.groupBy(time_bucket("ts_us", 3600).alias("bucket")).agg(count_rows().alias("cnt"))
    )


def mitre_techniques(hits: DataFrame) -> DataFrame:
    """Hits and mean confidence per technique."""
    return (
        hits.groupBy("technique_id")
        .agg(
            F.min("technique_name").alias("technique_name"),
            F.min("tactic").alias("tactic"),
            count_rows().alias("cnt"),
            F.avg("confidence").alias("avg_conf"),
        )
        .orderBy(F.desc("cnt"), "technique_id")
    )


def mitre_heatmap(hits: DataFrame) -> DataFrame:
    return hits.groupBy("technique_id").agg(
        F.min("technique_name").alias("technique_name"),
        F.min("tactic").alias("tactic"),
        count_rows().alias("cnt"),
    )
