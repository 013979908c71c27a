"""From findings to alerts, technique hits and threat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.functions.scalar import alert_key, alert_title
from flowsentry.operators.lookups import mitre_lookup


def with_techniques(findings: DataFrame) -> DataFrame:
    return mitre_lookup(findings)


def with_confidence(findings: DataFrame) -> DataFrame:
    """Add the confidence of the rule, a constant per rule."""
    rules = dims.rule_table(findings.sparkSession).select("rule", "confidence")
    return findings.join(F.broadcast(rules), "rule", "left")


def build_alerts(findings: DataFrame) -> DataFrame:
    """One alert per finding. The key depends on packet and rule only, so a replay repeats it."""
    return with_techniques(findings).select(
        alert_key("pid", "rule").alias("id"),
        "ts_us",
        "severity",
        alert_title("threat_type").alias("alert_type"),
        "src_ip",
        "dst_ip",
        "protocol",
        "description",
        F.col("technique_id").alias("mitre_id"),
        F.col("technique_name").alias("mitre_name"),
        F.lit(0).alias("acknowledged"),
        F.to_json(F.struct("pid", "rule")).alias("raw_data"),
    )


def build_mitre_events(findings: DataFrame) -> DataFrame:
    """One technique hit per finding, linked to its alert."""
    key = alert_key("pid", "rule")
    return with_confidence(with_techniques(findings)).select(
        F.md5(F.concat_ws("|", key, F.lit("technique"))).alias("id"),
        "ts_us",
        "technique_id",
        "technique_name",
        "tactic",
        key.alias("alert_id"),
        "confidence",
    )


def threat_sessions(findings: DataFrame) -> DataFrame:
    """Findings rolled up per source and threat type."""
    return (
        with_confidence(findings)
        .groupBy("src_ip", "threat_type")
        .agg(
            F.min("ts_us").alias("first_seen"),
            F.max("ts_us").alias("last_seen"),
            F.max("confidence").alias("confidence"),
            F.count(F.lit(1)).alias("packet_count"),
        )
        .withColumn("blocked", F.lit(0))
    )


def merged_threats(threats: DataFrame) -> DataFrame:
    """Threat sessions of several runs as one row per source and threat type."""
    return threats.groupBy("src_ip", "threat_type").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("confidence").alias("confidence"),
        F.sum("packet_count").alias("packet_count"),
        F.max("blocked").alias("blocked"),
    )
