"""Joins with dimension tables and between alerts, hits and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.functions.addresses import ipv4_number
from flowsentry.functions.payload import ipv6_anomaly, payload_signature, port_classification
from flowsentry.operators.pruning import settle


def mitre_lookup(df: DataFrame, key: str = "mitre_key") -> DataFrame:
    """Add technique id, name and tactic of a detector key."""
    techniques = F.broadcast(dims.technique_table(df.sparkSession).withColumnRenamed("mitre_key", key))
    names = ["technique_id", "technique_name", "tactic"]
    joined = df.join(techniques, key, "left")
    known = {name: F.coalesce(name, F.lit(value)) for name, value in zip(names, dims.UNKNOWN_TECHNIQUE)}
    return joined.withColumns(known)


def _with_port_name(df: DataFrame, port: str, name: str) -> DataFrame:
    ports = dims.port_table(df.sparkSession).toDF(f"{name}_port", name)
    return df.join(F.broadcast(ports), F.col(port) == F.col(f"{name}_port"), "left").drop(f"{name}_port")


def port_protocol(df: DataFrame, l4: str = "l4", out: str = "port_protocol") -> DataFrame:
    """Protocol by destination port, then source port, then the transport name."""
    named = _with_port_name(_with_port_name(df, "dst_port", "_dst_name"), "src_port", "_src_name")
    return named.withColumn(out, port_classification("_dst_name", "_src_name", l4)).drop(
        "_dst_name", "_src_name"
    )


def classify(df: DataFrame, raw: str = "raw_protocol", out: str = "classified") -> DataFrame:
    """The raw protocol if there is one, else the protocol of the destination port, else TCP."""
    named = _with_port_name(df, "dst_port", "_dst_name")
    value = F.coalesce(F.nullif(F.col(raw), F.lit("")), F.col("_dst_name"), F.lit("TCP"))
    return named.withColumn(out, value).drop("_dst_name")


def protocol_risk(df: DataFrame, protocol: str = "protocol") -> DataFrame:
    risks = dims.risk_table(df.sparkSession).withColumnRenamed("protocol", "_risk_protocol")
    joined = df.join(F.broadcast(risks), F.col(protocol) == F.col("_risk_protocol"), "left")
    return joined.withColumn("risk", F.coalesce("risk", F.lit(dims.DEFAULT_RISK))).drop("_risk_protocol")


def payload_protocol(packets: DataFrame, out: str = "detected") -> DataFrame:
    """Protocol of a payload packet: IPv6 anomaly, payload signature, ports, in this order."""
    by_port = port_protocol(packets, out="_by_port")
    value = F.when(
        ipv6_anomaly("ip_version", "flow_label", "next_header"), F.lit("IPv6_ANOMALY")
    ).otherwise(F.coalesce(payload_signature("payload"), F.col("_by_port")))
    return by_port.withColumn(out, value).drop("_by_port")


def alerts_with_techniques(alerts: DataFrame, hits: DataFrame) -> DataFrame:
    """Technique hits with the alert that raised them."""
    linked = hits.select(
        F.col("alert_id").alias("id"), "technique_id", "technique_name", "tactic", "confidence"
    )
    return alerts.join(linked, "id")


def orphan_hits(alerts: DataFrame, hits: DataFrame) -> DataFrame:
    """Technique hits whose alert does not exist; hits without an alert are not orphans."""
    linked = hits.where(F.col("alert_id").isNotNull())
    return linked.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_anti")


def ack_overlay(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with ``acknowledged`` set where the append-only acks name them."""
    named = acks.select(F.col("alert_id").alias("id")).distinct().withColumn("_acked", F.lit(1))
    joined = alerts.join(named, "id", "left")
    value = F.greatest("acknowledged", F.coalesce("_acked", F.lit(0)))
    return joined.withColumn("acknowledged", value).drop("_acked")


def mark_malicious(packets: DataFrame, findings: DataFrame) -> DataFrame:
    """Packets flagged where the input flag is set or a finding names them."""
    hit = settle(findings.select("pid").distinct().withColumn("_hit", F.lit(1)))
    joined = packets.join(hit, "pid", "left")
    value = F.greatest(F.coalesce("is_malicious", F.lit(0)), F.coalesce("_hit", F.lit(0)))
    return joined.withColumn("is_malicious", value).drop("_hit")


def threat_country(country="country") -> Column:
    column = F.col(country) if isinstance(country, str) else country
    return F.coalesce(column.isin(dims.THREAT_COUNTRIES), F.lit(False)).cast("int")


def geo_lookup(packets: DataFrame, ranges: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """As ``geo_enrich``, by a join of packets with ranges on the /16: works on streams, with the ranges at rest.

    Ranges are disjoint and cut at /16 borders, so a packet meets those of its /16, and one at most holds its address.
    Spark broadcasts the cut ranges if they are small; a stream has no distinct sources to look up instead.
    """
    first, last = F.shiftleft("prefix", 16), F.shiftleft("prefix", 16) + 65_535
    cut = ranges.select(
        F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("prefix"), "*"
    ).select(
        F.col("prefix").alias("_prefix"),
        F.greatest("lo", first).alias("_lo"),
        F.least("hi", last).alias("_hi"),
        *["country", "city", "latitude", "longitude"],
    )
    number = ipv4_number("src_ip")
    numbered = packets.withColumn("_number", number).withColumn("_prefix", F.shiftright("_number", 16))
    held = F.col("_number").between(F.col("_lo"), F.col("_hi"))
    joined = numbered.alias("p").join(
        cut.alias("r"), (F.col("p._prefix") == F.col("r._prefix")) & held, "left" if keep_unmatched else "inner"
    )
    return joined.drop("_prefix", "_number", "_lo", "_hi").withColumn("is_threat", threat_country())


def geo_enrich(
    packets: DataFrame,
    ranges: DataFrame,
    fraction: float | None = None,
    seed: int = 0,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Packets with the place of their source address, NULL where it is in no range.

    With ``keep_unmatched`` false, packets in no range and IPv6 sources are left out.

    ``ranges`` holds disjoint ``(lo, hi, country, city, latitude, longitude)`` IPv4 ranges.
    Distinct sources are looked up, so a source with many packets is matched once. Ranges are cut
    at /16 borders; inside a /16 a source belongs to the last range that starts at or before it.
    A /16 holds at most 65,536 addresses and as many range starts, which bounds every window.
    """
    if fraction is not None:
        packets = packets.sample(fraction=fraction, seed=seed)
    place = F.struct("hi", "country", "city", "latitude", "longitude")
    starts = ranges.select(
        F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("prefix"),
        "lo",
        place.alias("place"),
    ).select(
        "prefix",
        F.greatest("lo", F.shiftleft("prefix", 16)).alias("number"),
        F.lit(None).cast("string").alias("src_ip"),
        "place",
    )
    number = ipv4_number("src_ip")
    sources = (
        packets.select("src_ip")
        .distinct()
        .where(number.isNotNull())
        .select(F.shiftright(number, 16).alias("prefix"), number.alias("number"), "src_ip")
    )
    in_prefix = Window.partitionBy("prefix").orderBy("number", F.col("src_ip").asc_nulls_first())
    places = (
        starts.unionByName(sources, allowMissingColumns=True)
        .withColumn("place", F.last("place", ignorenulls=True).over(in_prefix))
        .where(F.col("src_ip").isNotNull() & (F.col("number") <= F.col("place.hi")))
        .select("src_ip", "place.country", "place.city", "place.latitude", "place.longitude")
    )
    how = "left" if keep_unmatched else "inner"
    return packets.join(settle(places), "src_ip", how).withColumn("is_threat", threat_country())
