"""Table schemas. Tables at rest are Parquet, partitioned by ``dt`` (the UTC date of ``ts_us``)."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, DOUBLE, STRING, BINARY = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.BinaryType(),
)


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


PACKETS = _table(
    ("pid", LONG, False),
    ("ts_us", LONG, False),
    ("src_ip", STRING, False),
    ("dst_ip", STRING, False),
    ("src_port", INT, True),
    ("dst_port", INT, True),
    ("protocol", STRING, False),
    ("length", INT, False),
    ("flags", STRING, True),
    ("payload_hex", STRING, True),
    ("is_malicious", INT, True),
    ("qname", STRING, True),
    ("src_mac", STRING, True),
    ("ip_version", INT, True),
    ("flow_label", INT, True),
    ("next_header", INT, True),
    ("l4", STRING, True),
)

ALERTS = _table(
    ("id", STRING, False),
    ("ts_us", LONG, False),
    ("severity", STRING, False),
    ("alert_type", STRING, False),
    ("src_ip", STRING, True),
    ("dst_ip", STRING, True),
    ("protocol", STRING, True),
    ("description", STRING, True),
    ("mitre_id", STRING, True),
    ("mitre_name", STRING, True),
    ("acknowledged", INT, True),
    ("raw_data", STRING, True),
)

THREATS = _table(
    ("first_seen", LONG, False),
    ("last_seen", LONG, False),
    ("src_ip", STRING, False),
    ("threat_type", STRING, False),
    ("confidence", DOUBLE, False),
    ("packet_count", LONG, True),
    ("blocked", INT, True),
    ("notes", STRING, True),
)

PROTOCOL_STATS = _table(
    ("bucket", LONG, False),
    ("protocol", STRING, False),
    ("pkt_count", LONG, True),
    ("byte_count", LONG, True),
)

SOURCE_STATS = _table(
    ("day", T.DateType(), True),
    ("src_ip", STRING, False),
    ("pkt_count", LONG, True),
    ("bytes", LONG, True),
    ("threat_count", LONG, True),
)

GEO_TRAFFIC = _table(
    ("id", LONG, False),
    ("ts_us", LONG, False),
    ("src_ip", STRING, False),
    ("country", STRING, False),
    ("city", STRING, True),
    ("latitude", DOUBLE, True),
    ("longitude", DOUBLE, True),
    ("is_threat", INT, True),
    ("pkt_count", INT, True),
)

MITRE_EVENTS = _table(
    ("id", STRING, False),
    ("ts_us", LONG, False),
    ("technique_id", STRING, False),
    ("technique_name", STRING, False),
    ("tactic", STRING, False),
    ("alert_id", STRING, True),
    ("confidence", DOUBLE, False),
)

CONNECTIONS = _table(
    ("start_us", LONG, False),
    ("end_us", LONG, True),
    ("src_ip", STRING, False),
    ("dst_ip", STRING, False),
    ("src_port", INT, True),
    ("dst_port", INT, True),
    ("protocol", STRING, True),
    ("state", STRING, True),
    ("bytes_sent", LONG, True),
    ("bytes_recv", LONG, True),
    ("pkt_count", LONG, True),
)

PERFORMANCE_METRICS = _table(
    ("id", LONG, False),
    ("ts_us", LONG, False),
    ("packets_pm", INT, True),
    ("alerts_pm", INT, True),
    ("db_query_ms", DOUBLE, True),
    ("cpu_pct", DOUBLE, True),
    ("mem_mb", DOUBLE, True),
    ("drop_pct", DOUBLE, True),
)

TABLES = {
    "packets": PACKETS,
    "alerts": ALERTS,
    "threats": THREATS,
    "protocol_stats": PROTOCOL_STATS,
    "geo_traffic": GEO_TRAFFIC,
    "mitre_events": MITRE_EVENTS,
    "connections": CONNECTIONS,
    "performance_metrics": PERFORMANCE_METRICS,
}

# Values a column takes when the writer leaves it out.
DEFAULTS = {
    "packets": {"is_malicious": 0},
    "alerts": {"acknowledged": 0},
    "threats": {"packet_count": 1, "blocked": 0},
    "protocol_stats": {"pkt_count": 0, "byte_count": 0},
    "geo_traffic": {"is_threat": 0, "pkt_count": 1},
    "mitre_events": {},
    "connections": {"state": "ACTIVE", "bytes_sent": 0, "bytes_recv": 0, "pkt_count": 0},
    "performance_metrics": {
        "packets_pm": 0,
        "alerts_pm": 0,
        "db_query_ms": 0.0,
        "cpu_pct": 0.0,
        "mem_mb": 0.0,
        "drop_pct": 0.0,
    },
}

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def required_columns(table: str) -> list[str]:
    return [field.name for field in TABLES[table].fields if not field.nullable]
