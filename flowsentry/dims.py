"""Dimension tables: techniques, ports, risk classes, thresholds and detection rules.

All of them have a fixed number of rows, so joining them by broadcast is always safe.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Detector key, technique id, technique name, tactic.
TECHNIQUES = [
    ("port_scan", "T1046", "Network Service Discovery", "Discovery"),
    ("brute_force", "T1110", "Brute Force", "Credential Access"),
    ("dns_tunnel", "T1071.004", "DNS Application Layer Protocol", "Command and Control"),
    ("c2_beacon", "T1071", "Application Layer Protocol", "Command and Control"),
    ("sqli", "T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("lateral_movement", "T1021", "Remote Services", "Lateral Movement"),
    ("data_exfil", "T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    ("malware_callback", "T1095", "Non-Application Layer Protocol", "Command and Control"),
    ("ddos", "T1498", "Network Denial of Service", "Impact"),
    ("cred_stuffing", "T1078", "Valid Accounts", "Defense Evasion"),
    ("priv_escalation", "T1068", "Exploitation for Privilege Escalation", "Privilege Escalation"),
    ("dns_recon", "T1590", "Gather Victim Network Information", "Reconnaissance"),
]

# Techniques without a detector, known only by id.
OTHER_TECHNIQUES = [
    ("T1566", "Phishing", "Initial Access"),
    ("T1059", "Command and Scripting Interpreter", "Execution"),
]

UNKNOWN_TECHNIQUE = ("T0000", "Unknown", "Unknown")

# Well-known port to protocol.
PORT_PROTOCOLS = {
    20: "FTP",
    21: "FTP",
    22: "SSH",
    23: "TELNET",
    25: "SMTP",
    53: "DNS",
    80: "HTTP",
    110: "POP3",
    123: "NTP",
    143: "IMAP",
    161: "SNMP",
    162: "SNMP",
    443: "HTTPS",
    445: "SMB",
    587: "SMTP",
    993: "IMAP",
    995: "POP3",
    3389: "RDP",
    8080: "HTTP",
    8443: "HTTPS",
}

# Protocol to risk class; protocols not listed are INFO.
PROTOCOL_RISKS = {
    "TELNET": "HIGH",
    "FTP": "MEDIUM",
    "SNMP": "MEDIUM",
    "HTTP": "LOW",
    "SMTP": "LOW",
    "SSH": "LOW",
    "HTTPS": "INFO",
    "DNS": "INFO",
    "NTP": "INFO",
    "TCP": "INFO",
    "UDP": "INFO",
    "ICMP": "INFO",
    "TLS": "INFO",
    "QUIC": "INFO",
    "ARP": "INFO",
}
DEFAULT_RISK = "INFO"

# Protocols whose payload is encrypted.
ENCRYPTED_PROTOCOLS = ["HTTPS", "TLS", "SSH", "QUIC", "IMAP+TLS", "POP3+TLS"]

# Countries whose traffic counts as a threat.
THREAT_COUNTRIES = ["KP", "IR", "RU"]

# Protocol, metric, threshold. Only metrics that packet columns can express.
THRESHOLDS = [
    ("TCP", "syn_rate", 100.0),
    ("TCP", "conn_rate", 50.0),
    ("UDP", "flood_pps", 500.0),
    ("UDP", "amp_factor", 10.0),
    ("HTTP", "req_rate", 200.0),
    ("HTTPS", "req_rate", 200.0),
    ("DNS", "query_rate", 100.0),
    ("ICMP", "ping_rate", 50.0),
    ("ICMP", "large_pkt", 1000.0),
    ("FTP", "data_conn", 20.0),
    ("SSH", "session_rate", 10.0),
    ("SMTP", "relay_rate", 50.0),
    ("SMTP", "attach_size", 10000000.0),
    ("SNMP", "scan_rate", 20.0),
    ("NTP", "amp_pkt", 468.0),
    ("ARP", "gratuitous", 5.0),
    ("ARP", "scan_rate", 30.0),
    ("QUIC", "stream_flood", 100.0),
]

# Detection rules: rule, threat type (also the technique key), confidence of a hit.
# The confidences are our own constants.
RULES = [
    ("port_scan", "port_scan", 0.95),
    ("syn_flood", "ddos", 0.97),
    ("lateral_movement", "lateral_movement", 0.85),
    ("udp_flood", "ddos", 0.97),
    ("http_flood", "ddos", 0.92),
    ("c2_beacon", "c2_beacon", 0.90),
    ("dns_recon", "dns_recon", 0.80),
    ("icmp_large", "ddos", 0.78),
    ("icmp_flood", "ddos", 0.93),
    ("ssh_brute_force", "brute_force", 0.94),
    ("smtp_large", "data_exfil", 0.82),
    ("ntp_amplification", "ddos", 0.91),
    ("exfil", "data_exfil", 0.88),
    ("sqli", "sqli", 0.86),
    ("dns_tunnel", "dns_tunnel", 0.87),
    ("ftp_auth_fail", "brute_force", 0.83),
    ("arp_spoof", "lateral_movement", 0.84),
    ("tls_old_version", "malware_callback", 0.79),
]


def _local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    # Arrow input becomes a LocalRelation: no job, and the optimizer knows its size.
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)]
    return spark.createDataFrame(pa.table(columns, schema=schema))


# Text and severity of findings that batch and streams share.
FINDING_TEXTS = {
    "port_scan": ("Port scan from %s: %d ports probed", "HIGH"),
    "c2_beacon": ("C2 beaconing pattern from %s: regular %ds intervals", "CRITICAL"),
    "dns_recon": ("DNS reconnaissance from %s: %d queries", "MEDIUM"),
    "ssh_brute_force": ("SSH brute force from %s: %d attempts", "HIGH"),
    "exfil": ("Data exfiltration from %s: %dMB transferred", "HIGH"),
}


# Texts of the other findings.
ROW_TEXTS = {
    "lateral_movement": "Lateral movement: %s -> %s:%d",
    "icmp_large": "ICMP large packet from %s: %d bytes",
    "smtp_large": "Large SMTP attachment from %s: %dKB",
    "ntp_amplification": "NTP amplification from %s: %d byte response",
    "sqli": "SQL injection attempt from %s detected in HTTP payload",
    "dns_tunnel": "DNS tunneling suspected from %s: label length %d chars",
    "tls_old_version": "TLS anomaly from %s: outdated protocol version",
    "ftp_auth_fail": "FTP authentication failure from %s",
    "arp_spoof": "ARP spoofing attempt detected from %s",
}


def technique_table(spark: SparkSession) -> DataFrame:
    """Detector keys and the techniques they stand for."""
    names = ["mitre_key", "technique_id", "technique_name", "tactic"]
    return _local_table(spark, TECHNIQUES, pa.schema([(n, pa.string()) for n in names]))


def technique_catalog(spark: SparkSession) -> DataFrame:
    """All known techniques, with and without a detector."""
    names = ["technique_id", "technique_name", "tactic"]
    rows = [row[1:] for row in TECHNIQUES] + OTHER_TECHNIQUES
    return _local_table(spark, rows, pa.schema([(n, pa.string()) for n in names]))


def port_table(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("port", pa.int32()), ("port_protocol", pa.string())])
    return _local_table(spark, list(PORT_PROTOCOLS.items()), schema)


def risk_table(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("protocol", pa.string()), ("risk", pa.string())])
    return _local_table(spark, list(PROTOCOL_RISKS.items()), schema)


def threshold_table(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("protocol", pa.string()), ("metric", pa.string()), ("threshold", pa.float64())])
    return _local_table(spark, THRESHOLDS, schema)


def rule_table(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("rule", pa.string()), ("mitre_key", pa.string()), ("confidence", pa.float64())])
    return _local_table(spark, RULES, schema)
