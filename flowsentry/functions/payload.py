"""Payload functions: entropy, signatures, protocol handshakes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extension headers of IPv6 that count as anomalous.
IPV6_ANOMALOUS_HEADERS = [0, 43, 44, 60]

# Methods recognised at the start of an HTTP request.
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]

# Our own patterns of SQL injection, matched in any letter case.
SQLI_PATTERNS = [
    r"\bunion\s+(all\s+)?select\b",
    r"'\s*(or|and)\s+'?[0-9a-z]+'?\s*=\s*'?[0-9a-z]+",
    r";\s*(drop|alter|truncate)\s+table\b",
    r"\b(sleep|benchmark|pg_sleep)\s*\(",
    r"\binformation_schema\b",
]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _bytes(text: str) -> Column:
    return F.to_binary(F.lit(text), F.lit("utf-8"))


def _hex_bytes(digits: str) -> Column:
    return F.to_binary(F.lit(digits), F.lit("hex"))


def payload_entropy(payload) -> Column:
    """Shannon entropy of the bytes in bits, three decimals; 0 for empty payloads.

    The user function is made per call: once used it holds a handle of the driver, and this module travels to
    workers with functions of others.
    """
    return F.pandas_udf(_entropies, T.DoubleType())(_col(payload))


def _entropies(payload: pd.Series) -> pd.Series:
    """One count of (payload, byte) pairs serves many payloads; they are taken together by the thousand, so the
    counts stay at two megabytes.
    """
    found = []
    for start in range(0, len(payload), 1000):
        parts = [data or b"" for data in payload.iloc[start : start + 1000]]
        sizes = np.array([len(data) for data in parts])
        rows = np.repeat(np.arange(len(parts)) * 256, sizes)
        rows += np.frombuffer(b"".join(parts), dtype=np.uint8)
        counts = np.bincount(rows, minlength=256 * len(parts)).reshape(-1, 256)
        shares = counts / np.maximum(sizes, 1)[:, None]
        bits = np.log2(shares, out=np.zeros_like(shares), where=counts > 0)
        found.append(-(shares * bits).sum(axis=1).round(3) + 0.0)
    return pd.Series(np.concatenate(found) if found else [], dtype="float64").round(3) + 0.0


def port_classification(dst_name, src_name, l4) -> Column:
    """Protocol by destination port, else by source port, else the transport itself."""
    l4 = _col(l4)
    named = F.coalesce(_col(dst_name), _col(src_name), l4)
    return F.when(l4.isin("TCP", "UDP"), named).otherwise(F.lit("UNKNOWN"))


def ipv6_anomaly(ip_version, flow_label, next_header) -> Column:
    """IPv6 with a flow label, or with a suspicious (or missing) next header."""
    header = F.coalesce(_col(next_header), F.lit(0))
    label = F.coalesce(_col(flow_label), F.lit(0))
    suspicious = (label != 0) | header.isin(IPV6_ANOMALOUS_HEADERS)
    return F.coalesce((_col(ip_version) == 6) & suspicious, F.lit(False))


def payload_signature(payload) -> Column:
    """Protocol named by the payload bytes, NULL if none is recognised."""
    payload = _col(payload)
    http = [F.startswith(payload, _bytes(start)) for start in ("GET ", "POST ", "HTTP/")]
    return (
        F.when(http[0] | http[1] | http[2], F.lit("HTTP"))
        .when(F.startswith(payload, _hex_bytes("1603")), F.lit("TLS"))
        .when(F.contains(payload, _bytes("SSH-")), F.lit("SSH"))
    )


def http_method(payload) -> Column:
    """Method of an HTTP request, empty text if the payload is none."""
    return F.regexp_extract(_col(payload).cast("string"), rf"^({'|'.join(HTTP_METHODS)}) ", 1)


def has_sql_injection(payload) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in SQLI_PATTERNS)
    return F.coalesce(_col(payload).cast("string").rlike(pattern), F.lit(False))


def longest_label(qname) -> Column:
    """Length of the longest label of a domain name."""
    return F.array_max(F.transform(F.split(_col(qname), "[.]"), lambda label: F.length(label)))


def is_ftp_auth_failure(payload) -> Column:
    return F.coalesce(F.startswith(_col(payload), _bytes("530")), F.lit(False))


def is_old_tls_hello(payload) -> Column:
    """A ServerHello that settles on a version below TLS 1.2."""
    payload = _col(payload)
    handshake = F.hex(F.substring(payload, 1, 2)) == "1603"
    server_hello = F.hex(F.substring(payload, 6, 1)) == "02"
    version = F.hex(F.substring(payload, 10, 2))
    old = (F.length(version) == 4) & (version < "0303")
    return F.coalesce(handshake & server_hello & old, F.lit(False))
