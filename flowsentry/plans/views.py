"""Packet, alert and other tables derived from the driver's tables, as views.

The SQL text is shared with the checks, which run it in another engine; ``{US}`` and the other
names in braces stand for what differs between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_WORDS = {
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "BYTES": "encode({0}, 'UTF-8')",
    "HEX": "unhex('{0}')",
}

PACKETS = """
SELECT pid,
  CASE WHEN pos >= 700 THEN ev_us ELSE 1704067200000000 + blk*72000000000 + CASE sc
    WHEN 0 THEN pos*10000 WHEN 1 THEN pos*100000 WHEN 2 THEN pos*5000 WHEN 3 THEN pos*50000
    WHEN 4 THEN pos*60000000 + (pos%3)*1000000 WHEN 5 THEN pos*1000000 WHEN 6 THEN pos*50000
    WHEN 7 THEN pos*10000000 + CASE WHEN pos >= 350 THEN 7200000000 ELSE 0 END
    WHEN 8 THEN pos*2000000 ELSE pos*1000000 END END AS ts_us,
  CASE WHEN pos < 700 THEN concat('185.220.', CAST(sc AS STRING), '.', CAST(1 + blk%250 AS STRING))
    ELSE concat('10.0.', CAST(user_id%4 AS STRING), '.', CAST(1 + user_id%250 AS STRING)) END AS src_ip,
  CASE WHEN pos < 700 THEN '198.18.0.1' WHEN pos%2 = 0 THEN concat('192.168.1.', CAST(1 + pos%250 AS STRING))
    ELSE concat('8.8.4.', CAST(1 + pos%250 AS STRING)) END AS dst_ip,
  CAST(1024 + (pid*7919)%60000 AS INT) AS src_port,
  CAST(CASE WHEN pos < 700 THEN CASE sc WHEN 0 THEN 80 WHEN 1 THEN 1 + pos WHEN 2 THEN 9999 WHEN 3 THEN 80
      WHEN 4 THEN 80 WHEN 5 THEN 53 WHEN 6 THEN NULL WHEN 7 THEN 22 WHEN 8 THEN 25 ELSE 443 END
    ELSE CASE pos%5 WHEN 0 THEN 445 WHEN 1 THEN 3389 WHEN 2 THEN 123 WHEN 3 THEN 0 ELSE 443 END END AS INT) AS dst_port,
  CASE WHEN pos < 700 THEN CASE sc WHEN 0 THEN 'TCP' WHEN 1 THEN 'TCP' WHEN 2 THEN 'UDP' WHEN 3 THEN 'HTTP'
      WHEN 4 THEN 'HTTP' WHEN 5 THEN 'DNS' WHEN 6 THEN 'ICMP' WHEN 7 THEN 'SSH' WHEN 8 THEN 'SMTP' ELSE 'HTTPS' END
    ELSE CASE pos%5 WHEN 2 THEN 'NTP' WHEN 3 THEN 'ARP' WHEN 4 THEN 'TLS' ELSE 'TCP' END END AS protocol,
  CAST(CASE WHEN pos < 700 THEN CASE sc WHEN 6 THEN CASE WHEN pos%10 = 0 THEN 1200 ELSE 64 END
      WHEN 8 THEN CASE WHEN pos%100 = 0 THEN 600000 ELSE 400 END WHEN 9 THEN 50000 ELSE 60 END
    ELSE CASE WHEN pos%5 = 2 THEN 400 + pos%150 ELSE 40 + pos END END AS INT) AS length,
  CASE WHEN pos < 700 AND sc = 0 THEN 'SYN' WHEN pos < 700 AND sc = 1 THEN 'ACK'
    WHEN pos >= 700 AND pos%5 < 2 THEN 'PSH|ACK' ELSE '' END AS flags,
  CASE WHEN pos < 700 AND sc <> 5 THEN 1 ELSE 0 END AS is_malicious
FROM (SELECT event_id AS pid, {US} AS ev_us, user_id,
        CAST(floor(event_id/1000) AS BIGINT) AS blk, CAST(floor(event_id/1000) AS BIGINT)%10 AS sc,
        event_id%1000 AS pos FROM {events}) e
"""

ALERTS = """
SELECT event_id AS id, {US} AS ts_us,
  CASE WHEN event_id%100 < 3 THEN 'CRITICAL' WHEN event_id%100 < 13 THEN 'HIGH' WHEN event_id%100 < 38 THEN 'MEDIUM'
    WHEN event_id%100 < 78 THEN 'LOW' ELSE 'INFO' END AS severity,
  concat('Type ', CAST((event_id*event_id)%17 AS STRING)) AS alert_type,
  concat('10.0.0.', CAST(1 + user_id%250 AS STRING)) AS src_ip,
  concat('192.168.1.', CAST(1 + event_id%250 AS STRING)) AS dst_ip,
  CASE event_id%4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'HTTP' ELSE 'DNS' END AS protocol,
  CASE WHEN (event_id*7)%10 < 6 THEN 1 ELSE 0 END AS acknowledged
FROM {events}
"""

MITRE_EVENTS = """
SELECT event_id AS id, {US} AS ts_us, concat('T1', CAST(100 + (event_id*event_id)%13 AS STRING)) AS technique_id,
  concat('Technique ', CAST((event_id*event_id)%13 AS STRING)) AS technique_name,
  concat('Tactic ', CAST(((event_id*event_id)%13)%5 AS STRING)) AS tactic,
  CASE WHEN event_id%3 = 0 THEN NULL ELSE event_id + 5 END AS alert_id,
  CAST(75 + (event_id*31)%25 AS DOUBLE)/100 AS confidence
FROM {events}
"""

GEO_TRAFFIC = """
SELECT event_id AS id, {US} AS ts_us, concat('10.0.0.', CAST(1 + user_id%250 AS STRING)) AS src_ip,
  CASE event_id%7 WHEN 0 THEN 'US' WHEN 1 THEN 'CN' WHEN 2 THEN 'RU' WHEN 3 THEN 'DE' WHEN 4 THEN 'KP' WHEN 5 THEN 'IR' ELSE 'BR' END AS country,
  CAST(40 + (event_id*13)%5 AS DOUBLE) AS latitude, CAST((event_id*17)%90 AS DOUBLE) AS longitude,
  CASE WHEN event_id%7 IN (2,4,5) THEN 1 ELSE 0 END AS is_threat, CAST(1 + event_id%50 AS INT) AS pkt_count
FROM {events}
"""

PERFORMANCE_METRICS = """
SELECT event_id AS id, 1704067200000000 + event_id*60000000 AS ts_us,
  CAST(4000 + (event_id*37)%2500 AS INT) AS packets_pm, CAST(20 + (event_id*11)%100 AS INT) AS alerts_pm,
  CAST((event_id*3)%45 AS DOUBLE) AS db_query_ms, CAST((event_id*5)%55 AS DOUBLE) AS cpu_pct,
  CAST(512 + event_id%688 AS DOUBLE) AS mem_mb, CAST(event_id%80 AS DOUBLE)/100 AS drop_pct
FROM {events}
"""

# Both directions of a connection per pair of packets, with some closing flags.
TWO_WAY_PACKETS = """
SELECT pid, ts_us, length, protocol,
  CASE WHEN back = 1 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN back = 1 THEN src_ip ELSE dst_ip END AS dst_ip,
  CASE WHEN back = 1 THEN dst_port ELSE client_port END AS src_port,
  CASE WHEN back = 1 THEN client_port ELSE dst_port END AS dst_port,
  CASE WHEN pid%97 = 0 THEN 'FIN|ACK' WHEN pid%211 = 0 THEN 'RST' ELSE flags END AS flags
FROM (SELECT pid, ts_us, length, protocol, src_ip, dst_ip, dst_port, flags,
        CAST(4000 + pid%3 AS INT) AS client_port, CASE WHEN pid%5 IN (1, 2) THEN 1 ELSE 0 END AS back
      FROM {packets}) p
"""

# Address ranges: the /24s and parts of /24s that the packet view uses, and some it does not.
GEO_RANGES = """
SELECT DISTINCT lo, hi, country, concat('City ', country) AS city,
  CAST(lo%90 AS DOUBLE) AS latitude, CAST(lo%180 AS DOUBLE) AS longitude
FROM (SELECT 3118202880 + (event_id%10)*256 AS lo, 3118202880 + (event_id%10)*256 + 127 AS hi,
        CASE event_id%10 WHEN 0 THEN 'KP' WHEN 1 THEN 'RU' WHEN 2 THEN 'IR' WHEN 3 THEN 'DE' ELSE 'US' END AS country
      FROM {events}
      UNION ALL
      SELECT 167772160 + (event_id%3)*256 AS lo, 167772160 + (event_id%3)*256 + 255 - (event_id%3)*100 AS hi,
        CASE event_id%3 WHEN 0 THEN 'FR' WHEN 1 THEN 'BR' ELSE 'RU' END AS country
      FROM {events}
      UNION ALL
      SELECT 167837696 AS lo, 184549375 AS hi, 'GB' AS country FROM {events}) r
"""

# Packets with payloads, made from whole web pages. Time runs on by a tenth of a second per page.
PAYLOAD_PACKETS = """
SELECT page_id AS pid, 1704067200000000 + page_id*100000 AS ts_us,
  concat('10.1.0.', CAST(1 + page_id%3 AS STRING)) AS src_ip,
  concat('10.2.0.', CAST(1 + page_id%2 AS STRING)) AS dst_ip,
  CAST(CASE WHEN page_id%6 = 0 THEN 6 ELSE 4 END AS INT) AS ip_version,
  CAST(CASE WHEN page_id%12 = 0 THEN 7 ELSE 0 END AS INT) AS flow_label,
  CAST(CASE page_id%18 WHEN 6 THEN NULL WHEN 12 THEN 44 ELSE 6 END AS INT) AS next_header,
  CASE page_id%7 WHEN 0 THEN 'UDP' WHEN 1 THEN NULL ELSE 'TCP' END AS l4,
  CAST(CASE page_id%5 WHEN 0 THEN 53 ELSE 50000 + page_id%1000 END AS INT) AS src_port,
  CAST(CASE page_id%4 WHEN 0 THEN 8080 WHEN 1 THEN 40000 WHEN 2 THEN 993 ELSE NULL END AS INT) AS dst_port,
  CAST(page_id%64 AS INT) AS flag_bits,
  CASE page_id%8 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'TLS' WHEN 3 THEN 'SSH' WHEN 4 THEN 'FTP'
    WHEN 5 THEN 'ARP' WHEN 6 THEN 'HTTP' ELSE 'DNS' END AS protocol,
  CASE WHEN page_id%16 = 15 THEN concat(repeat('x', CAST(40 + page_id%30 AS INT)), '.', host) ELSE host END AS qname,
  concat('02:00:00:00:00:0', CAST(CASE WHEN page_id%3 = 0 THEN 9 ELSE page_id%5 END AS STRING)) AS src_mac,
  CASE page_id%8 WHEN 0 THEN {get_bytes} WHEN 1 THEN {post_bytes}
    WHEN 2 THEN CASE page_id%3 WHEN 0 THEN {old_hello} WHEN 1 THEN {new_hello} ELSE {client_hello} END
    WHEN 3 THEN {ssh_bytes} WHEN 4 THEN CASE WHEN page_id%3 < 2 THEN {ftp_bad} ELSE {ftp_good} END
    WHEN 5 THEN NULL WHEN 6 THEN {reply_bytes} ELSE {html_bytes} END AS payload
FROM (SELECT page_id, url, html, split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1) AS host,
        CASE WHEN page_id%3 = 0 THEN concat('?id=1', chr(39), ' OR 1=1 --') WHEN page_id%3 = 1 THEN '?q=a UNION  SELECT b' ELSE '' END AS attack
      FROM {pages}) p
"""

# The payloads above: expression of the text, or the bytes in hex.
PAYLOAD_TEXTS = {
    "get_bytes": "concat('GET ', url, attack, ' HTTP/1.1')",
    "post_bytes": "concat('POST ', url, ' HTTP/1.1 ', html)",
    "ssh_bytes": "concat('banner SSH-2.0-', host)",
    "ftp_bad": "'530 Login incorrect.'",
    "ftp_good": "'230 Login successful.'",
    "reply_bytes": "concat('HTTP/1.1 200 OK ', html)",
    "html_bytes": "html",
}
PAYLOAD_HEX = {
    "old_hello": "160301004A020000460301AABB",
    "new_hello": "160303004A020000460303AABB",
    "client_hello": "160301004A010000460301AABB",
}

# Plain packets and those with payloads in one table, so that every rule has its packets.
LIVE_PACKETS = """
SELECT pid, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, length, flags, is_malicious,
  CAST(NULL AS BINARY) AS payload, CAST(NULL AS STRING) AS qname, CAST(NULL AS STRING) AS src_mac
FROM {packets}
UNION ALL
SELECT pid + 1000000000, ts_us, src_ip, dst_ip, src_port, dst_port, protocol,
  CAST(coalesce(octet_length(payload), 28) AS INT), '', 0, payload, qname, src_mac
FROM {payload_packets}
"""

VIEWS = {
    "packets": PACKETS,
    "alerts": ALERTS,
    "mitre_events": MITRE_EVENTS,
    "geo_traffic": GEO_TRAFFIC,
    "performance_metrics": PERFORMANCE_METRICS,
    "two_way_packets": TWO_WAY_PACKETS,
    "geo_ranges": GEO_RANGES,
    "payload_packets": PAYLOAD_PACKETS,
    "live_packets": LIVE_PACKETS,
}


def view_text(name: str, words: dict[str, str], tables: dict[str, str]) -> str:
    """SQL of a view with the words of an engine and the names of its input tables."""
    names = {"US": words["US"], **tables}
    names |= {key: words["BYTES"].format(text) for key, text in PAYLOAD_TEXTS.items()}
    names |= {key: words["HEX"].format(digits) for key, digits in PAYLOAD_HEX.items()}
    return VIEWS[name].format(**names)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf_dir``."""
    if name == "two_way_packets":
        tables = {"packets": view(spark, sf_dir, "packets")}
    elif name == "live_packets":
        tables = {part: view(spark, sf_dir, part) for part in ("packets", "payload_packets")}
    elif name == "payload_packets":
        tables = {"pages": read_table(spark, sf_dir, "pages")}
    else:
        tables = {"events": read_table(spark, sf_dir, "events")}
    text = view_text(name, SPARK_WORDS, {table: f"{{{table}}}" for table in tables})
    return spark.sql(text, **tables)
