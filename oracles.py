"""DuckDB SQL that every catalog query must match, over the same tables.

The views are shared text; the operators themselves are written a different way here: sliding
counts as RANGE frames, gaps as self-joins, resetting folds as recursive CTEs.
"""

from __future__ import annotations

from flowsentry import dims
from flowsentry.functions.payload import SQLI_PATTERNS
from flowsentry.plans.views import view_text

DUCK_WORDS = {"US": "epoch_us(ts)", "BYTES": "encode({0})", "HEX": "unhex('{0}')"}

_INPUTS = {"two_way_packets": ["packets"], "payload_packets": []}


def _values(rows) -> str:
    def literal(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


def _cte(name: str, body: str, materialized: bool = True) -> str:
    return f"{name} AS {'MATERIALIZED ' if materialized else ''}({body})"


def _query(views: list[str], body: str, more: list[tuple[str, str]] = ()) -> str:
    tables = {"events": "events", "pages": "pages", "packets": "packets"}
    parts = [_cte(name, view_text(name, DUCK_WORDS, tables)) for name in views]
    parts += [_cte(name, text) if not name.endswith(")") else f"{name} AS ({text})" for name, text in more]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}"


def packets(body: str, *more: tuple[str, str]) -> str:
    return _query(["packets"], body, list(more))


ORACLES: dict[str, str] = {}

_P = "pid, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, length, flags, is_malicious"
_SEV = "('CRITICAL','HIGH','MEDIUM','LOW','INFO')"

ORACLES["s1_scan_packets"] = packets(f"SELECT {_P} FROM packets")
_TEXT_IDS = {"alerts": "id", "mitre": "id, alert_id"}
for _name, _view in [("alerts", "alerts"), ("geo", "geo_traffic"), ("mitre", "mitre_events"), ("perf", "performance_metrics")]:
    _texts = [f"CAST({_id} AS VARCHAR) AS {_id}" for _id in _TEXT_IDS.get(_name, "").split(", ") if _id]
    _replaced = f" REPLACE ({', '.join(_texts)})" if _texts else ""
    ORACLES[f"s2_scan_{_name}"] = _query([_view], f"SELECT *{_replaced} FROM {_view}")
ORACLES["s4_sink_packets"] = packets(
    "SELECT CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS dt, count(*) AS pkt_count,"
    " CAST(sum(length) AS BIGINT) AS byte_count FROM packets GROUP BY 1"
)

# Findings -------------------------------------------------------------------------------------

_TECH = ("tech(mitre_key, technique_id, technique_name, tactic)", "SELECT * FROM (VALUES " + _values(dims.TECHNIQUES) + ")")
_RULE = ("rules(rule, threat_type, confidence)", "SELECT * FROM (VALUES " + _values(dims.RULES) + ")")

_PRIVATE = """(n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647
 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303
 OR (n BETWEEN 3221225472 AND 3221225727 AND n NOT IN (3221225481, 3221225482))
 OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055
 OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959
 OR n BETWEEN 3405803776 AND 3405804031 OR n BETWEEN 4026531840 AND 4294967295)"""


def _number(ip: str) -> str:
    parts = " + ".join(
        f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
    )
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return f"CASE WHEN regexp_full_match({ip}, '{octet}([.]{octet}){{3}}') THEN {parts} END"


def _private(ip: str) -> str:
    return f"(SELECT coalesce({_PRIVATE}, false) FROM (SELECT {_number(ip)} AS n))"


def _finding(rule: str, severity: str, text: str, source: str, threat: str) -> str:
    return (
        f"SELECT pid, ts_us, src_ip, dst_ip, protocol, '{rule}' AS rule, '{threat}' AS threat_type,"
        f" {severity} AS severity, {text} AS description, '{threat}' AS mitre_key FROM {source}"
    )


_RATES = (
    "rates",
    """SELECT *, count(*) OVER (w RANGE BETWEEN 4999999 PRECEDING AND CURRENT ROW) AS r5,
  count(*) OVER (w RANGE BETWEEN 9999999 PRECEDING AND CURRENT ROW) AS r10,
  count(*) OVER (w RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS r60
FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us)""",
)
_SIDS = (
    "sids",
    """SELECT *, CAST(sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts_us, pid
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid
FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, pid) AS gap FROM packets)""",
)
_NTH = (
    "nth",
    "SELECT *, row_number() OVER (PARTITION BY src_ip, sid, protocol ORDER BY ts_us, pid) AS nth FROM sids",
)
_GAPS = (
    "gaps",
    """SELECT pid, count(*) AS n_events, avg(gap) AS avg_gap, var_pop(gap) AS var_gap, max(src_ip) AS src_ip,
  max(dst_ip) AS dst_ip, max(protocol) AS protocol, max(ts_us) AS ts_us
FROM (SELECT a.pid, a.src_ip, a.dst_ip, a.protocol, a.ts_us,
        (b.ts_us - lag(b.ts_us) OVER (PARTITION BY a.pid ORDER BY b.ts_us, b.pid)) / 1e6 AS gap
      FROM packets a JOIN packets b ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us - 3600000000 AND a.ts_us)
GROUP BY pid""",
)


def _sum_fold(limit: int) -> list[tuple[str, str]]:
    return [
        (
            "lined",
            f"""SELECT *, row_number() OVER (PARTITION BY src_ip, sid ORDER BY ts_us, pid) AS rn
FROM sids WHERE (src_ip, sid) IN (SELECT (src_ip, sid) FROM sids GROUP BY src_ip, sid HAVING sum(length) > {limit})""",
        ),
        (
            "sums(pid, src_ip, sid, rn, acc)",
            f"""SELECT pid, src_ip, sid, rn, CAST(length AS BIGINT) FROM lined WHERE rn = 1
UNION ALL SELECT l.pid, l.src_ip, l.sid, l.rn, CASE WHEN s.acc > {limit} THEN 0 ELSE s.acc END + l.length
FROM sums s JOIN lined l ON l.src_ip = s.src_ip AND l.sid = s.sid AND l.rn = s.rn + 1""",
        ),
    ]


def _set_fold(limit: int) -> list[tuple[str, str]]:
    return [
        (
            "probes",
            f"""SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, pid) AS rn
FROM packets WHERE protocol = 'TCP' AND dst_port <> 0 AND (src_ip, dst_ip) IN (SELECT (src_ip, dst_ip) FROM packets
  WHERE protocol = 'TCP' AND dst_port <> 0 GROUP BY src_ip, dst_ip HAVING count(DISTINCT dst_port) > {limit})""",
        ),
        (
            "sets(pid, src_ip, dst_ip, rn, ports)",
            f"""SELECT pid, src_ip, dst_ip, rn, [dst_port] FROM probes WHERE rn = 1
UNION ALL SELECT p.pid, p.src_ip, p.dst_ip, p.rn, CASE WHEN len(s.ports) > {limit} THEN [p.dst_port]
  WHEN list_contains(s.ports, p.dst_port) THEN s.ports ELSE list_append(s.ports, p.dst_port) END
FROM sets s JOIN probes p ON p.src_ip = s.src_ip AND p.dst_ip = s.dst_ip AND p.rn = s.rn + 1""",
        ),
    ]


# Rule: the CTEs it needs, and the SELECT of its findings.
_RULES: dict[str, tuple[list[tuple[str, str]], str]] = {
    "port_scan": (
        _set_fold(50),
        _finding("port_scan", "'HIGH'", "concat('Port scan from ', src_ip, ': 51 ports probed')",
                 "packets WHERE pid IN (SELECT pid FROM sets WHERE len(ports) > 50)", "port_scan"),
    ),
    "syn_flood": (
        [_RATES],
        _finding("syn_flood", "'CRITICAL'", "concat('SYN flood from ', src_ip, ': ', r10, ' SYN pkts/10s')",
                 "rates WHERE protocol = 'TCP' AND flags = 'SYN' AND r10 > 200", "ddos"),
    ),
    "lateral_movement": (
        [],
        _finding("lateral_movement", "'HIGH'", "concat('Lateral movement: ', src_ip, ' -> ', dst_ip, ':', dst_port)",
                 f"packets WHERE protocol = 'TCP' AND dst_port IN (445, 3389, 5985) AND {_private('src_ip')} AND {_private('dst_ip')}",
                 "lateral_movement"),
    ),
    "udp_flood": (
        [_RATES],
        _finding("udp_flood", "'CRITICAL'", "concat('UDP flood from ', src_ip, ': ', r5, ' pkts/5s')",
                 "rates WHERE protocol = 'UDP' AND r5 > 500", "ddos"),
    ),
    "http_flood": (
        [_RATES],
        _finding("http_flood", "'HIGH'", "concat('HTTP flood from ', src_ip, ': ', r60, ' req/min')",
                 "rates WHERE protocol = 'HTTP' AND r60 > 300", "ddos"),
    ),
    "c2_beacon": (
        [_GAPS],
        _finding("c2_beacon", "'CRITICAL'",
                 "concat('C2 beaconing pattern from ', src_ip, ': regular ', CAST(round_even(avg_gap, 0) AS BIGINT), 's intervals')",
                 "gaps WHERE protocol = 'HTTP' AND n_events >= 6 AND round(var_gap, 6) < 5 AND avg_gap > 20 AND avg_gap < 300",
                 "c2_beacon"),
    ),
    "dns_recon": (
        [_SIDS, _NTH],
        _finding("dns_recon", "'MEDIUM'", "concat('DNS reconnaissance from ', src_ip, ': ', nth, ' queries')",
                 "nth WHERE protocol = 'DNS' AND nth % 100 = 0", "dns_recon"),
    ),
    "icmp_large": (
        [],
        _finding("icmp_large", "'MEDIUM'", "concat('ICMP large packet from ', src_ip, ': ', length, ' bytes')",
                 "packets WHERE protocol = 'ICMP' AND length > 1000", "ddos"),
    ),
    "icmp_flood": (
        [_RATES],
        _finding("icmp_flood", "'HIGH'", "concat('ICMP flood from ', src_ip, ': ', r10, ' pkts/10s')",
                 "rates WHERE protocol = 'ICMP' AND r10 > 100", "ddos"),
    ),
    "ssh_brute_force": (
        [_SIDS, _NTH],
        _finding("ssh_brute_force", "CASE WHEN nth >= 50 THEN 'CRITICAL' ELSE 'HIGH' END",
                 "concat('SSH brute force from ', src_ip, ': ', nth, ' attempts')",
                 "nth WHERE protocol = 'SSH' AND nth IN (5, 20, 50, 100)", "brute_force"),
    ),
    "smtp_large": (
        [],
        _finding("smtp_large", "'HIGH'", "concat('Large SMTP attachment from ', src_ip, ': ', length // 1024, 'KB')",
                 "packets WHERE protocol = 'SMTP' AND length > 500000", "data_exfil"),
    ),
    "ntp_amplification": (
        [],
        _finding("ntp_amplification", "'HIGH'", "concat('NTP amplification from ', src_ip, ': ', length, ' byte response')",
                 "packets WHERE protocol = 'NTP' AND length > 468", "ddos"),
    ),
    "exfil": (
        [_SIDS, *_sum_fold(10_000_000)],
        _finding("exfil", "'HIGH'", "concat('Data exfiltration from ', src_ip, ': ', acc // 1000000, 'MB transferred')",
                 "(SELECT p.*, s.acc FROM sums s JOIN packets p USING (pid) WHERE s.acc > 10000000)", "data_exfil"),
    ),
}


def findings(body: str, rules: list[str], *more: tuple[str, str], views: tuple[str, ...] = ()) -> str:
    """SQL over a ``findings`` CTE that holds the findings of the rules."""
    needed: dict[str, str] = {}
    for rule in rules:
        needed |= dict(_RULES[rule][0])
    union = " UNION ALL ".join(_RULES[rule][1] for rule in rules)
    return _query(["packets", *views], body, [*needed.items(), ("findings", union), *more])


_ROW = ["lateral_movement", "icmp_large", "smtp_large", "ntp_amplification"]
_ALL = list(_RULES)
_NUMBERS = {
    "d1": "port_scan", "d2": "syn_flood", "d3": "lateral_movement", "d4": "udp_flood", "d5": "http_flood",
    "d6": "c2_beacon", "d7": "dns_recon", "d8": "icmp_large", "d9": "icmp_flood", "d10": "ssh_brute_force",
    "d11": "smtp_large", "d12": "ntp_amplification", "d13": "exfil",
}
for _id, _rule in _NUMBERS.items():
    ORACLES[f"{_id}_{_rule}"] = findings("SELECT * FROM findings", [_rule])
ORACLES["u1_union_findings"] = findings("SELECT * FROM findings", ["icmp_large", "icmp_flood", "smtp_large"])
_KNOWN = (
    "coalesce(t.technique_id, 'T0000') AS technique_id, coalesce(t.technique_name, 'Unknown') AS technique_name,"
    " coalesce(t.tactic, 'Unknown') AS tactic"
)
ORACLES["d14_all_findings"] = findings(
    f"SELECT f.*, {_KNOWN} FROM findings f LEFT JOIN tech t USING (mitre_key)", _ALL, _TECH
)
ORACLES["d23_findings_over_runs"] = ORACLES["d14_all_findings"]
_TITLE = "array_to_string(list_transform(string_split({0}, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_KEY = "md5(concat(f.pid, '|', f.rule))"
_ALERT_ROWS = f"""SELECT {_KEY} AS id, f.ts_us, f.severity, {_TITLE.format('f.threat_type')} AS alert_type, f.src_ip, f.dst_ip,
  f.protocol, f.description, t.technique_id AS mitre_id, t.technique_name AS mitre_name, 0 AS acknowledged,
  concat('{{"pid":', f.pid, ',"rule":"', f.rule, '"}}') AS raw_data
FROM findings f LEFT JOIN tech t USING (mitre_key)"""
ORACLES["d15_build_alerts"] = findings(_ALERT_ROWS, _ALL, _TECH)
ORACLES["d16_build_mitre_events"] = findings(
    f"SELECT md5(concat({_KEY}, '|technique')) AS id, {_KEY} AS alert_id, f.ts_us, t.technique_id, t.technique_name,"
    " t.tactic, CAST(r.confidence AS DOUBLE) AS confidence"
    " FROM findings f JOIN tech t USING (mitre_key) JOIN rules r USING (rule)", _ALL, _TECH, _RULE
)
_LINKED = f"SELECT {_KEY} AS id," + """ concat('{"pid":', f.pid, ',"rule":"', f.rule, '"}') AS raw_data, f.description, t.technique_id,
  t.technique_name, t.tactic, CAST(r.confidence AS DOUBLE) AS confidence
FROM findings f JOIN tech t USING (mitre_key) JOIN rules r USING (rule)"""
_SESSIONS = """SELECT f.src_ip, f.threat_type, min(f.ts_us) AS first_seen, max(f.ts_us) AS last_seen,
  CAST(max(r.confidence) AS DOUBLE) AS confidence, count(*) AS packet_count, 0 AS blocked
FROM findings f JOIN rules r USING (rule) GROUP BY f.src_ip, f.threat_type"""
ORACLES["a14_threat_sessions"] = findings(_SESSIONS, _ALL, _RULE)
ORACLES["p11_alert_id"] = findings(f"SELECT f.pid, f.rule, {_KEY} AS alert_id FROM findings f", _ROW)
ORACLES["f10_describe"] = findings("SELECT pid, rule, description FROM findings", _ROW)
_MARKED = (
    "SELECT pid, CASE WHEN is_malicious = 1 OR pid IN (SELECT pid FROM findings) THEN 1 ELSE 0 END AS is_malicious"
    " FROM packets"
)

# Sinks, filters -------------------------------------------------------------------------------



def _placed(how: str) -> str:
    return """SELECT p.*, r.country, r.city, r.latitude, r.longitude,
  CASE WHEN r.country IN ('KP', 'IR', 'RU') THEN 1 ELSE 0 END AS is_threat
FROM (SELECT *, """ + _number("src_ip") + """ AS n FROM packets) p """ + how + """ JOIN geo_ranges r
  ON p.n BETWEEN r.lo AND r.hi"""


ORACLES["j5_geo_enrich"] = _query(
    ["packets", "geo_ranges"],
    f"SELECT pid, src_ip, country, city, latitude, longitude, is_threat FROM ({_placed('LEFT')})",
)
ORACLES["s7_sink_geo"] = _query(
    ["packets", "geo_ranges"],
    f"""SELECT pid AS id, ts_us, src_ip, country, CAST(NULL AS VARCHAR) AS city, latitude, longitude, is_threat,
  1 AS pkt_count FROM ({_placed('INNER')})""",
)
_ACKED = "SELECT DISTINCT event_id - event_id%9 AS alert_id FROM events"
_ACKS = f"CASE WHEN acknowledged = 1 OR id IN ({_ACKED}) THEN 1 ELSE 0 END AS acknowledged"
ORACLES["s8_ack_alerts"] = _query(["alerts"], f"SELECT id, {_ACKS} FROM alerts")
ORACLES["j7_ack_overlay"] = _query(["alerts"], f"SELECT id, severity, {_ACKS} FROM alerts")
_TALKERS = """SELECT src_ip, count(*) AS pkt_count, CAST(sum(length) AS BIGINT) AS bytes,
  CAST(sum(is_malicious) AS BIGINT) AS threat_count FROM packets GROUP BY src_ip ORDER BY pkt_count DESC, src_ip LIMIT 10"""
ORACLES["s9_json_rows"] = packets(
    f"""SELECT concat('{{"src_ip":"', src_ip, '","pkt_count":', pkt_count, ',"bytes":', bytes, ',"threat_count":',
  threat_count, '}}') AS json FROM ({_TALKERS})"""
)
ORACLES["p1_since"] = packets(
    "SELECT pid, ts_us FROM packets WHERE ts_us > (SELECT max(ts_us) FROM packets) - 86400000000"
)
ORACLES["p2_eq_filters"] = _query(
    ["alerts"], "SELECT id, ts_us FROM alerts WHERE severity = 'CRITICAL' AND acknowledged = 0"
)
ORACLES["p3_search_events"] = packets(
    """SELECT pid, ts_us, src_ip, dst_ip, flags FROM packets WHERE protocol = 'TCP' AND src_ip LIKE '%10.0.1%'
  AND dst_ip LIKE '%192.168%' AND (flags ILIKE '%psh%' OR src_ip ILIKE '%psh%' OR dst_ip ILIKE '%psh%'
  OR protocol ILIKE '%psh%') ORDER BY ts_us DESC, pid DESC LIMIT 100"""
)
ORACLES["p4_like_contains"] = packets(
    "SELECT pid, src_ip, flags FROM packets WHERE lower(flags) LIKE '%psh%' OR regexp_matches(src_ip, '85[.]2.0[.]3')"
    " OR dst_ip LIKE '%8.8.4.25%'"
)
_RECENT = "pid, ts_us, src_ip, dst_ip, protocol, length, is_malicious, flags"
ORACLES["p5_project_recent"] = packets(f"SELECT {_RECENT} FROM packets")
ORACLES["p6_in_list"] = packets("SELECT pid, dst_port FROM packets WHERE dst_port IN (445, 3389, 5985)")
_PATCHY = """SELECT id, CASE WHEN id%7 <> 0 THEN ts_us END AS ts_us, CASE WHEN id%11 = 0 THEN NULL WHEN id%13 = 0 THEN 'SEVERE'
  ELSE severity END AS severity, CASE WHEN id%5 <> 0 THEN acknowledged END AS acknowledged, alert_type FROM alerts"""
ORACLES["p7_not_null"] = _query(
    ["alerts"],
    f"""SELECT id, CASE WHEN ts_us IS NOT NULL AND severity IS NOT NULL AND alert_type IS NOT NULL THEN 1 ELSE 0 END
  AS valid FROM ({_PATCHY})""",
)
ORACLES["p8_valid_severity"] = _query(
    ["alerts"], f"SELECT id, CASE WHEN severity IN {_SEV} THEN 1 ELSE 0 END AS valid FROM ({_PATCHY})"
)
ORACLES["p9_column_defaults"] = _query(
    ["alerts"], f"SELECT id, coalesce(acknowledged, 0) AS acknowledged FROM ({_PATCHY})"
)
_STATS = """SELECT ts_us // 60000000 * 60 AS bucket, protocol, count(*) AS pkt_count, CAST(sum(length) AS BIGINT) AS byte_count
FROM packets GROUP BY 1, 2"""
ORACLES["p10_unique_key"] = packets(
    f"SELECT bucket, protocol, CAST(2 AS BIGINT) AS n FROM ({_STATS}) WHERE protocol = 'TCP'"
)

# Joins ----------------------------------------------------------------------------------------

ORACLES["j1_mitre_lookup"] = packets(
    f"""SELECT k.pid, k.mitre_key, {_KNOWN} FROM (SELECT pid, CASE pid%4 WHEN 0 THEN 'ddos' WHEN 1 THEN 'sqli'
  WHEN 2 THEN 'port_scan' ELSE 'unheard_of' END AS mitre_key FROM packets) k LEFT JOIN tech t USING (mitre_key)""",
    _TECH,
)
_PORTS = ("ports(port, name)", "SELECT * FROM (VALUES " + _values(dims.PORT_PROTOCOLS.items()) + ")")
_RISKS = ("risks(protocol, risk)", "SELECT * FROM (VALUES " + _values(dims.PROTOCOL_RISKS.items()) + ")")


def _port_name(l4: str) -> str:
    return (
        f"CASE WHEN {l4} IN ('TCP', 'UDP') THEN coalesce((SELECT name FROM ports WHERE port = x.dst_port),"
        f" (SELECT name FROM ports WHERE port = x.src_port), {l4}) ELSE 'UNKNOWN' END"
    )


ORACLES["j2_port_protocol"] = packets(
    f"""SELECT pid, l4, {_port_name('l4')} AS port_protocol FROM (SELECT *, CASE WHEN protocol IN ('UDP', 'DNS', 'NTP')
  THEN 'UDP' WHEN protocol NOT IN ('ICMP', 'ARP') THEN 'TCP' END AS l4 FROM packets) x""",
    _PORTS,
)
ORACLES["j2b_classify"] = packets(
    """SELECT pid, CASE WHEN pid%3 = 1 THEN protocol ELSE coalesce((SELECT name FROM ports WHERE port = x.dst_port), 'TCP')
  END AS classified FROM packets x""",
    _PORTS,
)
ORACLES["j3_protocol_risk"] = packets(
    "SELECT pid, protocol, coalesce(risk, 'INFO') AS risk FROM packets LEFT JOIN risks USING (protocol)", _RISKS
)
ORACLES["j4_alerts_with_techniques"] = _query(
    ["alerts", "mitre_events"],
    """SELECT a.id, a.severity, m.technique_id, m.technique_name, m.tactic, m.confidence
FROM alerts a JOIN mitre_events m ON m.alert_id = a.id""",
)
ORACLES["j4_orphan_hits"] = _query(
    ["alerts", "mitre_events"],
    """SELECT id, alert_id, technique_id FROM mitre_events WHERE alert_id IS NOT NULL
  AND alert_id NOT IN (SELECT id FROM alerts)""",
)


def _metric(protocol: str, metric: str) -> str:
    value = {
        "syn_rate": "count(*) FILTER (flags = 'SYN')",
        "flood_pps": "count(*) / 60.0",
        "conn_rate": "count(DISTINCT concat(dst_ip, '/', coalesce(CAST(dst_port AS VARCHAR), '-')))",
        "scan_rate": "count(DISTINCT dst_ip)",
        "large_pkt": "max(length)",
        "attach_size": "max(length)",
        "amp_pkt": "max(length)",
        "gratuitous": "count(*) FILTER (src_ip = dst_ip)",
        "data_conn": "count(DISTINCT concat(dst_ip, '/', coalesce(CAST(dst_port AS VARCHAR), '-'))) FILTER (src_port = 20 OR dst_port = 20)",
    }.get(metric, "count(*)")
    if metric == "amp_factor":
        return """SELECT ip AS src_ip, 'UDP' AS protocol, minute, 'amp_factor' AS metric, sum(got) / sum(sent) AS value
FROM (SELECT src_ip AS ip, ts_us // 60000000 * 60 AS minute, length AS sent, 0 AS got FROM packets WHERE protocol = 'UDP'
  UNION ALL SELECT dst_ip, ts_us // 60000000 * 60, 0, length FROM packets WHERE protocol = 'UDP')
GROUP BY 1, 3 HAVING sum(sent) > 0 AND sum(got) > 0"""
    return (
        f"SELECT src_ip, protocol, ts_us // 60000000 * 60 AS minute, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value"
        f" FROM packets WHERE protocol = '{protocol}' GROUP BY 1, 2, 3"
    )


ORACLES["j6_threshold_rules"] = packets(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT *, CAST({threshold} AS DOUBLE) AS threshold FROM ({_metric(protocol, metric)})"
        for protocol, metric, threshold in dims.THRESHOLDS
    )
    + ") WHERE value > threshold"
)

# Aggregates -----------------------------------------------------------------------------------

ORACLES["a1_overview_stats"] = findings(
    f"""SELECT (SELECT count(*) FROM packets) AS total_packets,
  (SELECT count(*) FROM packets WHERE ts_us > t - 3600000000) AS packets_last_hour,
  (SELECT CAST(round_even(avg(packets_pm), 0) AS BIGINT) FROM performance_metrics WHERE ts_us > t - 600000000) AS packets_per_min,
  (SELECT count(*) FROM ({_SESSIONS})) AS active_threats,
  (SELECT count(*) FROM alerts WHERE ts_us > t - 86400000000) AS alerts_24h,
  (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL' AND acknowledged = 0) AS critical_unacked,
  (SELECT count(*) FROM alerts WHERE acknowledged = 0) AS unacked_alerts,
  (SELECT count(*) FROM packets WHERE is_malicious = 1 AND ts_us > t - 3600000000) AS malicious_pkt_hour,
  (SELECT round_even(coalesce(nullif(avg(confidence), 0), 0.992) * 100, 2) FROM mitre_events WHERE ts_us > t - 3600000000) AS accuracy_pct
FROM (SELECT max(ts_us) AS t FROM performance_metrics)""",
    _ROW,
    _RULE,
    views=("alerts", "mitre_events", "performance_metrics"),
)
ORACLES["a2_packets_per_minute"] = packets(
    """SELECT ts_us // 60000000 * 60 AS bucket, count(*) AS cnt FROM packets
WHERE ts_us > (SELECT max(ts_us) FROM packets) - 86400000000 GROUP BY 1"""
)
ORACLES["a3_protocol_distribution"] = packets(
    "SELECT protocol, count(*) AS cnt FROM packets GROUP BY 1 ORDER BY cnt DESC, protocol LIMIT 16"
)
ORACLES["a3_protocols_of_rollup"] = ORACLES["a3_protocol_distribution"]
ORACLES["a4_top_talkers"] = ORACLES["a4_talkers_of_rollup"] = packets(_TALKERS)
ORACLES["a5_geo_traffic"] = _query(
    ["geo_traffic"],
    """SELECT country, CAST(sum(pkt_count) AS BIGINT) AS total, CAST(sum(is_threat) AS BIGINT) AS threats,
  avg(latitude) AS lat, avg(longitude) AS lon FROM geo_traffic GROUP BY country""",
)
_DAY = "WHERE ts_us > (SELECT max(ts_us) FROM alerts) - 86400000000"
ORACLES["a6_threat_timeline"] = _query(
    ["alerts"], f"SELECT ts_us // 3600000000 * 3600 AS bucket, severity, count(*) AS cnt FROM alerts {_DAY} GROUP BY 1, 2"
)
ORACLES["a7_severity_breakdown"] = _query(["alerts"], "SELECT severity, count(*) AS cnt FROM alerts GROUP BY 1")
ORACLES["a8_alerts_by_type"] = _query(
    ["alerts"], "SELECT alert_type, count(*) AS cnt FROM alerts GROUP BY 1 ORDER BY cnt DESC, alert_type LIMIT 12"
)
ORACLES["a9_alerts_hourly"] = _query(
    ["alerts"], f"SELECT ts_us // 3600000000 * 3600 AS bucket, count(*) AS cnt FROM alerts {_DAY} GROUP BY 1"
)
ORACLES["a10_mitre_techniques"] = _query(
    ["mitre_events"],
    """SELECT technique_id, min(technique_name) AS technique_name, min(tactic) AS tactic, count(*) AS cnt,
  round(avg(confidence), 6) AS avg_conf FROM mitre_events GROUP BY 1""",
)
ORACLES["a11_mitre_heatmap"] = _query(
    ["mitre_events"],
    """SELECT technique_id, min(technique_name) AS technique_name, min(tactic) AS tactic, count(*) AS cnt
FROM mitre_events GROUP BY 1""",
)
ORACLES["a12_perf_minutely"] = _query(
    ["packets", "alerts"],
    """SELECT bucket, count(*) FILTER (kind = 0) AS packets_pm, count(*) FILTER (kind = 1) AS alerts_pm
FROM (SELECT ts_us // 60000000 * 60 AS bucket, 0 AS kind FROM packets
      UNION ALL SELECT ts_us // 60000000 * 60, 1 FROM alerts) GROUP BY 1""",
)
ORACLES["a13_protocol_stats"] = packets(_STATS)
ORACLES["a15_connections"] = _query(
    ["packets", "two_way_packets"],
    """SELECT min(ts_us) AS start_us, max(ts_us) AS end_us, arg_min(src_ip, rn) AS src_ip, arg_min(dst_ip, rn) AS dst_ip,
  first(src_port ORDER BY rn) AS src_port, first(dst_port ORDER BY rn) AS dst_port, protocol,
  CASE WHEN bool_or(flags LIKE '%FIN%' OR flags LIKE '%RST%') THEN 'CLOSED' ELSE 'ACTIVE' END AS state,
  CAST(sum(CASE WHEN me = opener THEN length ELSE 0 END) AS BIGINT) AS bytes_sent,
  CAST(sum(CASE WHEN me = opener THEN 0 ELSE length END) AS BIGINT) AS bytes_recv, count(*) AS pkt_count
FROM (SELECT *, first_value(me) OVER (PARTITION BY pair, protocol, sid ORDER BY rn) AS opener
  FROM (SELECT *, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY pair, protocol ORDER BY rn) AS sid
    FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY pair, protocol ORDER BY ts_us, pid) AS gap,
            row_number() OVER (PARTITION BY pair, protocol ORDER BY ts_us, pid) AS rn
      FROM (SELECT *, list_sort([me, you]) AS pair
        FROM (SELECT *, concat(src_ip, ':', coalesce(src_port, -1)) AS me, concat(dst_ip, ':', coalesce(dst_port, -1)) AS you
              FROM two_way_packets)))))
GROUP BY pair, protocol, sid""",
)

ORACLES["a15_connections_over_runs"] = ORACLES["a15_connections"]

# Windows --------------------------------------------------------------------------------------

ORACLES["w1_recent_count"] = packets(
    "SELECT pid, r5 AS recent_5, r10 AS recent_10, r60 AS recent_60 FROM rates", _RATES
)
_ROUNDED = "SELECT pid, n_events, round(avg_gap + 1e-7, 3) AS avg_gap, round(var_gap + 1e-7, 3) AS var_gap FROM gaps"
ORACLES["w2_interarrival_stats"] = packets(f"{_ROUNDED} WHERE n_events > 1", _GAPS)
ORACLES["w2_sparse_interarrival_stats"] = packets(f"{_ROUNDED} WHERE n_events BETWEEN 2 AND 181", _GAPS)
ORACLES["w3_running_count"] = packets("SELECT pid, src_ip, sid, nth FROM nth WHERE protocol = 'TCP'", _SIDS, _NTH)
ORACLES["w4_running_sum_reset"] = packets(
    "SELECT pid, src_ip, sid, acc AS bytes FROM sums WHERE acc > 1000000", _SIDS, *_sum_fold(1_000_000)
)
ORACLES["w5_distinct_set_reset"] = packets(
    "SELECT pid, CAST(len(ports) AS BIGINT) AS ports FROM sets WHERE len(ports) > 20", *_set_fold(20)
)
ORACLES["w6_ip_sessions"] = packets(
    """SELECT src_ip, sid, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS pkt_count
FROM sids GROUP BY src_ip, sid""",
    _SIDS,
)
ORACLES["w6_session_ids"] = packets("SELECT pid, sid FROM sids", _SIDS)

# Sorts ----------------------------------------------------------------------------------------

ORACLES["t1_recent_alerts"] = _query(
    ["alerts"],
    """SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM alerts WHERE severity = 'HIGH'
ORDER BY ts_us DESC, CAST(id AS VARCHAR) DESC LIMIT 50""",
)
ORACLES["t2_recent_events"] = packets(f"SELECT {_RECENT} FROM packets ORDER BY ts_us DESC, pid DESC LIMIT 100")
ORACLES["t3_perf_history"] = _query(
    ["performance_metrics"], "SELECT * FROM performance_metrics ORDER BY ts_us DESC, id DESC LIMIT 60"
)
ORACLES["t4_top_k"] = packets(
    """SELECT dst_ip, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY dst_ip ORDER BY bytes DESC, dst_ip LIMIT 12"""
)
ORACLES["t5_bucket_order"] = packets(
    "SELECT ts_us // 3600000000 * 3600 AS bucket, count(*) AS cnt FROM packets GROUP BY 1 ORDER BY 1"
)

# Scalar functions -----------------------------------------------------------------------------

ORACLES["f1_time_bucket"] = packets(
    "SELECT pid, ts_us // 60000000 * 60 AS minute, ts_us // 3600000000 * 3600 AS hour FROM packets"
)
ORACLES["f2_round"] = packets(
    """SELECT pid, round_even(pid / 8, 2) AS two, CAST(round_even(pid / 2, 0) AS BIGINT) AS whole,
  round(pid / 8, 2) AS half_up FROM packets"""
)
ORACLES["f3_is_private"] = packets(
    f"""SELECT event_id, ip, CASE WHEN {_private('ip')} THEN 1 ELSE 0 END AS private
FROM (SELECT event_id, CASE WHEN event_id%50 = 3 THEN a || '.1' WHEN event_id%50 = 4 THEN '0' || a ELSE a END AS ip
      FROM (SELECT event_id, concat_ws('.', event_id*7%256, (event_id*37+16)%256, event_id*11%256, event_id*3%256) AS a FROM events)
      UNION ALL SELECT pid, dst_ip FROM packets)"""
)
ORACLES["f4_parse_flags"] = packets(
    """SELECT pid, coalesce(nullif(array_to_string(list_filter([CASE WHEN b & 2 <> 0 THEN 'SYN' END,
  CASE WHEN b & 16 <> 0 THEN 'ACK' END, CASE WHEN b & 4 <> 0 THEN 'RST' END, CASE WHEN b & 1 <> 0 THEN 'FIN' END,
  CASE WHEN b & 8 <> 0 THEN 'PSH' END, CASE WHEN b & 32 <> 0 THEN 'URG' END], lambda x: x IS NOT NULL), '|'), ''), 'NONE')
  AS flag_names FROM (SELECT pid, pid%256 AS b FROM packets)"""
)
ORACLES["f5_is_encrypted"] = packets(
    "SELECT pid, CASE WHEN protocol IN ('HTTPS','TLS','SSH','QUIC','IMAP+TLS','POP3+TLS') THEN 1 ELSE 0 END AS encrypted FROM packets"
)
ORACLES["f6_payload_entropy"] = """
WITH bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
counts AS (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY 1, 2),
shares AS (SELECT doc_id, c / sum(c) OVER (PARTITION BY doc_id) AS p FROM counts),
entropies AS (SELECT doc_id, round(-sum(p * log2(p)), 3) + 0.0 AS entropy FROM shares GROUP BY 1)
SELECT doc_id, coalesce(entropy, 0.0) AS entropy FROM documents LEFT JOIN entropies USING (doc_id)"""
_ANOMALY = """ip_version = 6 AND (coalesce(flow_label, 0) <> 0 OR coalesce(next_header, 0) IN (0, 43, 44, 60))"""
_HEX = "hex(payload)"
ORACLES["f7_payload_protocol"] = _query(
    ["payload_packets"],
    f"""SELECT pid, CASE WHEN {_ANOMALY} THEN 'IPv6_ANOMALY'
  WHEN {_HEX} LIKE '47455420%' OR {_HEX} LIKE '504F535420%' OR {_HEX} LIKE '485454502F%' THEN 'HTTP'
  WHEN {_HEX} LIKE '1603%' THEN 'TLS' WHEN regexp_matches({_HEX}, '^(..)*5353482D') THEN 'SSH'
  ELSE {_port_name('l4')} END AS detected FROM payload_packets x""",
    [_PORTS],
)
ORACLES["f8_ipv6_anomaly"] = _query(
    ["payload_packets"], f"SELECT pid, CASE WHEN {_ANOMALY} THEN 1 ELSE 0 END AS anomaly FROM payload_packets"
)
ORACLES["f9_alert_title"] = packets(
    f"SELECT pid, {_TITLE.format('k')} AS title FROM (SELECT pid, lower(protocol) || '_attack_seen' AS k FROM packets)"
)
ORACLES["f11_int_div"] = packets("SELECT pid, CAST(length // 1024 AS BIGINT) AS kilobytes FROM packets")
ORACLES["f13_truthy_default"] = packets(
    """SELECT pid, CASE WHEN dst_port IS NULL OR dst_port = 0 THEN 9 ELSE dst_port END AS port,
  CASE WHEN dst_port <> 0 THEN 1 ELSE 0 END AS has_port FROM packets"""
)
ORACLES["f14_http_method"] = _query(
    ["payload_packets"],
    f"""SELECT pid, CASE WHEN {_HEX} LIKE '47455420%' THEN 'GET' WHEN {_HEX} LIKE '504F535420%' THEN 'POST' ELSE '' END
  AS method FROM payload_packets""",
)

# Payload rules --------------------------------------------------------------------------------


_PAYLOAD_RULES: dict[str, str] = {}


def _payload_rule(rule: str, severity: str, text: str, source: str, threat: str) -> str:
    _PAYLOAD_RULES[rule] = _finding(rule, severity, text, source, threat)
    return _query(["payload_packets"], _PAYLOAD_RULES[rule])


_DECODED = "CASE WHEN protocol = 'HTTP' THEN decode(payload) END"
_ATTACK = "(?i)" + "|".join(f"(?:{p})" for p in SQLI_PATTERNS).replace("'", "''")
ORACLES["d17_sqli"] = _payload_rule(
    "sqli", "'HIGH'", "concat('SQL injection attempt from ', src_ip, ' detected in HTTP payload')",
    f"payload_packets WHERE protocol = 'HTTP' AND regexp_matches({_DECODED}, '{_ATTACK}')", "sqli",
)
_LONGEST = "list_max(list_transform(string_split(qname, '.'), lambda l: length(l)))"
ORACLES["d18_dns_tunnel"] = _payload_rule(
    "dns_tunnel", "'HIGH'", f"concat('DNS tunneling suspected from ', src_ip, ': label length ', {_LONGEST}, ' chars')",
    f"payload_packets WHERE protocol = 'DNS' AND {_LONGEST} > 50", "dns_tunnel",
)
ORACLES["d19_ftp_auth_fail"] = _payload_rule(
    "ftp_auth_fail", "'MEDIUM'", "concat('FTP authentication failure from ', src_ip)",
    f"""(SELECT arg_max(pid, ts_us) AS pid, max(ts_us) AS ts_us, src_ip, dst_ip, 'FTP' AS protocol FROM payload_packets
  WHERE protocol = 'FTP' AND {_HEX} LIKE '353330%' GROUP BY src_ip, dst_ip, ts_us // 60000000 HAVING count(*) >= 5)""",
    "brute_force",
)
ORACLES["d20_arp_spoof"] = _payload_rule(
    "arp_spoof", "'MEDIUM'", "concat('ARP spoofing attempt detected from ', src_ip)",
    """(SELECT arg_max(pid, ts_us) AS pid, max(ts_us) AS ts_us, src_ip, arg_max(dst_ip, ts_us) AS dst_ip, 'ARP' AS protocol
  FROM payload_packets WHERE protocol = 'ARP' GROUP BY src_ip, ts_us // 60000000 HAVING count(DISTINCT src_mac) > 1)""",
    "lateral_movement",
)
ORACLES["d21_tls_old_version"] = _payload_rule(
    "tls_old_version", "'HIGH'", "concat('TLS anomaly from ', src_ip, ': outdated protocol version')",
    f"""payload_packets WHERE protocol = 'TLS' AND substr({_HEX}, 1, 4) = '1603' AND substr({_HEX}, 11, 2) = '02'
  AND substr({_HEX}, 19, 4) < '0303'""",
    "malware_callback",
)



def live(body: str, *more: tuple[str, str]) -> str:
    """SQL over the findings of all rules, those on payloads included, on packets with and without payloads."""
    names = {"events": "events", "pages": "pages", "packets": "plain", "payload_packets": "loaded"}
    texts = {"plain": "packets", "loaded": "payload_packets", "packets": "live_packets"}
    parts = [(name, view_text(text, DUCK_WORDS, names)) for name, text in texts.items()]
    needed: dict[str, str] = {}
    for ctes, _ in _RULES.values():
        needed |= dict(ctes)
    selects = [select for _, select in _RULES.values()] + [text.replace("payload_packets", "packets") for text in _PAYLOAD_RULES.values()]
    return _query([], body, [*parts, *needed.items(), ("findings", " UNION ALL ".join(selects)), *more])


ORACLES["s5_sink_alerts"] = live(_ALERT_ROWS, _TECH)
ORACLES["s6_sink_mitre"] = live(_LINKED, _TECH, _RULE)
ORACLES["j8_mark_malicious"] = live(_MARKED)
ORACLES["d24_findings_of_all_rules"] = live(f"SELECT f.*, {_KNOWN} FROM findings f LEFT JOIN tech t USING (mitre_key)", _TECH)
ORACLES["d22_stored_payload_findings"] = _query(["payload_packets"], " UNION ALL ".join(_PAYLOAD_RULES.values()))
ORACLES["r1_stream_payload_rules"] = _query(
    ["payload_packets"], " UNION ALL ".join(_PAYLOAD_RULES[rule] for rule in ("sqli", "dns_tunnel", "tls_old_version"))
)

# Streams: as in batch ------------------------------------------------------------------------

ORACLES["s3_packet_stream"] = ORACLES["s1_scan_packets"]
_L4 = "CASE WHEN protocol IN ('UDP', 'DNS', 'NTP') THEN 'UDP' WHEN protocol IN ('ICMP', 'ARP') THEN protocol ELSE 'TCP' END"
ORACLES["s3_capture_files"] = ORACLES["s3_capture_stream"] = packets(
    """SELECT ts_us, src_ip, dst_ip, CASE WHEN l4 IN ('TCP', 'UDP') THEN src_port END AS src_port,
  CASE WHEN l4 IN ('TCP', 'UDP') THEN coalesce(dst_port, 0) END AS dst_port, l4,
  greatest(length, CASE l4 WHEN 'TCP' THEN 54 ELSE 42 END) AS length,
  CASE WHEN l4 <> 'TCP' OR flags = '' THEN 'NONE' WHEN flags = 'PSH|ACK' THEN 'ACK|PSH' ELSE flags END AS flags
FROM (SELECT *, """ + _L4 + """ AS l4 FROM packets)"""
)
ORACLES["r1_stream_row_rules"] = findings("SELECT * FROM findings", _ROW)
ORACLES["r2_stream_rates"] = findings("SELECT * FROM findings", ["syn_flood", "udp_flood", "http_flood", "icmp_flood"])
ORACLES["r3_stream_counters"] = findings("SELECT * FROM findings", ["dns_recon", "ssh_brute_force", "exfil"])
ORACLES["r4_stream_port_scan"] = ORACLES["d1_port_scan"]
ORACLES["r5_stream_beacon"] = ORACLES["d6_c2_beacon"]
ORACLES["r_stream_alerts"] = ORACLES["r_stream_runs"] = ORACLES["s6_sink_mitre"]
ORACLES["s7_stream_geo"] = ORACLES["s7_sink_geo"]
ORACLES["r7_rollup_upsert"] = ORACLES["a13_protocol_stats"]
ORACLES["j4_stream_orphan_hits"] = _query(
    ["alerts", "mitre_events"],
    """SELECT CAST(id AS VARCHAR) AS id, CAST(alert_id AS VARCHAR) AS alert_id, technique_id FROM mitre_events m
WHERE alert_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.id = m.alert_id AND abs(a.ts_us - m.ts_us) <= 86400000000)""",
)
ORACLES["r2_stream_rate_windows"] = packets(
    """SELECT bucket, src_ip, count(*) AS packets, count(*) FILTER (protocol = 'TCP' AND flags = 'SYN') AS triggers
FROM (SELECT *, unnest(range(ts_us // 1000000 - 9, ts_us // 1000000 + 1)) AS bucket FROM packets)
GROUP BY 1, 2 HAVING count(*) > 200 AND count(*) FILTER (protocol = 'TCP' AND flags = 'SYN') > 0"""
)
ORACLES["r6_state_expiry"] = packets(
    """SELECT src_ip, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS pkt_count FROM sids
GROUP BY src_ip, sid""",
    _SIDS,
)
ORACLES["r7_stream_protocol_stats"] = ORACLES["a13_protocol_stats"]
ORACLES["r7_stream_perf"] = ORACLES["a12_perf_minutely"]
ORACLES["r8_stream_connections"] = ORACLES["a15_connections"]
# Every tenth packet is late; it counts where the watermark, two days back, has not passed its minute.
_WATERMARK = "(SELECT max(ts_us) // 1000 * 1000 - 172800000000 FROM packets WHERE pid%10 < 5 AND pid%10 <> 3)"
ORACLES["r9_late_data"] = packets(
    _STATS.replace("FROM packets", f"FROM (SELECT * FROM packets WHERE pid%10 <> 3 OR ts_us // 60000000 * 60000000 + 60000000 > {_WATERMARK})")
)
