"""Detection rules: packets in, findings out.

A finding is one row ``pid, ts_us, src_ip, dst_ip, protocol, rule, threat_type, severity,
description, mitre_key``. Bounds are strict unless a name says otherwise.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.functions import payload as P
from flowsentry.functions.addresses import is_private
from flowsentry.functions.scalar import int_div, is_truthy_port
from flowsentry.operators import carry, gaps, ordered, rates, sessions
from flowsentry.operators.pruning import settle

FINDING_COLUMNS = [
    "pid",
    "ts_us",
    "src_ip",
    "dst_ip",
    "protocol",
    "rule",
    "threat_type",
    "severity",
    "description",
    "mitre_key",
]
_PACKET_COLUMNS = FINDING_COLUMNS[:5]

# Ports of lateral movement, attempt numbers that raise an alert, bytes of a source.
LATERAL_PORTS = [445, 3389, 5985]
SSH_ATTEMPTS = [5, 20, 50, 100]
SSH_CRITICAL_ATTEMPTS = 50
EXFIL_LIMIT = 10_000_000
SCAN_PORTS = 50


class RateRule(NamedTuple):
    """A sliding count over a threshold at a packet of the given kind."""

    rule: str
    protocol: str
    seconds: int
    threshold: int
    severity: str
    text: str
    flags: str | None = None

    def trigger(self) -> Column:
        condition = F.col("protocol") == self.protocol
        return condition if self.flags is None else condition & (F.col("flags") == self.flags)

    def exceeded(self) -> Column:
        return F.col(f"recent_{self.seconds}") > self.threshold


# Windows, thresholds and severities of the flood rules.
SYN_FLOOD = RateRule("syn_flood", "TCP", 10, 200, "CRITICAL", "SYN flood from %s: %d SYN pkts/10s", "SYN")
UDP_FLOOD = RateRule("udp_flood", "UDP", 5, 500, "CRITICAL", "UDP flood from %s: %d pkts/5s")
HTTP_FLOOD = RateRule("http_flood", "HTTP", 60, 300, "HIGH", "HTTP flood from %s: %d req/min")
ICMP_FLOOD = RateRule("icmp_flood", "ICMP", 10, 100, "HIGH", "ICMP flood from %s: %d pkts/10s")
RATE_RULES = [SYN_FLOOD, UDP_FLOOD, HTTP_FLOOD, ICMP_FLOOD]


def _text(rule: str) -> str:
    return dims.ROW_TEXTS[rule]


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def as_findings(rows: DataFrame, candidates: list[tuple[Column, str, Column, Column]]) -> DataFrame:
    """One finding per row and candidate ``(condition, rule, severity, description)`` that holds."""
    found = [
        F.when(condition, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), text.alias("description")))
        for condition, rule, severity, text in candidates
    ]
    rules = [(F.lit(rule), F.lit(key)) for rule, key, _ in dims.RULES]
    key_of = F.create_map(*[part for pair in rules for part in pair])
    named = rows.select(*_PACKET_COLUMNS, F.inline(F.array_compact(F.array(*found))))
    return named.withColumns({"threat_type": key_of[F.col("rule")], "mitre_key": key_of[F.col("rule")]}).select(
        *FINDING_COLUMNS
    )


def union_findings(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


# Rules on a single packet ---------------------------------------------------------------------


def _lateral_movement() -> tuple[Column, str, Column, Column]:
    internal = is_private("src_ip") & is_private("dst_ip")
    condition = (F.col("protocol") == "TCP") & F.col("dst_port").isin(LATERAL_PORTS) & internal
    text = F.format_string(_text("lateral_movement"), "src_ip", "dst_ip", "dst_port")
    return condition, "lateral_movement", F.lit("HIGH"), text


def _icmp_large(limit: int = 1000) -> tuple[Column, str, Column, Column]:
    condition = (F.col("protocol") == "ICMP") & (F.col("length") > limit)
    text = F.format_string(_text("icmp_large"), "src_ip", "length")
    return condition, "icmp_large", F.lit("MEDIUM"), text


def _smtp_large(limit: int = 500_000) -> tuple[Column, str, Column, Column]:
    condition = (F.col("protocol") == "SMTP") & (F.col("length") > limit)
    text = F.format_string(_text("smtp_large"), F.col("src_ip"), int_div("length", 1024))
    return condition, "smtp_large", F.lit("HIGH"), text


def _ntp_amplification(limit: int = 468) -> tuple[Column, str, Column, Column]:
    condition = (F.col("protocol") == "NTP") & (F.col("length") > limit)
    text = F.format_string(_text("ntp_amplification"), "src_ip", "length")
    return condition, "ntp_amplification", F.lit("HIGH"), text


def _row_findings(packets: DataFrame, *candidates) -> DataFrame:
    # The filter repeats the conditions so that they reach the scan.
    return as_findings(packets.where(_either([condition for condition, *_ in candidates])), list(candidates))


def lateral_movement(packets: DataFrame) -> DataFrame:
    return _row_findings(packets, _lateral_movement())


def icmp_large(packets: DataFrame, limit: int = 1000) -> DataFrame:
    return _row_findings(packets, _icmp_large(limit))


def smtp_large(packets: DataFrame, limit: int = 500_000) -> DataFrame:
    return _row_findings(packets, _smtp_large(limit))


def ntp_amplification(packets: DataFrame, limit: int = 468) -> DataFrame:
    return _row_findings(packets, _ntp_amplification(limit))


def row_rules(packets: DataFrame) -> DataFrame:
    """All rules on a single packet, in one pass. Works on streams as well."""
    return _row_findings(packets, *_row_candidates())


def _row_candidates() -> list[tuple[Column, str, Column, Column]]:
    return [_lateral_movement(), _icmp_large(), _smtp_large(), _ntp_amplification()]


# Rules on sliding counts ----------------------------------------------------------------------


def rate_findings(packets: DataFrame, rules: list[RateRule]) -> DataFrame:
    """Findings of rules on sliding counts, all from one count per source and time."""
    minutes = rates.busy_minutes(packets, [(rule.trigger(), rule.threshold) for rule in rules])
    return _rate_findings(rates.within_minutes(packets, minutes), rules)


def _rate_findings(busy: DataFrame, rules: list[RateRule], earlier: DataFrame | None = None) -> DataFrame:
    """The same, of the packets of busy minutes; ``earlier`` ones count but raise nothing."""
    windows = sorted({rule.seconds for rule in rules})
    times = busy.select("src_ip", "ts_us")
    counts = rates.sliding_counts(times if earlier is None else times.unionByName(earlier), windows)
    counts = counts.where(_either([rule.exceeded() for rule in rules]))
    suspects = busy.where(_either([rule.trigger() for rule in rules])).join(counts, ["src_ip", "ts_us"])
    candidates = [
        (
            rule.trigger() & rule.exceeded(),
            rule.rule,
            F.lit(rule.severity),
            F.format_string(rule.text, "src_ip", f"recent_{rule.seconds}"),
        )
        for rule in rules
    ]
    return as_findings(suspects, candidates)


def syn_flood(packets: DataFrame, threshold: int = SYN_FLOOD.threshold) -> DataFrame:
    return rate_findings(packets, [SYN_FLOOD._replace(threshold=threshold)])


def udp_flood(packets: DataFrame, threshold: int = UDP_FLOOD.threshold) -> DataFrame:
    return rate_findings(packets, [UDP_FLOOD._replace(threshold=threshold)])


def http_flood(packets: DataFrame, threshold: int = HTTP_FLOOD.threshold) -> DataFrame:
    return rate_findings(packets, [HTTP_FLOOD._replace(threshold=threshold)])


def icmp_flood(packets: DataFrame, threshold: int = ICMP_FLOOD.threshold) -> DataFrame:
    return rate_findings(packets, [ICMP_FLOOD._replace(threshold=threshold)])


# Rules on gaps --------------------------------------------------------------------------------


class Beacon(NamedTuple):
    """Regular gaps: enough events in the hour, mean gap and variance within bounds."""

    min_events: int = 6
    min_gap: float = 20
    max_gap: float = 300
    max_variance: float = 5

    def most_events(self) -> int:
        """Events that an hour can hold with a longer mean gap."""
        return int(gaps.HORIZON_SECONDS // self.min_gap) + 1


BEACON = Beacon()


def c2_beacon(packets: DataFrame, **bounds: float) -> DataFrame:
    """HTTP packets of a source whose events of the last hour come at regular gaps.

    Sources without HTTP or with too few events at all are left out first. With a mean gap above
    ``min_gap`` the hour holds at most ``3600 / min_gap + 1`` events, so longer histories need no
    look.
    """
    rule = Beacon(**bounds)
    counts = packets.groupBy("src_ip").agg(_protocol_count("HTTP").alias("http"), F.count(F.lit(1)).alias("events"))
    sources = settle(counts.where((F.col("http") > 0) & (F.col("events") >= rule.min_events)).select("src_ip"))
    return _beacons(packets.select(*_PACKET_COLUMNS).join(sources, "src_ip", "left_semi"), rule)


def _beacons(rows: DataFrame, rule: Beacon = BEACON) -> DataFrame:
    stats = gaps.sparse_interarrival_stats(rows, rule.most_events())
    mean = F.col("avg_gap")
    regular = (F.round("var_gap", 6) < rule.max_variance) & (mean > rule.min_gap) & (mean < rule.max_gap)
    condition = (F.col("protocol") == "HTTP") & (F.col("n_events") >= rule.min_events) & regular
    text = F.format_string(
        dims.FINDING_TEXTS["c2_beacon"][0],
        F.col("src_ip"),
        F.bround("avg_gap").cast("bigint"),
    )
    return as_findings(stats, [(condition, "c2_beacon", F.lit("CRITICAL"), text)])


# Rules on running counts, sums and sets -------------------------------------------------------


def _protocol_count(protocol: str) -> Column:
    return F.count_if(F.col("protocol") == protocol)


def running_count(packets: DataFrame, protocol: str) -> DataFrame:
    """Packets of a protocol with their number (``measure``) within the session of the source."""
    rows = packets.where(F.col("protocol") == protocol).select(*_PACKET_COLUMNS)
    return rates.numbered(sessions.with_session_ids(rows, sessions.session_hours(packets)), ["src_ip", "sid"])


# Per counter: the protocol it counts, and the packets of a session below which it cannot fire.
_COUNTERS = {"dns": ("DNS", 100), "ssh": ("SSH", SSH_ATTEMPTS[0])}


def _counter_bounds(counters: list[str]) -> dict[str, tuple[Column, int]]:
    return {name: (_protocol_count(protocol), least) for name, (protocol, least) in _COUNTERS.items() if name in counters}


def counter_findings(packets: DataFrame, counters: list[str]) -> DataFrame:
    """Every hundredth DNS packet, and the 5th, 20th, 50th and 100th SSH packet of a session."""
    bounds = _counter_bounds(counters)
    hours = sessions.session_hours(packets, **{name: measure for name, (measure, _) in bounds.items()})
    long_enough = sessions.reaching(hours, {name: least for name, (_, least) in bounds.items()})
    protocols = [_COUNTERS[name][0] for name in counters]
    rows = packets.where(F.col("protocol").isin(protocols)).select(*_PACKET_COLUMNS)
    rows = rows.withColumn("hour", sessions.hour_of()).join(long_enough, ["src_ip", "hour"])
    return _counted(rows, counters)


def _counted(rows: DataFrame, counters: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """The same, of packets with their session and its totals; ``earlier`` rows weigh as much as all before them."""
    counted = [
        (F.col("protocol") == protocol) & (F.col(f"total_{name}") >= least)
        for name, (protocol, least) in _COUNTERS.items()
        if name in counters
    ]
    every = _COUNTERS["dns"][1]
    rows = rows.where(_either(counted)).select(*_PACKET_COLUMNS, "sid")
    if earlier is not None:
        rows = rows.withColumn("weight", F.lit(1).cast("long")).unionByName(earlier, allowMissingColumns=True)
    numbered = rates.numbered(rows, ["src_ip", "sid", "protocol"])
    if earlier is not None:
        numbered = numbered.where(F.col("dst_ip").isNotNull())  # packets have a target, rows from before have none
    number, protocol = F.col("measure"), F.col("protocol")
    severity = F.when(number >= SSH_CRITICAL_ATTEMPTS, F.lit("CRITICAL")).otherwise(F.lit("HIGH"))
    dns_text = F.format_string(dims.FINDING_TEXTS["dns_recon"][0], "src_ip", "measure")
    ssh_text = F.format_string(dims.FINDING_TEXTS["ssh_brute_force"][0], "src_ip", "measure")
    return as_findings(
        numbered,
        [
            ((protocol == "DNS") & (number % every == 0), "dns_recon", F.lit("MEDIUM"), dns_text),
            ((protocol == "SSH") & number.isin(SSH_ATTEMPTS), "ssh_brute_force", severity, ssh_text),
        ],
    )


def dns_recon(packets: DataFrame) -> DataFrame:
    return counter_findings(packets, ["dns"])


def ssh_brute_force(packets: DataFrame) -> DataFrame:
    return counter_findings(packets, ["ssh"])


def _byte_bound(limit: int) -> dict[str, tuple[Column, int]]:
    return {"bytes": (F.sum("length"), limit + 1)}


def running_sum_reset(packets: DataFrame, limit: int = EXFIL_LIMIT) -> DataFrame:
    """Packets that lift the bytes of their source above the limit; the sum restarts there.

    Sessions that stay within the limit as a whole are left out before the fold.
    """
    hours = sessions.sessions_reaching(packets, **_byte_bound(limit))
    return _byte_sums(sessions.with_session_ids(packets.select(*_PACKET_COLUMNS, "length"), hours), limit)


def _byte_sums(rows: DataFrame, limit: int) -> DataFrame:
    return ordered.split_fold(rows, ordered.ResettingSum(limit), ["src_ip", "sid"], ["ts_us", "pid"], "length")


def exfil(packets: DataFrame, limit: int = EXFIL_LIMIT) -> DataFrame:
    return _exfil(running_sum_reset(packets, limit))


def _exfil(hits: DataFrame) -> DataFrame:
    text = F.format_string(dims.FINDING_TEXTS["exfil"][0], F.col("src_ip"), int_div("measure", 1_000_000))
    return as_findings(hits, [(F.lit(True), "exfil", F.lit("HIGH"), text)])


def distinct_set_reset(packets: DataFrame, limit: int = SCAN_PORTS) -> DataFrame:
    """TCP packets that bring the distinct ports of a source and target above the limit.

    The set restarts there. Pairs that never see so many ports are left out before the fold.
    """
    tcp = packets.where(_is_probe())
    pairs = settle(_probed_pairs(tcp, limit))
    return _port_sets(tcp.select(*_PACKET_COLUMNS, "dst_port").join(pairs, ["src_ip", "dst_ip"], "left_semi"), limit)


def _is_probe() -> Column:
    return (F.col("protocol") == "TCP") & is_truthy_port("dst_port")


def _probed_pairs(tcp: DataFrame, limit: int) -> DataFrame:
    return (
        tcp.select("src_ip", "dst_ip", "dst_port")
        .distinct()
        .groupBy("src_ip", "dst_ip")
        .agg(F.count(F.lit(1)).alias("ports"))
        .where(F.col("ports") > limit)
        .select("src_ip", "dst_ip")
    )


def _port_sets(rows: DataFrame, limit: int) -> DataFrame:
    return ordered.split_fold(
        rows, ordered.ResettingSet(limit), ["src_ip", "dst_ip"], ["ts_us", "pid"], "dst_port"
    )


def port_scan(packets: DataFrame, limit: int = SCAN_PORTS) -> DataFrame:
    return _port_scan(distinct_set_reset(packets, limit))


def _port_scan(hits: DataFrame) -> DataFrame:
    text = F.format_string(dims.FINDING_TEXTS["port_scan"][0], "src_ip", "measure")
    return as_findings(hits, [(F.lit(True), "port_scan", F.lit("HIGH"), text)])


def activity(packets: DataFrame) -> DataFrame:
    """One row per source and minute: packets, times, bytes and what the rules count."""
    return packets.groupBy("src_ip", int_div("ts_us", rates.MINUTE_US).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.sum("length").alias("bytes"),
        _protocol_count("HTTP").alias("http"),
        *[_protocol_count(protocol).alias(name) for name, (protocol, _) in _COUNTERS.items()],
        *rates.minute_triggers([rule.trigger() for rule in RATE_RULES]),
    )


class Run(NamedTuple):
    """The findings of a run over packets, and what its state at the end follows from."""

    findings: DataFrame
    packets: DataFrame
    minutes: DataFrame
    hours: DataFrame
    byte_hits: DataFrame
    port_hits: DataFrame
    failures: DataFrame | None
    speakers: DataFrame | None
    border_us: int | None
    entry: carry.Carried | None


def all_findings(packets: DataFrame) -> DataFrame:
    """The findings of all rules on packet columns, from three reads of the packets.

    The first makes the activity table, from which busy minutes, long sessions and possible beacons
    follow; the second finds probed pairs; the third keeps the packets that any rule can need. The rules
    then read those. Rules on payloads, whose reads come on top, take part if the packets carry them.
    """
    return run_findings(packets).findings


def run_findings(
    packets: DataFrame, entry: carry.Carried | None = None, goes_on: bool = False, until_us: int | None = None
) -> Run:
    """All findings of packets that come after those behind ``entry``.

    With ``goes_on`` the rules on whole minutes leave the minute of the border to the next run. The border is the time of
    the last packet, or ``until_us`` if no packet up to there can still come.
    """
    minutes = settle(activity(packets))
    border_us = None
    if entry is not None or goes_on:
        first_us, last_us = minutes.agg(F.min("first_us"), F.max("last_us")).first()
        if entry is not None and first_us is not None and first_us <= entry.border_us:
            raise ValueError("the run holds packets that are not later than those of the run before")
        border_us = max(x for x in (last_us, until_us, entry.border_us if entry else None, -1) if x is not None)
    triggers = [f"triggers_{at}" for at in range(len(RATE_RULES))]
    per_minute = minutes.select("src_ip", "minute", "n", *triggers)
    bounds = {name: least for name, (_, least) in _COUNTERS.items()} | {"bytes": EXFIL_LIMIT + 1}
    hours = minutes.groupBy("src_ip", int_div("minute", 60).alias("hour")).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *[F.sum(name).alias(name) for name in bounds]
    )
    sums = minutes.groupBy("src_ip").agg(F.sum("http").alias("http"), F.sum("n").alias("n"))
    probes = packets.where(_is_probe()).select("src_ip", "dst_ip", "dst_port", "ts_us", "pid")
    if entry is not None:
        both = per_minute.unionByName(entry.minutes(triggers)).groupBy("src_ip", "minute")
        per_minute = both.agg(*[F.sum(name).alias(name) for name in ("n", *triggers)])
        hours = hours.withColumn("carried", F.lit(False)).unionByName(entry.hours(list(bounds)))
        events = entry.events.groupBy("src_ip").agg(F.lit(0).cast("long").alias("http"), F.count(F.lit(1)).alias("n"))
        sums = sums.unionByName(events).groupBy("src_ip").agg(F.sum("http").alias("http"), F.sum("n").alias("n"))
        probes = probes.unionByName(entry.probes())
    busy = settle(rates.busy_of(per_minute, [rule.threshold for rule in RATE_RULES]).withColumn("_busy", F.lit(True)))
    hours = sessions.number_sessions(hours, "src_ip")
    long_enough = settle(sessions.reaching(hours, bounds))
    regular = settle(sums.where((F.col("http") > 0) & (F.col("n") >= BEACON.min_events)).select("src_ip", F.lit(True).alias("_regular")))
    probed = settle(_probed_pairs(probes, SCAN_PORTS).withColumn("_probed", F.lit(True)))

    on_rows = _either([condition for condition, *_ in _row_candidates()])
    totals = [f"total_{name}" for name in bounds]
    counted = _either(
        [(F.col("protocol") == protocol) & (F.col(f"total_{name}") >= least) for name, (protocol, least) in _COUNTERS.items()]
    )
    large, scans = F.col("total_bytes") > EXFIL_LIMIT, F.col("_probed") & _is_probe()
    kept = settle(
        packets.select(*_PACKET_COLUMNS, "dst_port", "length", "flags")
        .withColumns({"minute": int_div("ts_us", rates.MINUTE_US), "hour": sessions.hour_of()})
        .join(busy, ["src_ip", "minute"], "left")
        .join(long_enough, ["src_ip", "hour"], "left")
        .join(regular, "src_ip", "left")
        .join(probed, ["src_ip", "dst_ip"], "left")
        .where(on_rows | F.col("_busy") | F.col("_regular") | scans | counted | large)
        .select(*_PACKET_COLUMNS, "dst_port", "length", "flags", "_busy", "sid", *totals, "_regular", "_probed"),
        broadcast_rows=-1,
    )
    timed, probing = kept.where("_regular").select(*_PACKET_COLUMNS), kept.where(scans).select(*_PACKET_COLUMNS, "dst_port")
    sending = kept.where(large).select(*_PACKET_COLUMNS, "length", "sid")
    earlier = weighed = None
    if entry is not None:
        earlier = rates.within_minutes(entry.recent, busy)
        weighed = entry.counted({name: protocol for name, (protocol, _) in _COUNTERS.items()})
        timed = timed.unionByName(entry.events.join(regular, "src_ip", "left_semi"), allowMissingColumns=True)
        probing = probing.unionByName(entry.probes().join(probed, ["src_ip", "dst_ip"], "left_semi"), allowMissingColumns=True)
        # A session that goes on has number 0.
        long_sums = long_enough.where((F.col("sid") == 0) & large).select("src_ip")
        sending = sending.unionByName(entry.byte_rows().join(long_sums, "src_ip", "left_semi"), allowMissingColumns=True)
    port_hits, byte_hits = _port_sets(probing, SCAN_PORTS), _byte_sums(sending, EXFIL_LIMIT)
    if goes_on:
        port_hits, byte_hits = settle(port_hits, broadcast_rows=-1), settle(byte_hits, broadcast_rows=-1)
    failures = speakers = None
    on_payloads = []
    if set(PAYLOAD_COLUMNS) <= set(packets.columns):
        failures = _failures(packets, entry and entry.failures)
        speakers = _speakers(packets, entry and entry.speakers)
        closed = F.col("minute") < border_us // rates.MINUTE_US if goes_on else F.lit(True)
        on_payloads = [payload_row_rules(packets), ftp_findings(failures.where(closed)), arp_findings(speakers.where(closed))]
    findings = union_findings(
        row_rules(kept),
        _rate_findings(kept.where("_busy"), RATE_RULES, earlier),
        _beacons(timed),
        _counted(kept, list(_COUNTERS), weighed),
        _port_scan(port_hits),
        _exfil(byte_hits),
        *on_payloads,
    )
    return Run(findings, packets, minutes, hours, byte_hits, port_hits, failures, speakers, border_us, entry)


def leaves(run: Run, connections: DataFrame, port_idle_seconds: int | None = None) -> carry.Carried:
    """What a run that goes on leaves to the next one; ``connections`` are the open ones."""
    packets, entry, border_us = run.packets, run.entry, run.border_us
    spark = packets.sparkSession
    probes = packets.where(_is_probe()).select("src_ip", "dst_ip", "dst_port", "ts_us", "pid")
    probes = probes if entry is None else probes.unionByName(entry.probes())
    empty = {name: spark.createDataFrame([], carry.SCHEMAS[name]) for name in ("failures", "speakers")}
    return carry.Carried(
        border_us,
        carry.recent(packets, entry and entry.recent, border_us),
        carry.events(packets, entry and entry.events, border_us, BEACON.most_events() + 1),
        carry.sources(run.hours, run.byte_hits, border_us),
        carry.ports(probes, run.port_hits, border_us, port_idle_seconds),
        empty["failures"] if run.failures is None else carry.open_minutes(run.failures, border_us),
        empty["speakers"] if run.speakers is None else carry.open_minutes(run.speakers, border_us),
        connections,
    )


# Rules on payloads (our semantics) ------------------------------------------------------------

PAYLOAD_COLUMNS = ["payload", "qname", "src_mac"]


def sqli(packets: DataFrame) -> DataFrame:
    """HTTP packets with a pattern of SQL injection in the payload."""
    return _row_findings(packets, _sqli())


def _sqli() -> tuple[Column, str, Column, Column]:
    condition = (F.col("protocol") == "HTTP") & P.has_sql_injection("payload")
    text = F.format_string(_text("sqli"), "src_ip")
    return condition, "sqli", F.lit("HIGH"), text


def dns_tunnel(packets: DataFrame, limit: int = 50) -> DataFrame:
    """DNS packets that ask for a name with a label longer than the limit."""
    return _row_findings(packets, _dns_tunnel(limit))


def _dns_tunnel(limit: int = 50) -> tuple[Column, str, Column, Column]:
    label = P.longest_label("qname")
    condition = (F.col("protocol") == "DNS") & (label > limit)
    text = F.format_string(_text("dns_tunnel"), F.col("src_ip"), label)
    return condition, "dns_tunnel", F.lit("HIGH"), text


def tls_old_version(packets: DataFrame) -> DataFrame:
    """TLS packets whose ServerHello settles on a version below TLS 1.2."""
    return _row_findings(packets, _tls_old_version())


def _tls_old_version() -> tuple[Column, str, Column, Column]:
    condition = (F.col("protocol") == "TLS") & P.is_old_tls_hello("payload")
    text = F.format_string(_text("tls_old_version"), "src_ip")
    return condition, "tls_old_version", F.lit("HIGH"), text


def ftp_auth_fail(packets: DataFrame, least: int = 5) -> DataFrame:
    """Minutes in which a peer sent or got enough FTP login failures; one finding per minute.

    The finding carries the last failure of the minute.
    """
    return ftp_findings(_failures(packets), least)


def ftp_failures(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("protocol") == "FTP") & P.is_ftp_auth_failure("payload"))


def failure_measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("measure"), F.max(F.struct("ts_us", "pid", "protocol")).alias("last")]


def _failures(packets: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Login failures per peers and minute: their number and the last one."""
    minute = int_div("ts_us", rates.MINUTE_US).alias("minute")
    grouped = ftp_failures(packets).groupBy("src_ip", "dst_ip", minute).agg(*failure_measures())
    if earlier is None:
        return grouped
    both = grouped.unionByName(earlier).groupBy("src_ip", "dst_ip", "minute")
    return both.agg(F.sum("measure").alias("measure"), F.max("last").alias("last"))


def ftp_findings(grouped: DataFrame, least: int = 5) -> DataFrame:
    rows = grouped.where(F.col("measure") >= least).select("src_ip", "dst_ip", "measure", "last.*")
    text = F.format_string(_text("ftp_auth_fail"), "src_ip")
    return as_findings(rows, [(F.lit(True), "ftp_auth_fail", F.lit("MEDIUM"), text)])


def arp_spoof(packets: DataFrame) -> DataFrame:
    """Minutes in which one address speaks with several hardware addresses; one finding each."""
    return arp_findings(_speakers(packets))


def arp_packets(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("protocol") == "ARP") & F.col("src_mac").isNotNull())


def speaker_measures() -> list[Column]:
    """The least and the greatest hardware address, and the last packet.

    More than one distinct value is a minimum below a maximum: no set of values is kept.
    """
    last = F.max(F.struct("ts_us", "pid", "protocol", "dst_ip")).alias("last")
    return [F.min("src_mac").alias("least_mac"), F.max("src_mac").alias("most_mac"), last]


def _speakers(packets: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """ARP packets per address and minute."""
    minute = int_div("ts_us", rates.MINUTE_US).alias("minute")
    grouped = arp_packets(packets).groupBy("src_ip", minute).agg(*speaker_measures())
    if earlier is None:
        return grouped
    both = grouped.unionByName(earlier).groupBy("src_ip", "minute")
    return both.agg(F.min("least_mac").alias("least_mac"), F.max("most_mac").alias("most_mac"), F.max("last").alias("last"))


def arp_findings(grouped: DataFrame) -> DataFrame:
    rows = grouped.where("least_mac < most_mac").select("src_ip", "last.*")
    text = F.format_string(_text("arp_spoof"), "src_ip")
    return as_findings(rows, [(F.lit(True), "arp_spoof", F.lit("MEDIUM"), text)])


def payload_findings(packets: DataFrame) -> DataFrame:
    """The findings of all rules on payload packets."""
    return union_findings(payload_row_rules(packets), ftp_auth_fail(packets), arp_spoof(packets))


def payload_row_rules(packets: DataFrame) -> DataFrame:
    """The rules on a single payload packet, in one pass. Works on streams as well."""
    return _row_findings(packets, _sqli(), _dns_tunnel(), _tls_old_version())
