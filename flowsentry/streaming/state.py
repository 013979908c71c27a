"""Stateful detection on packet streams.

State is kept per block of five minutes and bucket of sources for floods, per source and target for port scans, else per
source; it holds a few numbers plus the times a rule still needs. A micro-batch brings the rows of one key together, so the limit per
trigger of the stream is what bounds a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsentry import dims
from flowsentry.functions.scalar import MICROS, int_div, is_truthy_port
from flowsentry.operators import detect
from flowsentry.operators.detect import BEACON, EXFIL_LIMIT, SCAN_PORTS, SSH_ATTEMPTS, Beacon
from flowsentry.operators.gaps import HORIZON_SECONDS
from flowsentry.operators.ordered import ResettingSet, ResettingSum, RunningCount
from flowsentry.operators.sessions import IDLE_SECONDS

IDLE_US = IDLE_SECONDS * MICROS
HORIZON_US = HORIZON_SECONDS * MICROS
BLOCK_US = 300 * MICROS
# Sources that share a flood state: a call and a timer per source and block cost more than what they count.
RATE_BUCKETS = 16
SOURCE_SPAN = 10 * BLOCK_US
DNS_EVERY = 100

# A hit: the packet, the rule, and up to two numbers for the description.
HIT_SCHEMA = T.StructType(
    [
        T.StructField("pid", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("measure", T.LongType()),
    ]
)
_PACKET = ["pid", "ts_us", "src_ip", "dst_ip", "protocol"]
_NO_HITS = pd.DataFrame({field.name: pd.Series(dtype="object") for field in HIT_SCHEMA.fields})


def _hits(frame: pd.DataFrame, rows, rule: str, measure) -> pd.DataFrame:
    return frame.iloc[rows][_PACKET].assign(rule=rule, measure=np.asarray(measure, dtype=np.int64))


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "pid"], ignore_index=True)


class RateProcessor(StatefulProcessor):
    """Sliding counts of a bucket of sources in one block of time; the end of the block before is context.

    All sources of the bucket are counted in one call. Each call appends the times and packets of its own rows to the state
    of the block, as one entry, so a micro-batch writes what is new only.
    """

    def __init__(self, rules):
        self.rules = [rule._asdict() for rule in rules]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState(
            "held", "sources array<string>, sizes array<bigint>, times array<bigint>, counts array<bigint>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        held = list(self.held.get()) if self.held.exists() else []
        if not held:
            self.handle.registerTimer((int(key[0]) + 1) * BLOCK_US // 1000 + 1)
        now = frame["ts_us"].to_numpy(dtype=np.int64)
        sizes = np.concatenate([np.asarray(entry[1], dtype=np.int64) for entry in held] or [now[:0]])
        times = np.concatenate([np.asarray(entry[2], dtype=np.int64) for entry in held] or [now[:0]])
        counts = np.concatenate([np.asarray(entry[3], dtype=np.int64) for entry in held] or [now[:0]])
        names = [source for entry in held for source in entry[0]]
        codes, sources = pd.factorize(np.array([*names, *frame["src_ip"]], dtype=object), use_na_sentinel=False)
        # A source's times follow those of the source before it, farther away than any window reaches.
        zero = int(key[0]) * BLOCK_US - 2 * BLOCK_US
        before = np.repeat(codes[: len(names)].astype(np.int64), sizes) * SOURCE_SPAN + (times - zero)
        place = codes[len(names) :].astype(np.int64) * SOURCE_SPAN + (now - zero)

        fresh, fresh_counts = np.unique(place, return_counts=True)
        owners, starts = np.unique(fresh // SOURCE_SPAN, return_index=True)
        self.held.appendValue(
            (
                [None if pd.isna(source) else source for source in sources[owners]],
                np.diff([*starts, len(fresh)]).tolist(),
                (fresh % SOURCE_SPAN + zero).tolist(),
                fresh_counts.tolist(),
            )
        )
        ticks, at = np.unique(np.concatenate([before, fresh]), return_inverse=True)
        weights = np.bincount(at, weights=np.concatenate([counts, fresh_counts])).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(weights)])
        until = np.searchsorted(ticks, place, side="right")
        own, protocol, flags = (frame[name].to_numpy() for name in ("own", "protocol", "flags"))
        for rule in self.rules:
            since = np.searchsorted(ticks, place - rule["seconds"] * MICROS, side="right")
            recent = running[until] - running[since]
            mask = own & (protocol == rule["protocol"]) & (recent > rule["threshold"])
            if rule["flags"] is not None:
                mask &= flags == rule["flags"]
            hits = np.flatnonzero(mask)
            if len(hits):
                yield _hits(frame, hits, rule["rule"], recent[hits])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class SourceProcessor(StatefulProcessor):
    """Rules on the history of a source: counters and sums, gaps."""

    def __init__(self, counters: bool = False, beacon: Beacon | None = None, watermark_us: int = 60 * MICROS):
        self.counters = counters
        self.beacon = None if beacon is None else {**beacon._asdict(), "most": beacon.most_events()}
        self.slack = watermark_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "history", "events array<bigint>, dns bigint, ssh bigint, bytes bigint, last_us bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        held = self.state.get() if self.state.exists() else ([], 0, 0, 0, None)
        events, dns, ssh, total, last = held
        found = []
        if self.beacon is not None:
            hits, events = self._beacon_hits(frame, events)
            found += hits
        if self.counters:
            hits, dns, ssh, total = self._counter_hits(frame, dns, ssh, total, last)
            found += hits

        newest = int(frame["ts_us"].iat[-1])
        last = newest if last is None else max(newest, last)
        self.state.update((list(events), dns, ssh, total, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + IDLE_US) // 1000 + 1)
        yield pd.concat(found, ignore_index=True) if found else _NO_HITS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield _NO_HITS

    def close(self) -> None:
        pass

    def _beacon_hits(self, frame, events):
        rule, most = self.beacon, self.beacon["most"]
        now = frame["ts_us"].to_numpy(dtype=np.int64)
        all_times = np.sort(np.concatenate([np.asarray(events, dtype=np.int64), now]))
        gaps = np.diff(all_times) / MICROS
        rows, measures = [], []
        start = np.searchsorted(all_times, now - HORIZON_US, side="left")
        end = np.searchsorted(all_times, now, side="right")
        candidates = (frame["protocol"].to_numpy() == "HTTP") & (end - start >= rule["min_events"]) & (end - start <= most)
        for row in np.flatnonzero(candidates):
            history = gaps[start[row] : end[row] - 1]
            mean = float(history.mean())
            if round(float(history.var()), 6) < rule["max_variance"] and rule["min_gap"] < mean < rule["max_gap"]:
                rows.append(row)
                measures.append(round(mean))
        found = [_hits(frame, rows, "c2_beacon", measures)] if rows else []
        # A packet may still come that is late by the watermark. Its history reaches back from there: of
        # what lies before that point, one event more than a beacon can have settles that it is none.
        border = all_times[-1] - self.slack
        earlier = all_times[(all_times <= border) & (all_times >= border - HORIZON_US)]
        return found, [*earlier[-(most + 1) :].tolist(), *all_times[all_times > border].tolist()]

    def _counter_hits(self, frame, dns, ssh, total, last):
        now = frame["ts_us"].to_numpy(dtype=np.int64)
        before = np.concatenate([[now[0] if last is None else last], now[:-1]])
        edges = [0, *np.flatnonzero(now - before > IDLE_US).tolist(), len(now)]
        found = []
        for start, end in zip(edges, edges[1:]):
            if start in edges[1:-1]:
                dns = ssh = total = 0
            if start == end:
                continue
            part = frame.iloc[start:end]
            protocol = part["protocol"].to_numpy()
            dns_part, ssh_part = part[protocol == "DNS"], part[protocol == "SSH"]
            (dns,), rows, numbers = RunningCount(lambda n: n % DNS_EVERY == 0).run([dns], dns_part["pid"].to_numpy())
            if len(rows):
                found.append(_hits(dns_part, rows, "dns_recon", numbers))
            (ssh,), rows, numbers = RunningCount(lambda n: np.isin(n, SSH_ATTEMPTS)).run(
                [ssh], ssh_part["pid"].to_numpy()
            )
            if len(rows):
                found.append(_hits(ssh_part, rows, "ssh_brute_force", numbers))
            (total,), rows, sums = ResettingSum(EXFIL_LIMIT).run([total], part["length"].to_numpy(dtype=np.int64))
            if len(rows):
                found.append(_hits(part, rows, "exfil", sums))
        return found, int(dns), int(ssh), int(total)


class PortScanProcessor(StatefulProcessor):
    """Distinct ports per source and target, cleared when there are too many.

    Each port is an entry of its own, so a micro-batch writes new ports only. Sets end when their pair is idle for longer
    than ``idle_us``, if that is given.
    """

    def __init__(self, limit: int, idle_us: int | None = None):
        self.limit = limit
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ports = handle.getMapState("ports", "port bigint", "seen boolean")
        self.last = handle.getValueState("last", "last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        now, probed = (frame[name].to_numpy(dtype=np.int64) for name in ("ts_us", "dst_port"))
        held = [port for (port,) in self.ports.keys()]
        edges, cleared, state, hits, measures = [0, len(now)], False, held, [], []
        if self.idle is not None:
            before = np.concatenate([[self.last.get()[0] if self.last.exists() else now[0]], now[:-1]])
            pauses = np.flatnonzero(now - before > self.idle).tolist()
            edges = [0, *pauses, len(now)]
            newest = max(int(now[-1]), int(before[0]))
            self.last.update((newest,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((newest + self.idle) // 1000 + 1)
        for part, (start, end) in enumerate(zip(edges, edges[1:])):
            if part:  # after a pause
                state, cleared = [], True
            state, found, measure = ResettingSet(self.limit).run(state, probed[start:end])
            cleared = cleared or bool(len(found))
            hits.append(found + start)
            measures.append(measure)
        if cleared:
            self.ports.clear()
        for port in set(state) - (set() if cleared else set(held)):
            self.ports.updateValue((int(port),), (True,))
        yield _hits(frame, np.concatenate(hits), "port_scan", np.concatenate(measures))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ports.clear()
        self.last.clear()
        yield _NO_HITS

    def close(self) -> None:
        pass


def _as_findings(hits: DataFrame) -> DataFrame:
    """Findings with the texts of the batch rules."""
    number, src = F.col("measure"), F.col("src_ip")
    texts = {rule.rule: (rule.text, rule.severity) for rule in detect.RATE_RULES}
    texts |= dims.FINDING_TEXTS
    candidates = []
    for rule, (text, severity) in texts.items():
        level = F.lit(severity)
        if rule == "ssh_brute_force":
            level = F.when(number >= detect.SSH_CRITICAL_ATTEMPTS, F.lit("CRITICAL")).otherwise(level)
        shown = int_div(number, 1_000_000) if rule == "exfil" else number
        candidates.append((F.col("rule") == rule, rule, level, F.format_string(text, src, shown)))
    return detect.as_findings(hits, candidates)


def _rows(packets: DataFrame) -> DataFrame:
    return packets.select(*_PACKET, "length", F.coalesce("flags", F.lit("")).alias("flags"), "ts")


def _per_source(packets: DataFrame, processor: SourceProcessor) -> DataFrame:
    grouped = _rows(packets).groupBy("src_ip")
    return _as_findings(grouped.transformWithStateInPandas(processor, HIT_SCHEMA, "append", "eventTime"))


def stream_rates(packets: DataFrame, *, buckets: int = RATE_BUCKETS) -> DataFrame:
    """Flood rules on sliding counts.

    State is kept per block of five minutes and bucket of sources: a packet goes to its own block, and as context to the
    next one if it is still in a window there. A backlog of a busy source so spreads over its blocks.
    """
    longest_us = max(rule.seconds for rule in detect.RATE_RULES) * MICROS
    block = int_div("ts_us", BLOCK_US)
    reaches_on = (block + 1) * BLOCK_US - F.col("ts_us") < longest_us
    copies = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(True).alias("own")),
            F.when(reaches_on, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        )
    )
    bucket = F.pmod(F.hash("src_ip"), F.lit(buckets)).alias("bucket")
    grouped = _rows(packets).select("*", F.inline(copies), bucket).groupBy("block", "bucket")
    processor = RateProcessor(detect.RATE_RULES)
    return _as_findings(grouped.transformWithStateInPandas(processor, HIT_SCHEMA, "append", "eventTime"))


def stream_counters(packets: DataFrame) -> DataFrame:
    """Rules on running counts and sums; an idle hour ends the state."""
    return _per_source(packets, SourceProcessor(counters=True))


def stream_beacon(packets: DataFrame, watermark_seconds: int = 60, beacon: Beacon = BEACON) -> DataFrame:
    return _per_source(packets, SourceProcessor(beacon=beacon, watermark_us=watermark_seconds * MICROS))


def stream_source_rules(packets: DataFrame, watermark_seconds: int = 60) -> DataFrame:
    """All rules on the history of a source."""
    history = _per_source(packets, SourceProcessor(True, BEACON, watermark_seconds * MICROS))
    return stream_rates(packets).unionByName(history)


def stream_port_scan(packets: DataFrame, limit: int = SCAN_PORTS, idle_seconds: int | None = None) -> DataFrame:
    """Port sets never end, as in batch; ``idle_seconds`` ends those of pairs idle for longer, which bounds the state."""
    processor = PortScanProcessor(limit, None if idle_seconds is None else idle_seconds * MICROS)
    tcp = packets.where((F.col("protocol") == "TCP") & is_truthy_port("dst_port"))
    hits = (
        tcp.select(*_PACKET, "dst_port", "ts")
        .groupBy("src_ip", "dst_ip")
        .transformWithStateInPandas(processor, HIT_SCHEMA, "append", "eventTime")
    )
    return _as_findings(hits)
