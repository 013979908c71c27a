"""Rollups of packets: per minute, per protocol, per connection, and metric thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry import dims
from flowsentry.functions.scalar import MICROS, time_bucket
from flowsentry.operators.sessions import IDLE_SECONDS, hour_of, number_sessions


def perf_minutely(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Packets and alerts per minute; minutes with neither are absent."""

    def per_minute(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(time_bucket("ts_us", 60).alias("bucket")).agg(F.count(F.lit(1)).alias(name))

    joined = per_minute(packets, "packets_pm").join(per_minute(alerts, "alerts_pm"), "bucket", "full_outer")
    return joined.na.fill(0, ["packets_pm", "alerts_pm"])


def merged_protocol_stats(stats: DataFrame) -> DataFrame:
    """Rollups of several runs as one: a row per minute and protocol."""
    sums = [F.sum(name).alias(name) for name in ("pkt_count", "byte_count")]
    return stats.groupBy("bucket", "protocol").agg(*sums)


def protocol_stats(packets: DataFrame) -> DataFrame:
    """Packets and bytes per minute and protocol."""
    return packets.groupBy(time_bucket("ts_us", 60).alias("bucket"), "protocol").agg(
        F.count(F.lit(1)).alias("pkt_count"), F.sum("length").alias("byte_count")
    )


def source_stats(packets: DataFrame) -> DataFrame:
    """Packets, bytes and malicious packets per day and source, of a table partitioned by ``dt``."""
    return packets.groupBy(F.col("dt").alias("day"), "src_ip").agg(
        F.count(F.lit(1)).alias("pkt_count"), F.sum("length").alias("bytes"), F.sum("is_malicious").alias("threat_count")
    )


def merged_perf(minutes: DataFrame) -> DataFrame:
    """Key figures of several runs as one row per minute: counts add up, of gauges the highest stays."""
    counts = [F.sum(name).cast("int").alias(name) for name in ("packets_pm", "alerts_pm")]
    gauges = [F.max(name).alias(name) for name in ("db_query_ms", "cpu_pct", "mem_mb", "drop_pct")]
    return minutes.groupBy("id", "ts_us", "dt").agg(*counts, *gauges)


CONNECTION_KEYS = ["low", "high", "protocol"]


def with_ends(packets: DataFrame) -> DataFrame:
    """Packets with the two ends of their connection in a fixed order, whatever the direction."""
    source = F.struct(F.col("src_ip").alias("ip"), F.coalesce("src_port", F.lit(-1)).alias("port"))
    target = F.struct(F.col("dst_ip").alias("ip"), F.coalesce("dst_port", F.lit(-1)).alias("port"))
    return packets.withColumns(
        {"low": F.least(source, target), "high": F.greatest(source, target), "forward": source <= target}
    )


def connection_measures() -> list[Column]:
    """Aggregates of the packets between two ends; all of them can be merged."""
    length, zero = F.col("length").cast("bigint"), F.lit(0).cast("bigint")
    flags = F.coalesce("flags", F.lit(""))
    return [
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("pkt_count"),
        F.min(F.struct("ts_us", "pid", "forward")).alias("first"),
        F.sum(F.when(F.col("forward"), length).otherwise(zero)).alias("forward_bytes"),
        F.sum(F.when(F.col("forward"), zero).otherwise(length)).alias("backward_bytes"),
        F.max((flags.contains("FIN") | flags.contains("RST")).cast("int")).alias("closed"),
    ]


def connection_rows(measured: DataFrame) -> DataFrame:
    """Connections as seen from the sender of the first packet."""
    forward = F.col("first.forward")

    def pick(ahead: str, back: str) -> Column:
        return F.when(forward, F.col(ahead)).otherwise(F.col(back))

    opener, other = pick("low", "high"), pick("high", "low")
    return measured.select(
        F.col("first_us").alias("start_us"),
        F.col("last_us").alias("end_us"),
        opener["ip"].alias("src_ip"),
        other["ip"].alias("dst_ip"),
        F.nullif(opener["port"], F.lit(-1)).alias("src_port"),
        F.nullif(other["port"], F.lit(-1)).alias("dst_port"),
        "protocol",
        F.when(F.col("closed") == 1, "CLOSED").otherwise("ACTIVE").alias("state"),
        pick("forward_bytes", "backward_bytes").alias("bytes_sent"),
        pick("backward_bytes", "forward_bytes").alias("bytes_recv"),
        "pkt_count",
    )


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*CONNECTION_KEYS, *keys).agg(
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("first").alias("first"),
        *[F.sum(name).alias(name) for name in ("pkt_count", "forward_bytes", "backward_bytes")],
        F.max("closed").alias("closed"),
    )


def connections(packets: DataFrame) -> DataFrame:
    """Connections: packets of both directions of a 5-tuple without an idle hour between them.

    One row per 5-tuple and hour is aggregated before the connections are told apart, so a busy
    5-tuple costs no window over its packets.
    """
    return connection_rows(connection_parts(packets))


def connection_parts(packets: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What the packets add to each connection; ``before`` are the ones that an earlier run has left open.

    A part holds the first packet of its connection, also where an earlier run has seen it; parts without packets
    of their own belong to connections that only stay open.
    """
    hours = with_ends(packets).groupBy(*CONNECTION_KEYS, hour_of().alias("hour")).agg(*connection_measures())
    if before is not None:
        zero = F.lit(0).cast("bigint")
        names = ["pkt_count", "forward_bytes", "backward_bytes"]
        at_last = {"first_us": F.col("last_us"), "hour": hour_of("last_us"), "closed": F.lit(0), **{n: zero for n in names}}
        hours = hours.unionByName(before.withColumns(at_last))
    return _merged(number_sessions(hours, *CONNECTION_KEYS), "sid")


def open_connections(parts: DataFrame, border_us: int) -> DataFrame:
    """Connections that a packet after the border can still belong to."""
    return parts.where(F.col("last_us") >= border_us - IDLE_SECONDS * MICROS).select(*CONNECTION_KEYS, "first", "last_us")


def merged_connections(parts: DataFrame) -> DataFrame:
    """Connections from the parts of all runs; those with the same first packet are one."""
    own = parts.drop("sid", "first_us", "run").withColumnRenamed("first", "opened")
    opened = own.withColumns({"first": F.col("opened"), "first_us": F.col("opened.ts_us")})
    return connection_rows(_merged(opened, "opened"))


# Metrics by the way they are computed from the packets of a source, protocol and minute.
_COUNTS = ["syn_rate", "req_rate", "query_rate", "ping_rate", "session_rate", "relay_rate", "stream_flood"]
_MAXIMA = ["large_pkt", "attach_size", "amp_pkt"]
_DISTINCT = {"conn_rate": ["dst_ip", "dst_port"], "scan_rate": ["dst_ip"]}
_GROUP = ["src_ip", "protocol", "minute"]
FTP_DATA = 20  # fixed value: the port of FTP data connections


def _metric_rows(grouped: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The metrics each protocol has a threshold for, one row each."""
    wanted = [
        F.when(
            F.col("protocol") == protocol,
            F.struct(F.lit(metric).alias("metric"), values[metric].cast("double").alias("value")),
        )
        for protocol, metric, _ in dims.THRESHOLDS
        if metric in values
    ]
    return grouped.select(*_GROUP, F.inline(F.array_compact(F.array(*wanted))))


def minute_metrics(packets: DataFrame) -> DataFrame:
    """Metrics per source, protocol and minute, in long form."""
    keyed = packets.withColumn("minute", time_bucket("ts_us", 60))

    def protocols_of(metrics) -> list[str]:
        return sorted({protocol for protocol, metric, _ in dims.THRESHOLDS if metric in metrics})

    plain = ["flood_pps", *_COUNTS, *_MAXIMA]
    grouped = (
        keyed.where(F.col("protocol").isin(protocols_of(plain)))
        .groupBy(*_GROUP)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("flags") == "SYN").alias("syns"),
            F.max("length").alias("longest"),
        )
    )
    values = {name: F.col("n") for name in _COUNTS}
    values |= {name: F.col("longest") for name in _MAXIMA}
    values |= {"syn_rate": F.col("syns"), "flood_pps": F.col("n") / 60}
    parts = [_metric_rows(grouped, values)]
    for metric, columns in _DISTINCT.items():
        rows = keyed.where(F.col("protocol").isin(protocols_of([metric]))).select(*_GROUP, *columns)
        counts = rows.distinct().groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_metric_rows(counts, {metric: F.col("n")}))
    return reduce(DataFrame.unionByName, [*parts, _gratuitous(keyed), _data_connections(keyed), _amplification(keyed)])


def _gratuitous(keyed: DataFrame) -> DataFrame:
    """ARP packets of an address about itself."""
    own = keyed.where((F.col("protocol") == "ARP") & (F.col("src_ip") == F.col("dst_ip")))
    return _metric_rows(own.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")), {"gratuitous": F.col("n")})


def _data_connections(keyed: DataFrame) -> DataFrame:
    """Different targets of FTP packets from or to the data port."""
    data = keyed.where((F.col("protocol") == "FTP") & ((F.col("src_port") == FTP_DATA) | (F.col("dst_port") == FTP_DATA)))
    counts = data.select(*_GROUP, "dst_ip", "dst_port").distinct().groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"))
    return _metric_rows(counts, {"data_conn": F.col("n")})


def _amplification(keyed: DataFrame) -> DataFrame:
    """UDP bytes that an address gets in a minute, as a multiple of those it sends; who sends none has no factor."""
    udp = keyed.where(F.col("protocol") == "UDP")
    none = F.lit(0).cast("int")
    ends = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("length").alias("sent"), none.alias("got")),
        F.struct(F.col("dst_ip").alias("ip"), none.alias("sent"), F.col("length").alias("got")),
    )
    sums = udp.select("protocol", "minute", F.inline(ends)).groupBy(F.col("ip").alias("src_ip"), "protocol", "minute")
    both = sums.agg(F.sum("sent").alias("sent"), F.sum("got").alias("got")).where("sent > 0 AND got > 0")
    return _metric_rows(both, {"amp_factor": F.col("got") / F.col("sent")})


def threshold_rules(packets: DataFrame) -> DataFrame:
    """Metrics above the threshold of their protocol."""
    thresholds = F.broadcast(dims.threshold_table(packets.sparkSession))
    joined = minute_metrics(packets).join(thresholds, ["protocol", "metric"])
    return joined.where(F.col("value") > F.col("threshold"))
