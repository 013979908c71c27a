"""What one run over packets leaves to the next, so that runs cut anywhere in time find what one run would.

A run takes all packets of a stretch of time; the next one takes later packets. Between them goes, per source or pair, only
what a rule still needs:

* the packets of the last minute (times only), for sliding counts;
* the last events of the last hour, no more than a beacon can have, for gaps;
* the counts and the bytes since the last hit of sources that are not idle yet, for counters and sums;
* the ports seen since the last hit of a source and target, for port scans;
* the parts of the minute that the border cuts, for the rules on whole minutes;
* the first packet and last time of connections that are not idle yet.

Each is a table whose rows enter the operators of the next run as rows before its own. They cannot raise a finding
themselves: what they stand for is within the limits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS, int_div
from flowsentry.operators.gaps import HORIZON_SECONDS
from flowsentry.operators.sessions import IDLE_SECONDS, hour_of

MINUTE_US = 60 * MICROS
HORIZON_US = HORIZON_SECONDS * MICROS
IDLE_US = IDLE_SECONDS * MICROS

_END = "struct<ip:string,port:int>"
SCHEMAS = {
    "border": "border_us long",
    "recent": "src_ip string, ts_us long",
    "events": "src_ip string, ts_us long, pid long",
    "sources": "src_ip string, last_us long, dns long, ssh long, bytes long",
    "ports": "src_ip string, dst_ip string, last_us long, ports array<int>",
    "failures": "src_ip string, dst_ip string, minute long, measure long, last struct<ts_us:long,pid:long,protocol:string>",
    "speakers": (
        "src_ip string, minute long, least_mac string, most_mac string, "
        "last struct<ts_us:long,pid:long,protocol:string,dst_ip:string>"
    ),
    "connections": (
        f"low {_END}, high {_END}, protocol string, first struct<ts_us:long,pid:long,forward:boolean>, last_us long"
    ),
}


class Carried(NamedTuple):
    """The tables at a border; all packets up to and including ``border_us`` are behind it."""

    border_us: int
    recent: DataFrame
    events: DataFrame
    sources: DataFrame
    ports: DataFrame
    failures: DataFrame
    speakers: DataFrame
    connections: DataFrame

    # As rows of the operators --------------------------------------------------------------

    def minutes(self, triggers: list[str]) -> DataFrame:
        """Packets per source and minute, none of them a trigger."""
        counts = self.recent.groupBy("src_ip", int_div("ts_us", MINUTE_US).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("*", *[F.lit(0).cast("long").alias(name) for name in triggers])

    def hours(self, measures: list[str]) -> DataFrame:
        """One row per source at its last time, with what its session has counted."""
        last = F.col("last_us")
        return self.sources.select(
            "src_ip", hour_of(last).alias("hour"), last.alias("first_us"), last, *measures, F.lit(True).alias("carried")
        )

    def counted(self, counters: dict[str, str]) -> DataFrame:
        """A packet per source and counted protocol that weighs as much as all so far. Sessions carried on have number 0."""
        each = [
            F.when(F.col(name) > 0, F.struct(F.lit(protocol).alias("protocol"), F.col(name).alias("weight")))
            for name, protocol in counters.items()
        ]
        rows = self.sources.select("src_ip", F.col("last_us").alias("ts_us"), F.inline(F.array_compact(F.array(*each))))
        return rows.withColumns({"pid": F.lit(-1).cast("long"), "sid": F.lit(0).cast("long")})

    def byte_rows(self) -> DataFrame:
        """A packet per source as long as its bytes since the last hit."""
        rows = self.sources.where("bytes > 0").select(
            "src_ip", F.col("last_us").alias("ts_us"), F.col("bytes").cast("int").alias("length")
        )
        return rows.withColumns({"pid": F.lit(-1).cast("long"), "sid": F.lit(0).cast("long")})

    def probes(self) -> DataFrame:
        """A packet per port that its pair has seen since the last hit."""
        return self.ports.select(
            "src_ip", "dst_ip", F.col("last_us").alias("ts_us"), F.lit(-1).cast("long").alias("pid"), F.explode("ports").alias("dst_port")
        )


# What a run leaves -----------------------------------------------------------------------------


def recent(packets: DataFrame, before: DataFrame | None, border_us: int) -> DataFrame:
    """Times of the packets that a window of up to a minute can still hold."""
    rows = packets.select("src_ip", "ts_us")
    rows = rows if before is None else rows.unionByName(before)
    return rows.where(F.col("ts_us") > border_us - MINUTE_US)


def events(packets: DataFrame, before: DataFrame | None, border_us: int, most: int) -> DataFrame:
    """The last ``most`` events of a source in the hour before the border; Spark limits ranks before the shuffle."""
    rows = packets.select("src_ip", "ts_us", "pid")
    rows = rows if before is None else rows.unionByName(before)
    last = Window.partitionBy("src_ip").orderBy(F.desc("ts_us"), F.desc("pid"))
    near = rows.where(F.col("ts_us") >= border_us - HORIZON_US)
    return near.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= most).drop("_rank")


def sources(hours: DataFrame, byte_hits: DataFrame, border_us: int) -> DataFrame:
    """The last session of each source that is not idle yet: its counts, and its bytes since the last hit.

    The sums of all hits of a session are the bytes up to its last one.
    """
    spent = byte_hits.groupBy("src_ip", "sid").agg(F.sum("measure").alias("_spent"))
    per_session = hours.groupBy("src_ip", "sid").agg(
        F.max("last_us").alias("last_us"), *[F.sum(name).alias(name) for name in ("dns", "ssh", "bytes")]
    )
    # A session before the last cannot reach that near to the border.
    open_ = per_session.where(F.col("last_us") >= border_us - IDLE_US)
    newest = F.max(F.struct("sid", "last_us", "dns", "ssh", "bytes")).alias("s")
    newest_rows = open_.groupBy("src_ip").agg(newest).select("src_ip", "s.*").join(spent, ["src_ip", "sid"], "left")
    left = F.col("bytes") - F.coalesce("_spent", F.lit(0))
    return newest_rows.select("src_ip", "last_us", "dns", "ssh", left.cast("long").alias("bytes"))


def ports(probes: DataFrame, hits: DataFrame, border_us: int, idle_seconds: int | None = None) -> DataFrame:
    """The ports of each pair since its last hit, which are within the limit, and the time of its last probe.

    Port sets never expire, as in one run; ``idle_seconds`` drops those of pairs idle for longer, which bounds the table.
    """
    last = hits.groupBy("src_ip", "dst_ip").agg(F.max(F.struct("ts_us", "pid")).alias("_hit"))
    joined = probes.join(last, ["src_ip", "dst_ip"], "left")
    later = joined.where(F.col("_hit").isNull() | (F.struct("ts_us", "pid") > F.col("_hit")))
    sets = later.groupBy("src_ip", "dst_ip").agg(F.max("ts_us").alias("last_us"), F.collect_set("dst_port").alias("ports"))
    if idle_seconds is not None:
        sets = sets.where(F.col("last_us") >= border_us - idle_seconds * MICROS)
    return sets


def open_minutes(grouped: DataFrame, border_us: int) -> DataFrame:
    """Rows of the minute that the border cuts."""
    return grouped.where(F.col("minute") == border_us // MINUTE_US)


# At rest -----------------------------------------------------------------------------------------


def write(carried: Carried, root: str, place: str) -> None:
    """Write the tables to their folders ``place``, replacing what is there. The border comes last: without it there is no state."""
    spark = carried.recent.sparkSession
    for name in Carried._fields[1:]:
        getattr(carried, name).write.mode("overwrite").parquet(f"{root}/{name}/{place}")
    border = spark.createDataFrame([(carried.border_us,)], SCHEMAS["border"])
    border.coalesce(1).write.mode("overwrite").parquet(f"{root}/border/{place}")


def read(spark: SparkSession, root: str, place: str) -> Carried:
    """What a run has left in the folders ``place``."""
    found = {name: spark.read.schema(ddl).parquet(f"{root}/{name}/{place}") for name, ddl in SCHEMAS.items()}
    return Carried(found.pop("border").first()[0], **found)
