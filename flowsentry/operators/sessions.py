"""Activity sessions of a source: its state ends after an idle hour.

Gaps longer than an hour can only lie between two different hours, so sessions follow from one
small row per source and hour. No window ever runs over the packets themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS, int_div
from flowsentry.operators.pruning import settle

IDLE_SECONDS = 3600


def hour_of(ts_us="ts_us") -> Column:
    return int_div(ts_us, IDLE_SECONDS * MICROS)


def number_sessions(hours: DataFrame, *keys: str) -> DataFrame:
    """Number the sessions of rows that hold ``first_us`` and ``last_us`` per key and hour.

    An hour may have a row before its own that stands for what an earlier run has carried on.
    """
    in_order = Window.partitionBy(*keys).orderBy("hour", "first_us")
    gap = F.col("first_us") - F.lag("last_us").over(in_order)
    starts = F.coalesce((gap > IDLE_SECONDS * MICROS).cast("int"), F.lit(0))
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hours.withColumn("_starts", starts).withColumn("sid", F.sum("_starts").over(running)).drop("_starts")


def session_hours(packets: DataFrame, **measures: Column) -> DataFrame:
    """One row per source and hour: session number, times, packets and the given aggregates."""
    hours = packets.groupBy("src_ip", hour_of().alias("hour")).agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("pkt_count"),
        *[measure.alias(name) for name, measure in measures.items()],
    )
    return number_sessions(hours, "src_ip")


def ip_sessions(packets: DataFrame) -> DataFrame:
    """The sessions of every source."""
    return (
        session_hours(packets)
        .groupBy("src_ip", "sid")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("pkt_count").alias("pkt_count"),
        )
    )


def with_session_ids(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows with the ``sid`` of their source; rows without a matching hour are dropped."""
    keyed = rows.withColumn("hour", hour_of())
    return keyed.join(hours, ["src_ip", "hour"]).select(*rows.columns, "sid")


def reaching(hours: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """Hours of the sessions in which a measure reaches its bound, with the totals of the session.

    Rows marked ``carried`` count in the totals and are no hours of their own.
    """
    session = Window.partitionBy("src_ip", "sid")
    summed = hours.withColumns({f"total_{name}": F.sum(name).over(session) for name in bounds})
    conditions = [F.col(f"total_{name}") >= least for name, least in bounds.items()]
    kept = summed.where(reduce(lambda left, right: left | right, conditions))
    kept = kept.where("NOT carried") if "carried" in hours.columns else kept
    return kept.select("src_ip", "hour", "sid", *[f"total_{name}" for name in bounds])


def sessions_reaching(packets: DataFrame, **bounds: tuple[Column, int]) -> DataFrame:
    """Hours of the sessions in which a count or sum reaches its bound, as a settled table.

    Every bound is ``name=(aggregate, least)`` with an aggregate that only grows; the session
    totals come back as ``total_<name>``. A source whose total stays below all bounds has no such
    session, and sources are far fewer than hours, so those sources go first.
    """

    reached = reduce(lambda left, right: left | right, [F.col(name) >= least for name, (_, least) in bounds.items()])
    totals = packets.groupBy("src_ip").agg(*[measure.alias(name) for name, (measure, _) in bounds.items()])
    sources = settle(totals.where(reached).select("src_ip"))
    hours = session_hours(
        packets.join(sources, "src_ip", "left_semi"), **{name: measure for name, (measure, _) in bounds.items()}
    )
    return settle(reaching(hours, {name: least for name, (_, least) in bounds.items()}))
