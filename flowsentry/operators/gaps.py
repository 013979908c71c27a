"""Gaps between the events of a source, for beacon detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS, int_div

HORIZON_SECONDS = 3600
CELL_SECONDS = 60


def interarrival_stats(packets: DataFrame, horizon_seconds: int = HORIZON_SECONDS) -> DataFrame:
    """Packets with number, mean gap and gap variance of the events of their source so far.

    History is the last ``horizon_seconds``, both ends included; packets alone in it are left out.
    As with sliding counts, an event adds to running sums when it arrives and takes itself away
    when it leaves. With an event goes the gap behind it: the gap to the event before counts only
    while that one is still there. Sums restart in every cell of a minute from what earlier cells
    left, so a busy source spreads over its cells. All sums are exact integers.
    """
    horizon_us, cell_us = horizon_seconds * MICROS, CELL_SECONDS * MICROS
    exact = "decimal(38,0)"
    ticks = _with_neighbours(packets, cell_us)
    before = F.coalesce(F.col("ts_us") - F.col("previous_us"), F.lit(horizon_us + 1))
    after = F.coalesce(F.col("next_us") - F.col("ts_us"), F.lit(horizon_us + 1))

    def change(at: Column, arrived: Column, n: Column, gap: Column, sign: int) -> Column:
        inside = F.when(gap <= horizon_us, gap).otherwise(F.lit(0)).cast("bigint")
        square = inside.cast("decimal(19,0)") * inside.cast("decimal(19,0)")
        return F.struct(
            at.alias("at"),
            arrived.alias("arrived"),
            (n * sign).alias("n"),
            (inside * sign).alias("gaps"),
            (square * sign).cast(exact).alias("squares"),
        )

    none = F.lit(0).cast("bigint")
    moves = ticks.select(
        "src_ip",
        F.inline(
            F.array(
                change(F.col("ts_us"), F.col("n"), F.col("n"), before, 1),
                change(F.col("ts_us") + horizon_us + 1, none, F.col("n"), after, -1),
            )
        ),
    ).withColumn("cell", int_div("at", cell_us))
    sums = ["n", "gaps", "squares"]
    earlier = Window.partitionBy("src_ip").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        moves.groupBy("src_ip", "cell")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select(
            "src_ip",
            "cell",
            (F.col("cell") * cell_us).alias("at"),
            none.alias("arrived"),
            *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums],
        )
    )
    running = Window.partitionBy("src_ip", "cell").orderBy("at")
    counted = moves.unionByName(carry).select(
        "src_ip",
        F.col("at").alias("ts_us"),
        "arrived",
        F.sum("n").over(running).alias("n_events"),
        F.sum("gaps").over(running).alias("_gaps"),
        F.sum("squares").over(running).cast(exact).alias("_squares"),
    )
    steps = F.col("n_events") - 1
    total = F.col("_gaps").cast("decimal(19,0)")
    spread = (F.col("_squares") * steps.cast("decimal(19,0)")).cast(exact) - (total * total).cast(exact)
    stats = counted.where("arrived > 0 AND n_events > 1").select(
        "src_ip",
        "ts_us",
        "n_events",
        (F.col("_gaps") / steps / MICROS).alias("avg_gap"),
        (spread.cast("double") / steps / steps / MICROS / MICROS).alias("var_gap"),
    )
    return packets.join(stats, ["src_ip", "ts_us"])


def _with_neighbours(packets: DataFrame, cell_us: int) -> DataFrame:
    """Times of a source with their number of packets and the times before and after.

    Neighbours are looked up inside a cell; across cells they are the ends of adjacent cells.
    """
    ticks = (
        packets.groupBy("src_ip", "ts_us")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cell", int_div("ts_us", cell_us))
    )
    cells = Window.partitionBy("src_ip").orderBy("cell")
    ends = ticks.groupBy("src_ip", "cell").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    ends = ends.select(
        "src_ip",
        "cell",
        F.lag("last_us").over(cells).alias("before_us"),
        F.lead("first_us").over(cells).alias("after_us"),
    )
    within = Window.partitionBy("src_ip", "cell").orderBy("ts_us")
    return ticks.join(ends, ["src_ip", "cell"]).select(
        "src_ip",
        "ts_us",
        "n",
        F.coalesce(F.lag("ts_us").over(within), "before_us").alias("previous_us"),
        F.coalesce(F.lead("ts_us").over(within), "after_us").alias("next_us"),
    )


def sparse_interarrival_stats(
    packets: DataFrame,
    max_events: int,
    horizon_seconds: int = HORIZON_SECONDS,
) -> DataFrame:
    """As ``interarrival_stats``, but only for histories of 2 to ``max_events`` events.

    That makes a busy source cheap: in a block as long as the horizon only the first
    ``max_events`` can have so short a history, and of the block before only the last
    ``max_events`` can be in it. One row more of each is kept, so that a history that was cut, also
    among rows of one time, still counts too many. Both limits are applied before the shuffle (a rank
    filter), so no task sees more than ``2 * max_events + 2`` rows of a source and block per map task.
    """
    horizon_us = horizon_seconds * MICROS
    rows = packets.withColumn("block", int_div("ts_us", horizon_us))
    block = Window.partitionBy("src_ip", "block")
    first = block.orderBy("ts_us", "pid")
    last = block.orderBy(F.desc("ts_us"), F.desc("pid"))
    own = rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= max_events + 1)
    before = (
        rows.select("src_ip", "block", "ts_us", "pid")
        .withColumn("_rank", F.row_number().over(last))
        .where(F.col("_rank") <= max_events + 1)
        .withColumn("block", F.col("block") + 1)
    )
    both = own.withColumn("_own", F.lit(True)).unionByName(before, allowMissingColumns=True)

    gap = (F.col("ts_us") - F.lag("ts_us").over(first)) / MICROS
    frame = block.orderBy("ts_us").rangeBetween(-horizon_us, 0)
    squares = F.coalesce(F.col("_gap") * F.col("_gap"), F.lit(0.0))
    # The gap before the first event of the frame is not part of the history.
    inner = F.sum("_square").over(frame) - F.first("_square").over(frame)
    span = (F.col("ts_us") - F.min("ts_us").over(frame)) / MICROS
    gaps = F.col("n_events") - 1
    return (
        both.withColumn("_gap", gap)
        .withColumn("_square", squares)
        .withColumn("n_events", F.count(F.lit(1)).over(frame))
        .withColumn("_inner", inner)
        .withColumn("_span", span)
        .where(F.col("_own") & F.col("n_events").between(2, max_events))
        .withColumn("avg_gap", F.col("_span") / gaps)
        .withColumn("var_gap", F.col("_inner") / gaps - F.col("avg_gap") * F.col("avg_gap"))
        .drop("block", "_rank", "_own", "_gap", "_square", "_inner", "_span")
    )
