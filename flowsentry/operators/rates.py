"""Sliding counts per source.

A sliding frame over the packets would put a busy source into one task and cost the frame size
per row. Here a packet is +1 when it arrives and -1 when it leaves the window, and the count is a
running sum of those. Running sums start afresh in every cell of a few seconds with the packets
that earlier cells carry over, so one source spreads over as many tasks as it has cells.
Packets of a source that share a microsecond are added up before the shuffle, which bounds
a cell by its number of microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS, int_div
from flowsentry.operators.pruning import settle

CELL_SECONDS = 5
MINUTE_US = 60 * MICROS


def sliding_counts(packets: DataFrame, windows: list[int], cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Packets of the source in the last ``w`` seconds, per source and time, for every ``w``.

    Gives ``src_ip, ts_us, recent_<w>...``, counting all packets with ``t > ts_us - w`` up to and
    including ``ts_us``. Windows must be multiples of the cell.
    """
    if any(w % cell_seconds for w in windows):
        raise ValueError("windows must be multiples of the cell")
    cell_us = cell_seconds * MICROS

    def change(at: Column, arrived: Column, changes: dict[int, Column]) -> Column:
        fields = [changes.get(w, F.lit(0).cast("bigint")).alias(f"change_{w}") for w in windows]
        return F.struct(at.alias("at"), arrived.alias("arrived"), *fields)

    n, ts = F.col("n"), F.col("ts_us")
    none = F.lit(0).cast("bigint")
    ticks = packets.groupBy("src_ip", "ts_us").agg(F.count(F.lit(1)).alias("n"))
    arrive = change(ts, n, {w: n for w in windows})
    leave = [change(ts + w * MICROS, none, {w: -n}) for w in windows]
    moves = ticks.select("src_ip", F.inline(F.array(arrive, *leave)))

    cell = F.col("cell")
    reach = max(windows) // cell_seconds
    cells = ticks.groupBy("src_ip", int_div(ts, cell_us).alias("cell")).agg(F.sum("n").alias("n"))
    later = cells.select("src_ip", "cell", "n", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step"))
    carried = {w: F.when(F.col("step") <= w // cell_seconds, n).otherwise(none) for w in windows}
    carry = later.select(
        "src_ip",
        F.inline(F.array(change((cell + F.col("step")) * cell_us, none, carried))),
    )

    running = Window.partitionBy("src_ip", "cell").orderBy("at")
    counts = [F.sum(f"change_{w}").over(running).alias(f"recent_{w}") for w in windows]
    return (
        moves.unionByName(carry)
        .withColumn("cell", int_div("at", cell_us))
        .select("src_ip", F.col("at").alias("ts_us"), "arrived", *counts)
        .where("arrived > 0")
        .drop("arrived")
    )


def recent_count(packets: DataFrame, windows: list[int]) -> DataFrame:
    """Every packet with its sliding counts."""
    return packets.join(sliding_counts(packets, windows), ["src_ip", "ts_us"])


def numbered(rows: DataFrame, keys: list[str], cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Rows with their number (``measure``, from 1) within ``keys``, in order of time and packet.

    Rows are numbered within cells of a few seconds; the cells' counts, one row each, give where a cell
    starts. So a busy key spreads over its cells. A row with a ``weight`` counts as so many rows.
    """
    weighs = "weight" in rows.columns
    size = F.sum("weight") if weighs else F.count(F.lit(1))
    placed = rows.withColumn("_cell", int_div("ts_us", cell_seconds * MICROS))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_cell")
        .agg(size.alias("_n"))
        .select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys, "_cell").orderBy("ts_us", "pid")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.col("_start") + (F.sum("weight").over(upto) if weighs else F.row_number().over(within))
    return placed.join(starts, [*keys, "_cell"]).withColumn("measure", number).drop("_cell", "_start")


def busy_minutes(packets: DataFrame, rules: list[tuple[Column, int]]) -> DataFrame:
    """Minutes of a source in which a rule ``(trigger, threshold)`` on a count of a minute can fire."""
    minutes = packets.groupBy("src_ip", int_div("ts_us", MINUTE_US).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), *minute_triggers([trigger for trigger, _ in rules])
    )
    return settle(busy_of(minutes, [threshold for _, threshold in rules]))


def minute_triggers(triggers: list[Column]) -> list[Column]:
    return [F.count_if(trigger).alias(f"triggers_{at}") for at, trigger in enumerate(triggers)]


def busy_of(minutes: DataFrame, thresholds: list[int]) -> DataFrame:
    """The busy ones of minutes with their packets ``n`` and ``triggers_<i>`` per rule.

    A minute counts if it holds a trigger of the rule and has, with the minute before, more
    packets than the threshold; that minute before is kept as well, because its packets are still
    in the window. Counts of any other minute stay within the bound, so leaving them out changes no
    hit.
    """
    in_order = Window.partitionBy("src_ip").orderBy("minute")
    here = F.col("minute")

    def neighbour(function, distance: int, name: str) -> Column:
        adjacent = function("minute").over(in_order) == here + distance
        return F.coalesce(F.when(adjacent, function(name).over(in_order)), F.lit(0))

    with_before = F.col("n") + neighbour(F.lag, -1, "n")
    with_after = F.col("n") + neighbour(F.lead, 1, "n")
    keep = F.lit(False)
    for at, threshold in enumerate(thresholds):
        hot = (F.col(f"triggers_{at}") > 0) & (with_before > threshold)
        before_hot = (neighbour(F.lead, 1, f"triggers_{at}") > 0) & (with_after > threshold)
        keep = keep | hot | before_hot
    return minutes.withColumn("_keep", keep).where("_keep").select("src_ip", "minute")


def within_minutes(packets: DataFrame, minutes: DataFrame) -> DataFrame:
    keyed = packets.withColumn("minute", int_div("ts_us", MINUTE_US))
    return keyed.join(minutes, ["src_ip", "minute"], "left_semi").drop("minute")
