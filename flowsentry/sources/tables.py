"""Scans and sinks of the tables at rest: Parquet, partitioned by ``dt``.

A scan takes the columns from the schema constants and never infers. ``dt`` comes from the folder
names, so a bound on it prunes whole days; inside a day files are sorted by time and the row-group
statistics of ``ts_us`` prune the rest. Packets also carry Bloom filters of their addresses, which prune row groups for
a filter on one address.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from flowsentry import schemas
from flowsentry.functions.scalar import timestamp_of
from flowsentry.operators.filters import all_of, split_rows
from flowsentry.operators.lookups import ack_overlay

FILES_PER_TRIGGER = 16
ROWS_PER_TRIGGER = 20_000_000


# Columns whose equality filters an index helps, per table; the filters grow with the values up to a megabyte each.
INDEXED = {"packets": ["src_ip", "dst_ip"]}


def _folder(spark: SparkSession, path: str):
    """A path and its file system, wherever the table lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    files, path = _folder(spark, path)
    return files.exists(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    files, path = _folder(spark, path)
    files.delete(path, True)


def days(spark: SparkSession, path: str) -> list[date]:
    """The days of a table, from the names of its folders: no job, no file is opened. Runs may have folders of their own."""
    found = set()
    for pattern in ("dt=*", "*=*/dt=*"):
        files, glob = _folder(spark, f"{path}/{pattern}")
        for status in files.globStatus(glob) or []:
            name = status.getPath().getName().removeprefix("dt=")
            if name[:1].isdigit():
                found.add(date.fromisoformat(name))
    return sorted(found)


def _at_rest(table: str) -> T.StructType:
    return T.StructType([*schemas.TABLES[table].fields, T.StructField("dt", T.DateType(), True)])


def scan(spark: SparkSession, table: str, path: str) -> DataFrame:
    return spark.read.schema(_at_rest(table)).parquet(path).withColumn("ts", timestamp_of())


def scan_packets(spark: SparkSession, path: str) -> DataFrame:
    """The packet table, with the ``payload`` as bytes."""
    return scan(spark, "packets", path).withColumn("payload", F.unhex("payload_hex"))


def scan_alerts(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "alerts", path)


def scan_geo(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "geo_traffic", path)


def scan_mitre(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "mitre_events", path)


def scan_perf(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "performance_metrics", path)


def parse_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets from JSON messages in ``value``, and the messages that are none or lack a required column."""
    packet = F.from_json(F.col("value").cast("string"), schemas.PACKETS)
    required = all_of([F.col(f"packet.{name}").isNotNull() for name in schemas.required_columns("packets")])
    valid, broken = split_rows(raw.withColumn("packet", packet), required)
    return valid.select("packet.*"), broken.drop("packet")


def packet_stream(
    spark: SparkSession,
    path: str | None = None,
    watermark: str = "1 minute",
    max_files: int = FILES_PER_TRIGGER,
    kafka: dict[str, str] | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """Packets as a stream with a watermark on ``ts``, from files or from a Kafka topic.

    Kafka values are JSON objects with the packet columns; broken ones are left out, see
    ``parse_messages`` for a stream of them to quarantine. ``kafka`` holds the reader options, with
    ``maxOffsetsPerTrigger`` among them. The limit per trigger bounds the rows that one source can
    have in a micro-batch, so there always is one: of files their number or, instead, their ``max_bytes`` (such as "4g").
    """
    if kafka is not None:
        options = {"maxOffsetsPerTrigger": str(ROWS_PER_TRIGGER), **kafka}
        raw = spark.readStream.format("kafka").options(**options).load()
        packets, _ = parse_messages(raw)
    else:
        limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
        packets = spark.readStream.schema(schemas.PACKETS).option(*limit).parquet(path)
    packets = packets.withColumn("payload", F.unhex("payload_hex"))
    return packets.withColumn("ts", timestamp_of()).withWatermark("ts", watermark)


def to_table(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table plus ``dt``; columns the DataFrame lacks get their default or NULL."""
    defaults = schemas.DEFAULTS[table]
    if table == "packets" and "payload" in df.columns and "payload_hex" not in df.columns:
        df = df.withColumn("payload_hex", F.hex("payload"))
    columns = []
    for field in schemas.TABLES[table].fields:
        if field.name in df.columns:
            value = F.col(field.name)
            if field.name in defaults:
                value = F.coalesce(value, F.lit(defaults[field.name]))
        else:
            value = F.lit(defaults.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns).withColumn("dt", F.to_date(timestamp_of()))


@contextmanager
def _small_ranges(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution joins ranges up to 16 KB, and leaves some for each core, while a table is written by day.

    By default it joins them up to a megabyte. That can be thousands of sparse days, whose files one task would write.
    """
    ranges = 4 * spark.sparkContext.defaultParallelism
    names = {"minPartitionSize": "16KB", "minPartitionNum": str(ranges)}
    settings = {f"spark.sql.adaptive.coalescePartitions.{name}": value for name, value in names.items()}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def write_days(rows: DataFrame, path: str, mode: str = "error", options: dict[str, str] | None = None) -> None:
    """Write rows that have ``dt`` by day.

    One task writes one range of time, so a busy day is many files, and many sparse days are many tasks.
    """
    ranges = rows.repartitionByRange("dt", "ts_us").sortWithinPartitions("dt", "ts_us")
    with _small_ranges(rows.sparkSession):
        ranges.write.mode(mode).partitionBy("dt").options(**(options or {})).parquet(path)


def append(df: DataFrame, table: str, path: str, mode: str = "append") -> None:
    """Append rows, or with mode ``overwrite`` replace those under the path."""
    options = {f"parquet.bloom.filter.enabled#{name}": "true" for name in INDEXED.get(table, [])}
    write_days(to_table(df, table), path, mode, {**options, "parquet.bloom.filter.adaptive.enabled": "true"})


def sink_packets(packets: DataFrame, path: str, mode: str = "append") -> None:
    append(packets, "packets", path, mode)


def sink_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    append(alerts, "alerts", path, mode)


def sink_mitre(hits: DataFrame, path: str, mode: str = "append") -> None:
    append(hits, "mitre_events", path, mode)


def sink_geo(geo: DataFrame, path: str, mode: str = "append") -> None:
    """Append geo rows: one packet each, without the city."""
    append(geo.drop("city", "pkt_count"), "geo_traffic", path, mode)


def geo_rows(placed: DataFrame) -> DataFrame:
    """Placed packets as rows of the geo table: one packet each, without the city."""
    return to_table(placed.drop("city", "pkt_count"), "geo_traffic")


def stream_to(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream of table rows, exactly once per row."""
    return (
        rows.writeStream.format("parquet").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
    )


def stream_packets_to(packets: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a packet stream, exactly once per packet."""
    return stream_to(to_table(packets, "packets"), path, checkpoint)


def ack_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts as they read after the acknowledgements; the acks are an append-only table."""
    return ack_overlay(alerts, acks)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
