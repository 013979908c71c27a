"""The live job: all rules over one packet stream, committed to several tables at once.

There are two forms. ``live_writer`` takes the findings of the streaming rules, whose state is kept by Spark: a finding comes
with its micro-batch, and all rows that a source has in a micro-batch meet in one task. ``runs_writer`` takes the packets
and makes each micro-batch a run of the batch rules that goes on from the one before: a finding comes when the delay has
passed, and a source with half of all rows spreads over the tasks, as in batch.

A micro-batch writes its findings, alerts and technique hits to folders of its own, one attempt each, and last of all a
commit that names the attempt. Readers take committed attempts only, so they see all tables of a micro-batch or none, also
when the writer dies between two of them; the replay writes a new attempt. A micro-batch that is replayed after its
commit writes nothing. Batches are told apart by the query's id, so a new checkpoint does not touch what others wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from flowsentry import schemas
from flowsentry.functions.scalar import MICROS, timestamp_of
from flowsentry.operators import carry, detect, rollups as batch_rollups
from flowsentry.operators.alerts import build_alerts, build_mitre_events
from flowsentry.operators.pruning import settle
from flowsentry.sources import tables
from flowsentry.sources.tables import to_table, write_days
from flowsentry.streaming import rollups, state
from flowsentry.streaming.jobs import consume

_ATTEMPT = T.StructType(
    [T.StructField("query", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())]
)


def stream_findings(packets: DataFrame, watermark_seconds: int = 60) -> DataFrame:
    """The findings of all rules; those on payloads take part if the packets carry them."""
    parts = [
        rollups.stream_row_rules(packets),
        state.stream_source_rules(packets, watermark_seconds),
        state.stream_port_scan(packets),
    ]
    if set(detect.PAYLOAD_COLUMNS) <= set(packets.columns):
        parts += [detect.payload_row_rules(packets), rollups.stream_minute_rules(packets)]
    return detect.union_findings(*parts)


def _place(spark: SparkSession, batch_id: int) -> str:
    return f"query={spark.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={batch_id}"


def _is_committed(spark: SparkSession, root: str, place: str) -> bool:
    return tables.exists(spark, f"{root}/commits/{place}/_SUCCESS")


def _commit(spark: SparkSession, root: str, place: str, attempt: str) -> None:
    commit = spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
    commit.write.mode("overwrite").parquet(f"{root}/commits/{place}")


def _tables(findings: DataFrame) -> dict[str, DataFrame]:
    return {
        "findings": findings.select(*detect.FINDING_COLUMNS).withColumn("dt", F.to_date(timestamp_of())),
        "alerts": to_table(build_alerts(findings), "alerts"),
        "mitre_events": to_table(build_mitre_events(findings), "mitre_events"),
    }


def _write(rows: DataFrame, path: str) -> None:
    """One task writes one range of time: a day is a file or a few, however many tasks the rows come from."""
    write_days(rows, path)


def live_writer(findings: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Findings, alerts and technique hits of a finding stream under ``root``, committed together per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place, attempt = _place(spark, batch_id), uuid.uuid4().hex
        if _is_committed(spark, root, place):
            consume(batch)
            return
        batch = batch.persist()
        try:
            for table, rows in _tables(batch).items():
                _write(rows, f"{root}/{table}/{place}/attempt={attempt}")
        finally:
            batch.unpersist()
        _commit(spark, root, place, attempt)

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _latest(packets: DataFrame) -> int | None:
    return packets.agg(F.max("ts_us")).first()[0]


def runs_writer(
    packets: DataFrame, root: str, checkpoint: str, delay_seconds: int = 60, port_idle_seconds: int | None = None
) -> DataStreamWriter:
    """Packets, findings, alerts, technique hits and connection parts of a packet stream, committed together per micro-batch.

    A micro-batch takes the packets that are older than the newest one by more than the delay, with those that waited, and
    runs all rules over them from the state of the micro-batch before; younger ones wait. Packets that come later than the
    delay allows are left out, as by a watermark. State and waiting packets are tables of the commit; those of the commit
    before the last are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place, attempt = _place(spark, batch_id), uuid.uuid4().hex
        if _is_committed(spark, root, place):
            return
        before = _place(spark, batch_id - 1)
        held = f"{before}/attempt={_attempt_of(spark, root, before)}" if batch_id else None
        entry = carry.read(spark, f"{root}/state", held) if held else None
        here = f"{place}/attempt={attempt}"

        rows = to_table(batch, "packets").drop("dt")
        if entry is not None:
            waited = spark.read.schema(schemas.PACKETS).parquet(f"{root}/state/waiting/{held}")
            rows = rows.where(F.col("ts_us") > entry.border_us).unionByName(waited)
        arrived = f"{root}/state/arrived/{here}"
        rows.write.parquet(arrived)  # the source is read once
        rows = spark.read.schema(schemas.PACKETS).parquet(arrived)
        newest = _latest(rows)
        border_us = max(-1 if newest is None else newest - delay_seconds * MICROS, entry.border_us if entry else -1)
        rows.where(F.col("ts_us") > border_us).write.parquet(f"{root}/state/waiting/{here}")
        tables.sink_packets(rows.where(F.col("ts_us") <= border_us), f"{root}/packets/{here}")
        due = tables.scan_packets(spark, f"{root}/packets/{here}")

        run = detect.run_findings(due, entry, goes_on=True, until_us=border_us)
        found = settle(run.findings, broadcast_rows=-1)  # the writer's ranges take a sample, which would find them twice
        _write(_tables(found)["findings"], f"{root}/findings/{here}")
        findings = spark.read.schema(_columns("findings")).parquet(f"{root}/findings/{here}")
        for table in ("alerts", "mitre_events"):
            _write(_tables(findings)[table], f"{root}/{table}/{here}")
        parts = batch_rollups.connection_parts(due, entry and entry.connections)
        parts.write.parquet(f"{root}/connection_parts/{here}")
        parts = spark.read.parquet(f"{root}/connection_parts/{here}")
        carry.write(detect.leaves(run, batch_rollups.open_connections(parts, border_us), port_idle_seconds), f"{root}/state", here)
        _commit(spark, root, place, attempt)
        for name in [*carry.SCHEMAS, "waiting"] if batch_id else []:
            tables.remove(spark, f"{root}/state/{name}/{_place(spark, batch_id - 2)}")
        tables.remove(spark, arrived)

    return packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _attempt_of(spark: SparkSession, root: str, place: str) -> str:
    return spark.read.schema("attempt string").parquet(f"{root}/commits/{place}").first()[0]


def _columns(table: str) -> T.StructType:
    if table != "findings":
        return schemas.TABLES[table]
    kinds = {"pid": T.LongType(), "ts_us": T.LongType()}
    return T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in detect.FINDING_COLUMNS])


def _known(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Rows of committed attempts; the folders' columns prune the read."""
    commits = spark.read.schema(T.StructType([_ATTEMPT["attempt"], _ATTEMPT["query"], _ATTEMPT["batch"]])).parquet(f"{root}/commits")
    return rows.join(commits, _ATTEMPT.names, "left_semi").drop(*_ATTEMPT.names)


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the live job, as the commits know it."""
    fields = [*_columns(table).fields, *_ATTEMPT.fields, T.StructField("dt", T.DateType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(f"{root}/{table}")
    return _known(spark, root, rows).withColumn("ts", timestamp_of())


def read_committed_parts(spark: SparkSession, root: str) -> DataFrame:
    """The connection parts of committed runs, for ``rollups.merged_connections``."""
    return _known(spark, root, spark.read.parquet(f"{root}/connection_parts"))
