"""Streaming queries: start, sinks, and runs over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from flowsentry.operators.alerts import build_alerts, build_mitre_events
from flowsentry.sources import tables
from flowsentry.sources.tables import to_table


def alert_writer(findings: DataFrame, alerts_path: str, mitre_path: str, checkpoint: str) -> DataStreamWriter:
    """Alerts and technique hits of a finding stream, written together per micro-batch.

    Every micro-batch has its own folder under that of the query, so a replayed batch replaces what it wrote
    before, and a query with a new checkpoint, whose batches count from 0 again, erases nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()
        try:
            for table, rows, path in (
                ("alerts", build_alerts(batch), alerts_path),
                ("mitre_events", build_mitre_events(batch), mitre_path),
            ):
                to_table(rows, table).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/query={query}/batch={batch_id}")
        finally:
            batch.unpersist()

    return findings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def consume(batch: DataFrame) -> None:
    """Compute a micro-batch without a result: state stores want all of it computed, also on a replay that writes nothing."""
    batch.write.format("noop").mode("overwrite").save()


def rollup_writer(rollup: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataStreamWriter:
    """A rollup in update mode with one row per key at rest, partitioned by the day of its ``bucket``.

    A micro-batch replaces the rows it changed by rewriting the days they are in. The new days are written aside first, so
    that a replay after a crash in the middle takes them from there; a query with a new checkpoint ends at the same table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        staged = f"{path}-staged/{query}/{batch_id}"
        if tables.exists(spark, f"{staged}/_SUCCESS"):
            consume(batch)
        else:
            changed = batch.withColumn("dt", F.to_date(F.timestamp_seconds("bucket"))).persist()
            try:
                touched = [row["dt"] for row in changed.select("dt").distinct().collect()]
                rows = changed
                if touched and tables.exists(spark, path):
                    stored = spark.read.schema(changed.schema).parquet(path).where(F.col("dt").isin(touched))
                    rows = stored.join(changed.select(*keys), keys, "left_anti").unionByName(changed)
                rows.repartition("dt").write.mode("overwrite").parquet(staged)
            finally:
                changed.unpersist()
        merged = spark.read.schema(batch.withColumn("dt", F.current_date()).schema).parquet(staged)
        writer = merged.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("dt").parquet(path)
        tables.remove(spark, staged)

    return rollup.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``rollup_writer``."""
    return spark.read.parquet(path).drop("dt")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source holds now, and read back the table it wrote."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
