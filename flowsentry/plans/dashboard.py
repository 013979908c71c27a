"""The dashboard reads over the tables under one folder, one method per report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry import schemas
from flowsentry.operators import alerts as alerting, filters, lookups, rollups, stats
from flowsentry.plans.batch_job import ACKS, connections
from flowsentry.sources import tables


class Dashboard:
    """Reports as of a fixed time, so that a report can be repeated.

    Acknowledgements are read from the table under the folder, if there is one, or given as ``acks``. Totals per protocol and
    source come from rollups that the batch job keeps, newest rows from the last days; no report reads all packets.
    """

    def __init__(self, spark: SparkSession, root: str, as_of_us: int, acks: DataFrame | None = None):
        self.spark = spark
        self.root = root
        self.as_of_us = as_of_us
        if acks is None and tables.exists(spark, f"{root}/acks"):
            acks = spark.read.schema(ACKS).parquet(f"{root}/acks")
        self.acks = acks

    def _scan(self, table: str) -> DataFrame:
        return tables.scan(self.spark, table, f"{self.root}/{table}").drop("run")

    def _days(self, table: str) -> list[date]:
        return tables.days(self.spark, f"{self.root}/{table}")

    def protocol_stats(self) -> DataFrame:
        """The rollup with one row per minute and protocol, also where runs share a minute."""
        stored = self.spark.read.schema(schemas.PROTOCOL_STATS).parquet(f"{self.root}/protocol_stats")
        return rollups.merged_protocol_stats(stored)

    def source_stats(self) -> DataFrame:
        """The rollup with one row per day and source and run."""
        return self.spark.read.schema(schemas.SOURCE_STATS).parquet(f"{self.root}/source_stats")

    def alerts(self) -> DataFrame:
        alerts = self._scan("alerts")
        return alerts if self.acks is None else lookups.ack_overlay(alerts, self.acks)

    def threats(self) -> DataFrame:
        """One row per source and threat type, also where several runs saw it."""
        return alerting.merged_threats(self.spark.read.schema(schemas.THREATS).parquet(f"{self.root}/threats"))

    def overview(self) -> DataFrame:
        return stats.overview_stats(
            self._scan("packets"),
            self.alerts(),
            self.threats(),
            self._scan("mitre_events"),
            self._perf(),
            self.as_of_us,
            self.protocol_stats(),
        )

    def _perf(self) -> DataFrame:
        return rollups.merged_perf(self._scan("performance_metrics"))

    def packets_per_minute(self, minutes: int = 30) -> DataFrame:
        return stats.packets_per_minute(self._scan("packets"), self.as_of_us, minutes)

    def protocol_distribution(self) -> DataFrame:
        return stats.protocols_of_rollup(self.protocol_stats())

    def top_talkers(self, limit: int = 10) -> DataFrame:
        return stats.talkers_of_rollup(self.source_stats(), limit)

    def connections(self) -> DataFrame:
        return connections(self.spark, self.root)

    def geo_traffic(self) -> DataFrame:
        return stats.geo_traffic(self._scan("geo_traffic"))

    def threat_timeline(self, hours: int = 24) -> DataFrame:
        return stats.threat_timeline(self._scan("alerts"), self.as_of_us, hours)

    def severity_breakdown(self) -> DataFrame:
        return stats.severity_breakdown(self._scan("alerts"))

    def recent_alerts(self, limit: int = 50, severity: str | None = None) -> DataFrame:
        """The newest alerts; acknowledgements are laid over those rows only."""
        newest = filters.recent_alerts(self._scan("alerts"), limit, severity, self._days("alerts"))
        if self.acks is None:
            return newest
        return lookups.ack_overlay(newest, self.acks).orderBy(F.desc("ts_us"), F.desc("id"))

    def alerts_by_type(self) -> DataFrame:
        return stats.alerts_by_type(self._scan("alerts"))

    def alerts_hourly(self) -> DataFrame:
        return stats.alerts_hourly(self._scan("alerts"), self.as_of_us)

    def mitre_techniques(self) -> DataFrame:
        return stats.mitre_techniques(self._scan("mitre_events"))

    def mitre_heatmap(self) -> DataFrame:
        return stats.mitre_heatmap(self._scan("mitre_events"))

    def recent_events(self, limit: int = 100) -> DataFrame:
        return filters.recent_events(self._scan("packets"), limit, self._days("packets"))

    def search_events(self, **conditions) -> DataFrame:
        return filters.search_events(self._scan("packets"), days=self._days("packets"), **conditions)

    def performance(self) -> DataFrame:
        return filters.perf_history(self._perf())
