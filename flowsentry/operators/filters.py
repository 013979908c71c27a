"""Filters, row checks, projections and top-n."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scalar import MICROS, like_contains
from flowsentry.schemas import DEFAULTS, SEVERITIES, required_columns

RECENT_EVENT_COLUMNS = ["pid", "ts_us", "src_ip", "dst_ip", "protocol", "length", "is_malicious", "flags"]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def since(df: DataFrame, as_of_us: int, seconds: int) -> DataFrame:
    """Rows strictly younger than ``seconds`` before ``as_of_us``.

    On a table partitioned by ``dt`` the bound is repeated on ``dt``, so old partitions are
    never listed or opened.
    """
    cutoff = as_of_us - seconds * MICROS
    recent = df.where(F.col("ts_us") > cutoff)
    if "dt" in df.columns:
        recent = recent.where(F.col("dt") >= F.timestamp_micros(F.lit(cutoff)).cast("date"))
    return recent


def eq_filters(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values."""
    return df.where(all_of([F.col(name) == value for name, value in values.items()]))


# A page of results up to this long is gathered day by day.
PAGE = 10_000


def newest(df: DataFrame, limit: int, key: str, days: list[date] | None = None) -> DataFrame:
    """The latest rows, ties by descending key.

    ``days`` are those of a table partitioned by ``dt``, from a listing of its folders. A page of rows then comes from the last
    days that hold enough, one job if the last day does: the span doubles, and a day that was read is not read again.
    Without them, or beyond a page, it is a top-n over the table.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    order = [F.desc("ts_us"), F.desc(key)]
    if days is None or limit > PAGE:
        return df.orderBy(*order).limit(limit)
    found, end, span = [], len(days), 1
    while end and len(found) < limit:
        start = max(0, end - span)
        within = F.col("dt").between(F.lit(days[start]), F.lit(days[end - 1]))
        found += df.where(within).orderBy(*order).limit(limit - len(found)).collect()
        end, span = start, 2 * span
    return df.sparkSession.createDataFrame(found, df.schema)


def top_k(df: DataFrame, measure: str, k: int, keys: list[str]) -> DataFrame:
    """The rows with the largest measure, ties by ascending keys."""
    if k < 0:
        raise ValueError("limit must not be negative")
    return df.orderBy(F.desc(measure), *keys).limit(k)


def bucket_order(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy("bucket", *more)


def search_events(
    packets: DataFrame,
    query: str = "",
    protocol: str = "",
    src_ip: str = "",
    dst_ip: str = "",
    limit: int = 100,
    days: list[date] | None = None,
) -> DataFrame:
    """Newest packets that meet every given condition; empty conditions are left out.

    ``query`` looks for the text in the addresses, the protocol and the flags (our semantics).
    """
    conditions = []
    if protocol:
        conditions.append(F.col("protocol") == protocol)
    if src_ip:
        conditions.append(like_contains("src_ip", src_ip))
    if dst_ip:
        conditions.append(like_contains("dst_ip", dst_ip))
    if query:
        columns = ["src_ip", "dst_ip", "protocol", "flags"]
        hits = [F.coalesce(like_contains(name, query), F.lit(False)) for name in columns]
        conditions.append(reduce(lambda left, right: left | right, hits))
    return newest(packets.where(all_of(conditions)), limit, "pid", days)


def recent_alerts(
    alerts: DataFrame, limit: int = 50, severity: str | None = None, days: list[date] | None = None
) -> DataFrame:
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    return newest(alerts, limit, "id", days)


def project_recent(packets: DataFrame) -> DataFrame:
    return packets.select(*RECENT_EVENT_COLUMNS)


def recent_events(packets: DataFrame, limit: int = 100, days: list[date] | None = None) -> DataFrame:
    return newest(project_recent(packets) if days is None else packets.select(*RECENT_EVENT_COLUMNS, "dt"), limit, "pid", days).select(
        *RECENT_EVENT_COLUMNS
    )


def perf_history(performance: DataFrame, limit: int = 60) -> DataFrame:
    return newest(performance, limit, "id")


def split_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others (quarantine)."""
    known = F.coalesce(condition, F.lit(False))
    return df.where(known), df.where(~known)


def split_not_null(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split by the NOT NULL columns of a table that the DataFrame has."""
    names = [name for name in required_columns(table) if name in df.columns]
    return split_rows(df, all_of([F.col(name).isNotNull() for name in names]))


def valid_severity(severity="severity") -> Column:
    column = F.col(severity) if isinstance(severity, str) else severity
    return column.isin(SEVERITIES)


def split_valid_severity(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rows(alerts, valid_severity())


def column_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the columns that have a default."""
    defaults = {name: value for name, value in DEFAULTS[table].items() if name in df.columns}
    return df.na.fill(defaults) if defaults else df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
