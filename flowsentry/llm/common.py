"""What the operators share: table reads, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import ensure_checkpoint_dir

# Rows of an Arrow batch sent to a Python worker. Documents are a few KB each and some far longer, so
# batches are kept short; the bytes limit of the session still holds.
ARROW_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write and read back, so that later steps neither repeat the work nor depend on lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(text: Column | str) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def size_of(text: Column | str) -> Column:
    return F.octet_length(utf8(text)).cast("long")


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of an Arrow string or binary column; nulls are empty.

    The bytes of row ``i`` are ``data[offsets[i]:offsets[i + 1]]``; offsets start at 0.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, starts, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(starts, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for tables built once per worker."""
    import sys
    import types

    return sys.modules.setdefault("_flowsentry_llm_cache", types.ModuleType("cache")).__dict__
