"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash into buckets inside their shard; in the order of the hash a bucket is
cut wherever another ``bucket_bytes`` are full, so it holds no more than that besides its last record. Pass two collects
each bucket, applies a seeded Fisher-Yates shuffle (``shuffle``) to it and numbers its records behind those of the
buckets before it. Spark collects up to 128 buckets of a task side by side before it sorts instead.

Law ``key``: the shard follows from the key and the number of shards alone, by the highest of one seeded
hash per shard. With one more shard only rows whose highest hash belongs to the new shard move, all into it.

A null key is a key of its own. Rows that are equal in every column and together fill a good part of a bucket are counted
before the scatter and numbered, so that even a third of all rows being one row spreads over the buckets (all within the
shard that the key gives). An empty table gives an empty result. Columns may have any names; the added ones are
``shard``, ``slot`` and ``grown_shard``, and a clash with them is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType

from flowsentry.llm.common import size_of, utf8

BUCKET_ROWS = 20_000
BUCKET_BYTES = 1 << 21
# Repeated rows are joined by a broadcast up to this number of different ones.
BROADCAST = 10_000
ADDED = ("shard", "slot", "grown_shard")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash of the key."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(n), key).alias("h"), F.lit(n).alias("n")) for n in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["n"]


def bytes_of(df: DataFrame) -> Column:
    """About the bytes of a record."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            total += F.coalesce(F.octet_length(df[field.name]), F.lit(0))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            total += F.coalesce(F.octet_length(F.to_json(df[field.name])), F.lit(0))
    return total


def _spread(df: DataFrame, record: Column, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """``_r, _size, _copy``, rows and bytes; rows that are repeated often enough to crowd a bucket are numbered."""
    sized = df.select(record.alias("_r"), bytes_of(df).alias("_size")).withColumn("_id", F.xxhash64("_r"))
    each = sized.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"))
    crowded = (F.col("_n") > 1) & (F.col("_bytes") > bucket_bytes // 8)
    rows, total, hot = each.agg(F.sum("_n"), F.sum("_bytes"), F.count(F.when(crowded, 1))).first()
    if not hot:
        return sized.select("_r", "_size", F.lit(1).cast("long").alias("_copy")), rows or 0, total or 0
    ids = each.where(crowded).select("_id")
    ids = F.broadcast(ids) if hot <= BROADCAST else ids
    single = sized.join(ids, "_id", "left_anti").select("_r", "_size", F.lit(1).cast("long").alias("_copy"))
    counted = sized.join(ids, "_id", "left_semi").groupBy("_r", "_size").agg(F.count(F.lit(1)).alias("_n"))
    numbered = counted.select("_r", "_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    return single.unionByName(numbered), rows, total


def cut_buckets(placed: DataFrame, bucket_bytes: int) -> DataFrame:
    """``placed`` with ``_part``, the piece of the bucket by bytes, and ``_row``, the place in the bucket.

    In the order of the hash; rows of equal hash are equal, so any order of theirs will do.
    """
    order = Window.partitionBy("shard", "_bucket").orderBy("_h", "_copy")
    along = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.select("*", F.row_number().over(order).alias("_row"), F.sum("_size").over(along).alias("_upto"))
    return numbered.withColumn("_part", F.floor((F.col("_upto") - F.col("_size")) / F.lit(bucket_bytes)))


def scatter(
    df: DataFrame,
    key: str = "doc_id",
    shards: int = 8,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one more shard) and ``slot`` (gapless from 0 in the shard)."""
    if clash := set(ADDED) & set(df.columns):
        raise ValueError(f"rename {sorted(clash)} first")
    names = df.columns
    spread, rows, total = _spread(df, F.struct(*[df[name] for name in names]), bucket_bytes)
    buckets = max(1, -(-rows // (shards * bucket_rows)), -(-total // (shards * bucket_bytes)))
    placed = spread.select(
        shard_of(F.col("_r")[key], shards, seed).alias("shard"),
        shard_of(F.col("_r")[key], shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed), F.col("_r"), F.col("_copy")).alias("_h"),
        "_r",
        "_copy",
        "_size",
    ).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets)))
    place = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(
        "shard", "_bucket", F.coalesce(F.sum("_rows").over(place), F.lit(0)).alias("_from")
    )
    # Sorted first, so that the shuffle starts from the same order whenever a task is repeated.
    held = cut_buckets(placed, bucket_bytes).groupBy("shard", "_bucket", "_part").agg(
        F.sort_array(F.collect_list(F.struct("_h", "_copy", "grown_shard", "_r"))).alias("_held"),
        F.min("_row").alias("_first"),
    )
    mixed = held.sortWithinPartitions("shard", "_bucket", "_part").withColumn("_held", F.shuffle("_held", seed))
    return (
        mixed.join(offsets, ["shard", "_bucket"])
        .select("shard", (F.col("_from") + F.col("_first") - 1).alias("_from"), F.posexplode("_held").alias("_place", "_x"))
        .select(
            *[F.col("_x._r")[name].alias(name) for name in names],
            "shard",
            (F.col("_from") + F.col("_place")).alias("slot"),
            F.col("_x.grown_shard").alias("grown_shard"),
        )
    )


def write_shards(
    df: DataFrame,
    path: str,
    key: str = "doc_id",
    shards: int = 8,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
) -> None:
    """Write whole records to ``path/shard=N``, each file in slot order."""
    placed = scatter(df, key, shards, seed, bucket_rows, bucket_bytes)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(df: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` wrote of ``df``."""
    added = [StructField("slot", LongType()), StructField("grown_shard", IntegerType()), StructField("shard", IntegerType())]
    return df.sparkSession.read.schema(StructType([*df.schema.fields, *added])).parquet(path)


def manifest(df: DataFrame, text: str = "text", doc_id: str = "doc_id", *others: str) -> DataFrame:
    """``doc_id, size, text_crc32`` of each document, and the other columns named."""
    return df.select(
        df[doc_id].alias("doc_id"),
        (size_of(df[text]) + 1).alias("size"),
        F.crc32(utf8(df[text]).cast("binary")).alias("text_crc32"),
        *others,
    )
