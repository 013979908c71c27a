"""Exact dedup by a content sort.

Rows are range-partitioned by their normalised text with sampled splitters and sorted externally, so
equal texts lie next to each other; neighbours are compared in full and one row of each run stays.

The range key is (first 128 characters, SHA-256, salt): splitters then have a bounded size however long
the texts are, and texts that only share their beginning still spread. The comparison itself is over the
whole text. A text that holds more than 1/256 of all rows (at most 255 such texts exist, so their table
is safe to broadcast) is salted over several ranges, and the salted parts are merged afterwards.

Null texts count as empty. Equal rows are a group like any other: one of them stays. A null id loses
against any other id. An empty table gives an empty result. Other columns, whatever their names, are
carried along by ``keep_one`` and ignored by ``groups``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import settle, utf8

HOT_SHARE = 256
SALTS = 64
HEAD = 128


def unchanged(text: Column) -> Column:
    """The normalisation that leaves texts as they are."""
    return text


def _digest(df: DataFrame, text: str, normalise: Callable[[Column], Column]) -> Column:
    return F.sha2(normalise(utf8(df[text])).cast("binary"), 256)


def _sorted_runs(
    df: DataFrame,
    text: str,
    doc_id: str,
    keep: str,
    normalise: Callable[[Column], Column],
    carry: list[str],
) -> DataFrame:
    """Per row the id, digest, run and place in it; ``_row`` holds the carried columns, ``_text`` the sorted text."""
    digest = _digest(df, text, normalise)
    total = df.count()
    counts = df.select(digest.alias("_sha")).groupBy("_sha").count()
    frequent = counts.where(F.col("count") > max(total // HOT_SHARE, 1000))
    hot = F.broadcast(settle(frequent.select("_sha", F.lit(True).alias("_hot")), "hot"))
    rows = df.select(
        df[doc_id].alias("_id"),
        F.struct(*[df[name] for name in carry]).alias("_row") if carry else F.lit(None).cast("string").alias("_row"),
        normalise(utf8(df[text])).alias("_text"),
        digest.alias("_sha"),
    ).join(hot, "_sha", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ranged = rows.select(
        "_id", "_row", "_text", "_sha", "_hot", salt.alias("_salt"), F.substring("_text", 1, HEAD).alias("_head")
    ).repartitionByRange("_head", "_sha", "_salt")
    run = Window.partitionBy("_head", "_sha", "_salt", "_text")
    order = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    first = run.orderBy(order)
    parts = ranged.select(
        "_id",
        "_row",
        "_sha",
        "_hot",
        "_salt",
        F.first("_id").over(first).alias("_keep"),
        F.row_number().over(first).alias("_place"),
        F.count(F.lit(1)).over(run).alias("_n"),
        *(["_text"] if carry else []),
    )
    # The salted parts of at most 255 hot texts, from ids and digests alone: a few thousand rows.
    best = F.max if keep == "largest" else F.min
    salted = rows.where("_hot").select("_sha", salt.alias("_salt"), "_id").groupBy("_sha", "_salt").agg(
        best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    of_text = Window.partitionBy("_sha")
    by_keep = F.col("_keep").desc_nulls_last() if keep == "largest" else F.col("_keep").asc_nulls_last()
    leaders = salted.select(
        "_sha",
        "_salt",
        F.row_number().over(of_text.orderBy(by_keep, "_salt")).alias("_best"),
        F.sum("_n").over(of_text).alias("_all"),
        best("_keep").over(of_text).alias("_first"),
    )
    return parts.join(F.broadcast(leaders), ["_sha", "_salt"], "left")


def groups(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: str = "largest",
    normalise: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    found = _sorted_runs(df, text, doc_id, keep, normalise, [])
    hot = F.col("_all").isNotNull()
    return found.select(
        F.col("_id").alias("doc_id"),
        F.when(hot, F.col("_first")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(hot, F.col("_all")).otherwise(F.col("_n")).cast("long").alias("group_size"),
        ((F.col("_place") == 1) & (~hot | (F.col("_best") == 1))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: str = "largest",
    normalise: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    if normalise is unchanged:  # the sorted text is the text itself, which so is shuffled once
        marked = df.withColumn("_is_null", df[text].isNull())
        found = _sorted_runs(marked, text, doc_id, keep, normalise, [c for c in marked.columns if c != text])
        whole = F.when(~F.col("_row._is_null"), F.col("_text"))
    else:
        found = _sorted_runs(df, text, doc_id, keep, normalise, df.columns)
        whole = F.col("_row")[text]
    stays = (F.col("_place") == 1) & F.coalesce(F.col("_best") == 1, F.lit(True))
    columns = [(whole if name == text else F.col("_row")[name]).alias(name) for name in df.columns]
    return found.where(stays).select(*columns)
