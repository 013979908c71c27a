"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the budget divided by its own size. Each
document draws a uniform number from a seeded hash of its id; inverting the Poisson distribution of its
source's rate at that number gives its count. Documents are exploded by their counts and the copies are
shuffled globally by a seeded hash.

Sizes are UTF-8 bytes plus 1, so empty texts count too; a null text is empty, a null source is a source of
its own. Rows with one id and source draw the same count. An empty table gives an empty result.
Columns may have any names; ``_mix`` prefixed ones are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import settle, size_of

# Up to this many sources the table of rates is broadcast (a few hundred bytes a source); beyond, a join
# shuffles, which adaptive execution splits where a source is hot.
BROADCAST_SOURCES = 10_000


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a seeded MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(part.cast("string"), F.lit("null")) for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(
    df: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``_mix_key, _mix_rate``: the mean repetition rate of each source.

    The budget is ``epochs`` times the bytes of ``df``. Without ``weights`` a source's weight is its size
    to the power ``temperature``; sources that ``weights`` leaves out or gives 0 get none, also if all are 0.
    """
    sizes = df.select(_key(df[source]).alias("_mix_key"), (size_of(df[text]) + 1).alias("_b")).groupBy("_mix_key").agg(
        F.sum("_b").cast("double").alias("_bytes")
    )
    if weights is None:
        weighted = sizes.withColumn("_w", F.pow("_bytes", F.lit(temperature)))
    else:
        given = df.sparkSession.createDataFrame(
            [("null" if name is None else f"={name}", float(value)) for name, value in weights.items()],
            "_mix_key string, _w double",
        )
        weighted = sizes.join(given, "_mix_key")
    whole = Window.partitionBy(F.lit(1))  # one row a source
    given_weight = F.nullif(F.sum("_w").over(whole), F.lit(0.0))
    total = sizes.agg(F.sum("_bytes").alias("_total"))
    return weighted.join(F.broadcast(total)).select(
        "_mix_key",
        F.coalesce(F.lit(epochs) * F.col("_total") * F.col("_w") / given_weight / F.col("_bytes"), F.lit(0.0)).alias("_mix_rate"),
    )


def thresholds(rate: DataFrame) -> DataFrame:
    """``_mix_key, _mix_cdf``: the Poisson distribution function of each rate, until it is 1 for doubles."""
    top = F.ceil(F.col("_mix_rate") + 12 * F.sqrt("_mix_rate") + 30)
    steps = rate.select("_mix_key", "_mix_rate", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("_k"))
    upto = Window.partitionBy("_mix_key").orderBy("_k")
    logs = steps.withColumn(
        "_log",
        F.col("_k") * F.log("_mix_rate") - F.col("_mix_rate") - F.sum(F.log(F.greatest(F.col("_k"), F.lit(1)).cast("double"))).over(upto),
    )
    sums = logs.withColumn("_cdf", F.sum(F.exp("_log")).over(upto))
    return sums.groupBy("_mix_key").agg(F.sort_array(F.collect_list("_cdf")).alias("_mix_cdf"))


def mix(
    df: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 0,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The copies in shuffled order: the columns of ``df``, ``_mix_copy`` (from 1) and ``_mix_order``."""
    table = settle(thresholds(rates(df, weights, temperature, epochs, source, text)), "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    drawn = df.withColumn("_mix_key", _key(df[source])).join(table, "_mix_key")
    mark = uniform(seed, F.col(doc_id))
    counted = drawn.withColumn("_mix_u", mark).withColumn(
        "_mix_n", F.size(F.filter("_mix_cdf", lambda step: step <= F.col("_mix_u")))
    )
    copies = (
        counted.where("_mix_n > 0")
        .drop("_mix_key", "_mix_cdf", "_mix_u")
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
        .drop("_mix_n")
        .withColumn("_mix_order", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("_mix_copy").cast("string"))))
    )
    # Partitions by hash and order by hash within: read in order, that is a random permutation.
    return copies.repartition("_mix_order").sortWithinPartitions("_mix_order")
