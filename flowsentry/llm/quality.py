"""A quality classifier: a regularised quadratic discriminant over document statistics.

Each document gives a fixed vector of transformed statistics (logarithms of lengths, arcsine roots of
shares). Per class the mean and covariance come from sums over all labelled rows; the covariance is
shrunk towards its diagonal and a small multiple of the pooled one. A score is the logistic of the
difference of the log densities, each a Mahalanobis distance through the class's Cholesky factor, which
is computed once and sent along. Labels, languages, sources and ids are no inputs.

Null texts count as empty and get the score of an empty text's statistics; long texts are read whole.
Equal texts get equal scores; an empty table gives an empty result; other columns are not read. A document
with several labels counts once for each. If a class has no labelled rows there is nothing to learn:
``fit`` raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import words
from flowsentry.llm.common import buffers, short_batches

# Fixed order of the statistics.
STATISTICS = [
    "log_words",
    "log_word_length",
    "upper_share",
    "digit_share",
    "stop_share",
    "mark_share",
    "high_share",
    "distinct_words",
    "doubled_words",
    "log_line_words",
    "distinct_lines",
    "top_word",
    "short_words",
    "ended_lines",
    "distinct_shingles",
    "symbol_words",
]
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _share(part, whole):
    """Arcsine root of a share, which spreads the ends."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def _runs(values: np.ndarray) -> tuple[int, int]:
    """Distinct values and the count of the most frequent one."""
    if not len(values):
        return 0, 0
    ordered = np.sort(values)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
    return len(edges) - 1, int(np.diff(edges).max())


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per document."""
    n = len(offsets) - 1
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    gap = words.is_space(data)
    stop = STOPS[data]
    mark = ~(upper | lower | digit | high | gap | stop)

    def total(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    solid = total(~gap)
    starts, ends = words.spans(offsets, data, gap)
    hashes = words.span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # word range of each document
    count = np.diff(first)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][count > 0]] = False
    short = (ends - starts) <= 3
    plain = np.concatenate([[0], np.cumsum(upper | lower | digit | high, dtype=np.int64)])
    symbol = plain[ends] == plain[starts]

    def words_total(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[first[1:]] - sums[first[:-1]]

    line_starts, line_ends = words.spans(offsets, data, data == 10)
    line_hashes = words.span_hashes(data, line_starts, line_ends)
    line_first = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_first)
    ended = STOPS[data[line_ends - 1]] if len(line_ends) else np.zeros(0, bool)
    ended_sums = np.concatenate([[0], np.cumsum(ended, dtype=np.int64)])
    distinct, top, line_distinct, shingle_share = (np.zeros(n) for _ in range(4))
    for i in range(n):
        own = hashes[first[i] : first[i + 1]]
        distinct[i], top[i] = _runs(own)
        line_distinct[i] = _runs(line_hashes[line_first[i] : line_first[i + 1]])[0]
        shingle_share[i] = len(words.shingles(own)) / max(1, len(own) - words.SHINGLE + 1)
    return np.column_stack(
        [
            np.log1p(count),
            np.log1p(solid / np.maximum(count, 1)),
            _share(total(upper), solid),
            _share(total(digit), solid),
            _share(total(stop), solid),
            _share(total(mark), solid),
            _share(total(high), solid),
            _share(distinct, count),
            _share(words_total(same), count),
            np.log1p(count / np.maximum(lines, 1)),
            _share(line_distinct, lines),
            _share(top, count),
            _share(words_total(short), count),
            _share(ended_sums[line_first[1:]] - ended_sums[line_first[:-1]], lines),
            _share(shingle_share, 1),
            _share(words_total(symbol), count),
        ]
    )


def with_statistics(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, stats`` for each row."""
    import pyarrow as pa

    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = statistics(*buffers(batch.column(1)))
            lists = pa.ListArray.from_arrays(
                np.arange(len(made) + 1, dtype=np.int32) * len(STATISTICS), pa.array(made.ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "stats"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(df[doc_id], df[text]).mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the shrunk covariance, half its log determinant."""

    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    half_logs: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for k in range(2):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            logs.append(self.priors[k] - self.half_logs[k] - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


@dataclass
class Share:
    """Without labelled rows of both classes: the share of label 1 among those there are, one half without any."""

    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def discriminant(sums: list[tuple[float, np.ndarray, np.ndarray]], shrink: float, pooled: float) -> Discriminant:
    """From each class's count, sum and sum of outer products."""
    counts = np.array([count for count, _, _ in sums])
    if (counts < 1).any():
        raise ValueError("each class needs labelled rows")
    means = np.array([total / count for count, total, _ in sums])
    spreads = [outer / count - np.outer(mean, mean) for (count, _, outer), mean in zip(sums, means)]
    common = sum(count * spread for count, spread in zip(counts, spreads)) / counts.sum()
    factors, half_logs = [], []
    for spread in spreads:
        mixed = (1 - pooled) * spread + pooled * common
        shrunk = (1 - shrink) * mixed + shrink * np.diag(np.diag(mixed))
        factor = np.linalg.cholesky(shrunk + 1e-4 * np.eye(len(shrunk)))
        factors.append(factor)
        half_logs.append(np.log(np.diag(factor)).sum())
    return Discriminant(np.log(counts / counts.sum()), means, np.array(factors), np.array(half_logs))


def fit(stats: DataFrame, label: str = "label", shrink: float = 0.002, pooled: float = 0.3) -> Discriminant | Share:
    """Learn from ``stats`` and a 0/1 ``label``; the sums of all rows are made by Spark.

    Empty tables, and labels of one class only, give a constant score.
    """
    d = len(STATISTICS)
    rows = stats.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("k"), "stats")
    pair = F.flatten(F.transform("stats", lambda a: F.transform("stats", lambda b: a * b)))
    parts = rows.select("k", F.posexplode(F.concat(F.array(F.lit(1.0)), "stats", pair)).alias("i", "v"))
    sums = np.zeros((2, 1 + d + d * d))
    for k, i, v in parts.groupBy("k", "i").agg(F.sum("v")).collect():  # 2 x 273 numbers, however many rows
        sums[k, i] = v
    if (sums[:, 0] < 1).any():
        return Share(float(sums[1, 0] / sums[:, 0].sum()) if sums[:, 0].any() else 0.5)
    return discriminant([(s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for s in sums], shrink, pooled)


def score(stats: DataFrame, model: Discriminant | Share, temper: float = 1.0) -> DataFrame:
    """``doc_id, score`` with ``score`` in [0, 1]."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            p = np.clip(model.scores(x), 1e-12, 1 - 1e-12)
            made = 1 / (1 + ((1 - p) / p) ** (1 / temper))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
