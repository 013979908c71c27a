"""Whitening of embeddings: exact sums and a centred covariance by Spark, its leading eigenvectors, a broadcast projection.

The driver only ever holds numbers of the table's width: the sums, the covariance and the components.

A row takes part if its vector is not null and holds no null and no value that is not finite; its id may be null or occur
several times. Shorter vectors count as followed by zeros up to the longest one. Components beyond 2^62 / 64 are cut to
that bound, deviations to the range of a long. Directions without variance cannot be whitened: a component whose eigenvalue is
not above ``d`` rounding errors of the trace is left out, so a table of equal vectors, like an empty one, gives no rows.
Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm import eigen

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
SLICE = 1024  # vectors that a worker handles at once
LIMIT = float(1 << 62)
HALF = 31  # sums are kept in two halves, so that none overflows


class Fit(NamedTuple):
    n: int
    sums: list[int]
    centre: np.ndarray  # the rounded means, integers
    rest: np.ndarray  # what the means have besides
    axes: np.ndarray  # unit components, one a column
    values: np.ndarray
    trace: float


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``_id, _vector`` of the rows that take part."""
    vector = df[embedding].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(df[embedding].isNotNull() & finite).select(df[vec_id].alias("_id"), vector.alias("_vector"))


def _integers(lists, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The integers of an Arrow list column, zeros of the vectors included, and the vectors' sizes."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.full((len(sizes), width), SHIFT, np.int64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT - 1024).astype(np.int64) + SHIFT
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out, sizes


def _slices(batches, rows: int = SLICE):
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension; a task sends one row a dimension."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low, held = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _slices(batches):
            x, sizes = _integers(batch.column(0))
            more = max(0, x.shape[1] - len(high))
            high, low, held = (np.append(a, np.zeros(more, np.int64)) for a in (high, low, held))
            there = np.arange(x.shape[1]) < sizes[:, None]
            high[: x.shape[1]] += np.where(there, x >> HALF, 0).sum(axis=0)
            low[: x.shape[1]] += np.where(there, x & ((1 << HALF) - 1), 0).sum(axis=0)
            held[: x.shape[1]] += there.sum(axis=0)
            rows += len(x)
        columns = [np.arange(-1, len(high)), np.append(0, high), np.append(0, low), np.append(rows, held)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "high", "low", "held"])

    found = vectors.select("_vector").mapInArrow(run, "dim long, high long, low long, held long").groupBy("dim")
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "held")]
    rows = sorted(tuple(map(int, r)) for r in found.agg(*total).collect())
    n = rows[0][3] if rows else 0
    # Where a vector is shorter, a zero stands.
    return n, [(high << HALF) + low + (n - held) * SHIFT for dim, high, low, held in rows if dim >= 0]


def _products(rows: DataFrame, factors, width: int) -> np.ndarray:
    """The sum over all rows of the outer products of ``factors(batch)`` with themselves; a task sends ``width`` rows."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in _slices(batches):
            z = factors(batch.column(0))
            total += z.T @ z
        lists = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), lists], ["i", "v"])

    cells = rows.select("_vector").mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    out = np.zeros((width, width))
    for i, j, x in cells.groupBy("i", "j").agg(F.sum("x")).collect():
        out[i, j] = x
    return (out + out.T) / 2


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Sums, covariance and leading components of all ``vectors``; None if there is nothing to whiten."""
    n, sums = _sums(vectors)
    width = len(sums)
    if not n or not width:
        return None
    centre = [round(Fraction(s, n)) for s in sums]
    rest = np.array([float(Fraction(s - n * c, n)) for s, c in zip(sums, centre)])
    centre = np.array(centre, np.int64)

    def centred(lists) -> np.ndarray:
        return (_integers(lists, width)[0] - centre) - rest

    covariance = _products(vectors, centred, width) / n
    trace = float(np.trace(covariance))
    if not trace > 0:
        return None
    values, axes = eigen.leading(covariance, min(components, width))
    kept = values > width * np.finfo(float).eps * trace
    return Fit(n, sums, centre, rest, axes[:, kept], values[kept], trace)


def _projected(lists, model: Fit) -> np.ndarray:
    x = _integers(lists, len(model.sums))[0]
    return (((x - model.centre) - model.rest) @ model.axes) / np.sqrt(model.values)


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all of them."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def factors(lists) -> np.ndarray:
        w = _projected(lists, sent.value)
        return np.concatenate([w, np.ones((len(w), 1))], axis=1)  # the last row of the products has the sums

    products = _products(vectors, factors, k + 1) / model.n
    mean = products[k, :k]
    return float(np.abs(products[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def deviations(x: np.ndarray, model: Fit) -> np.ndarray:
    """The exact sum over dimensions of ``(n x - S)^2``."""
    from_centre = x - model.centre
    shift = [s - model.n * int(c) for s, c in zip(model.sums, model.centre)]
    most = int(np.abs(from_centre).max(initial=0)) * model.n + max(map(abs, shift))
    if most * most * len(shift) < 1 << 63:
        each = from_centre * model.n - np.array(shift, np.int64)
        return (each * each).sum(axis=1)
    exact = (sum((int(a) * model.n - s) ** 2 for a, s in zip(row, shift)) for row in from_centre)
    return np.array([min(v, (1 << 63) - 1) for v in exact], np.int64)


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``. The fit runs when this is called."""
    import pyarrow as pa

    vectors = usable(df, vec_id, embedding)
    id_type = vectors.schema["_id"].dataType.simpleString()
    ddl = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], ddl)
    error = identity_error(vectors, model)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.values)
        for batch in _slices(batches):
            rows = batch.num_rows
            x = _integers(batch.column(1), len(model.sums))[0]
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, np.int64)),
                pa.array(np.repeat(deviations(x, model), k)),
                pa.array(_projected(batch.column(1), model).reshape(-1)),
                pa.array(np.tile(model.values / model.trace, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(run, ddl)
