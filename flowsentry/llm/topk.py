"""Exact top-k inner product search with an impact-ordered index, score at a time.

Components are turned into integers. Vectors are packed into blocks; in a block each component is a
posting whose impact, its magnitude, is quantised to a few levels. A query chunk adds up the postings level by
level, highest impact first. After each level every score is known up to what is left, which is bounded by the
remaining impacts of the query's dimensions and by the norm of the vector's remaining components. A block stops only
when these bounds prove that at most ``SPARE`` times k vectors can be among the best k (or nothing is left); those
are rescored exactly. The best of all blocks follow from one more ranking.

Chunks of queries and blocks of vectors meet block by block; queries grow with the table, so neither side is
broadcast or collected. Blocks are bounded, so is a task's memory.

A vector that is null or holds a null or a component that is not finite takes no part, neither as query nor as
candidate. Shorter vectors count as followed by zeros. Rows that are equal, id included, are separate candidates, and each
row with a query id is a query of its own. Scores beyond a 64-bit integer are cut to its range, integers beyond 1e300 to that. A null id takes no part.
Other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import settle, short_batches

BLOCK = 4096  # vectors of a block
CHUNK = 512  # queries of a chunk
LEVELS = 8
SPARE = 8
EXACT = float(1 << 53)  # integers up to here are exact in doubles
HUGE = 1e300  # integers beyond are cut to this

_PACKED = "_rows binary, _ids binary, _width long, _vectors binary"


def _pack(df: DataFrame, rows: int) -> DataFrame:
    """Rows ``_row, _id, _vector`` packed into one row per up to ``rows`` of them."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                width = int(sizes.max()) if len(sizes) else 0
                vectors = np.zeros((part.num_rows, width))
                with np.errstate(over="ignore"):
                    flat = np.clip(np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -HUGE, HUGE)
                vectors[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                packed = [part.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([packed[0]]), pa.array([packed[1]]), pa.array([width]), pa.array([vectors.tobytes()])],
                    ["_rows", "_ids", "_width", "_vectors"],
                )

    return df.select("_row", "_id", "_vector").mapInArrow(run, _PACKED)


class ImpactIndex:
    """A block's postings in levels of quantised impact, highest first."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        size = np.abs(vectors)
        top = size.max(initial=0)
        level = np.ceil(size * levels / top).astype(np.int8) if top else np.zeros(vectors.shape, np.int8)
        self.segments = []  # (postings of a level, largest remaining impact per dimension, remaining norm per vector)
        for step in range(levels, 0, -1):
            rest = np.where(level < step, size, 0)
            self.segments.append((np.where(level == step, vectors, 0), rest.max(axis=0, initial=0), np.sqrt((rest * rest).sum(axis=1))))

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Which vectors can be among the best ``k`` of each query; ``own`` marks the query's own row."""
        n = len(self.vectors)
        if n <= SPARE * k:
            return ~own
        scores = np.zeros((len(queries), n))
        norms = np.sqrt((queries * queries).sum(axis=1))
        for postings, rest, left in self.segments:
            scores += queries @ postings.T
            slack = np.minimum((np.abs(queries) @ rest)[:, None], norms[:, None] * left[None, :] * (1 + 1e-9))
            sure = np.where(own, -np.inf, scores - slack)
            worst = np.partition(sure, n - k, axis=1)[:, n - k]
            members = (scores + slack >= worst[:, None]) & ~own
            if members.sum(axis=1).max(initial=0) <= SPARE * k:
                break
        return members


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products."""
    if max(np.abs(query).max(initial=0), 1) * max(np.abs(vectors).max(initial=0), 1) * max(len(query), 1) < EXACT:
        return (vectors @ query).astype(np.int64)
    limit = (1 << 63) - 1
    whole = [int(x) for x in query]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in vectors)
    return np.array([max(-limit - 1, min(limit, x)) for x in sums], np.int64)


def _unpacked(ids: bytes, width: int, vectors: bytes, common: int) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(ids, "<i8")
    out = np.zeros((len(ids_), common))
    out[:, :width] = np.frombuffer(vectors).reshape(len(ids_), width)
    return ids_, out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to smaller ids; ~x is -x - 1 and cannot overflow."""
    return np.lexsort((ids, ~score))[:k]


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row that ``is_query`` marks."""
    import pyarrow as pa

    short_batches(df.sparkSession, BLOCK)
    vector = df[embedding].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = df.where(df[vec_id].isNotNull() & df[embedding].isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("_row"),
        df[vec_id].cast("long").alias("_id"),
        vector.alias("_vector"),
        F.coalesce(is_query, F.lit(False)).alias("_asks"),
    )
    rows = settle(usable, "vectors")  # written, so that row numbers stay
    blocks = settle(_pack(rows, BLOCK), "blocks")
    chunks = settle(_pack(rows.where("_asks"), CHUNK), "chunks")
    groups = max(1, chunks.count())
    asked = chunks.select(F.pmod(F.xxhash64("_rows"), F.lit(groups)).alias("_group"), *[F.col(c).alias("q" + c) for c in chunks.columns])
    offered = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = asked.hint("shuffle_merge").join(offered, "_group").select(*["q" + c for c in chunks.columns], *blocks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_rows, q_ids, q_width, q_vectors, b_rows, b_ids, b_width, b_vectors in zip(*[c.to_pylist() for c in batch.columns]):
                width = max(q_width, b_width)
                asking, queries = _unpacked(q_ids, q_width, q_vectors, width)
                ids, vectors = _unpacked(b_ids, b_width, b_vectors, width)
                q_row, b_row = np.frombuffer(q_rows, "<i8"), np.frombuffer(b_rows, "<i8")
                own = q_row[:, None] == b_row[None, :]
                biggest = max(np.abs(queries).max(initial=0), 1) * max(np.abs(vectors).max(initial=0), 1) * max(width, 1)
                members = ImpactIndex(vectors).possible(queries, own, k) if biggest < EXACT else ~own
                out = [[], [], [], []]
                for i in range(len(asking)):
                    at = np.flatnonzero(members[i])
                    score = exact_scores(queries[i], vectors[at])
                    best = _best(score, ids[at], k)
                    for column, values in zip(out, (np.full(len(best), q_row[i]), np.full(len(best), asking[i]), ids[at][best], score[best])):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["_row", "query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "_row long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
