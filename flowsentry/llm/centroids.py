"""Centroid clustering (Lloyd's rounds) in exact integers, with lower bounds loosened by planar geometry.

Vectors are packed into blocks of a bucketed table, written once. A second bucketed table with the same buckets holds what
changes: each vector's cluster and a lower bound on its distance to every other centroid. A round joins the two bucket by
bucket, without a shuffle, and writes the second table anew.

In a round each vector's distance to its own centroid is exact. If the lower bound is above it, the vector stays; if not, it is
ambiguous and all its distances are computed. Between rounds the lower bounds fall by what the other centroids can have come
nearer. A cluster's vectors lie in a sphere around its old centroid. When a centroid moves from p to q, by D, the gain of a point
is at most D times the cosine of the angle, seen from the middle of p and q, between the point and the way to q. In the plane
through p, q and the sphere's centre the sphere spans a range of such angles, and the smallest of them bounds the gain of all
its points; it is D only if the sphere holds the middle or meets the line beyond it.

Sums of clusters change by the vectors that changed their cluster. Blocks send one row a cluster, Spark adds them up, and only
numbers of ``clusters x width`` reach the driver. Rounds end early when no centroid moves, since nothing changes afterwards.

A vector takes part if it has exactly ``width`` components, none of them null or not finite; its id may be null (then hashed
as the text ``null``) or repeated. Integers beyond 2^27 are cut to it, so that distances fit a long. First centroids of equal
hash are taken in order of their components. With fewer vectors than clusters each is a centroid; an empty table gives no rows.
Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import folder, settle

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 1024  # vectors of a block
LIMIT = float(1 << 27)
SAFE = 1e-9  # bounds give way by this share, far more than their rounding errors
ANGLE = 1e-7  # and cosines by this much, as an arc cosine near 1 loses half its digits

_STATE = "_block string, _cluster binary, _lower binary, _ambiguous long, _stats array<struct<cluster:int,count:long,radius:double,sums:array<long>>>"


class Step(NamedTuple):
    """What a round's tasks need: the centroids, and how far the bounds of each cluster's vectors fall first."""

    centroids: np.ndarray
    loosen: np.ndarray | None


def usable(df: DataFrame, vec_id: str, embedding: str, width: int, scale: int) -> DataFrame:
    """``_id, _vector`` with integer components."""
    vector = df[embedding].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(
        vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x * F.lit(float(scale)))).cast("double")
    )
    kept = df.where(df[embedding].isNotNull() & (F.size(df[embedding]) == width) & finite)
    return kept.select(df[vec_id].alias("_id"), F.transform(whole, lambda x: F.floor(x).cast("int")).alias("_vector"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(key.alias("_key"), "_vector").orderBy("_key", "_vector").limit(clusters).collect()
    return np.array([r._vector for r in rows], np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column a centroid."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * int(most) ** 2 * vectors.shape[1] < 1 << 53:  # all sums are exact in doubles
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([own_distances(vectors, np.broadcast_to(c, vectors.shape)) for c in centroids], axis=1)


def own_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    apart = vectors.astype(np.int64) - centroids
    return (apart * apart).sum(axis=1)


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By full scan: nearest centroid (ties: smaller number), its squared distance, distance to the nearest other one."""
    scan = distances(vectors, centroids)
    cluster = scan.argmin(axis=1)
    every = np.arange(len(vectors))
    own = scan[every, cluster]
    others = scan.astype(np.float64)
    others[every, cluster] = np.inf
    return cluster, own, np.sqrt(others.min(axis=1)) * (1 - SAFE)


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer than before any other centroid can be to a vector of each cluster.

    ``radius`` bounds the distance of a cluster's vectors to its old centroid (negative: it has none).
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    for moved in range(len(old)):
        way = new[moved] - old[moved]
        length = np.sqrt(way @ way)
        if not length:
            continue
        middle = (old[moved] + new[moved]) / 2
        for cluster in range(len(old)):
            if cluster == moved or radius[cluster] < 0:
                continue
            out[cluster] = max(out[cluster], _gain(old[cluster] - middle, way / length, length, radius[cluster]))
    return out * (1 + SAFE)


def _gain(centre: np.ndarray, toward: np.ndarray, length: float, radius: float) -> float:
    """The most that a point of a sphere can gain when a centroid moves by ``length``; the middle of the way is the origin."""
    far = np.sqrt(centre @ centre)
    if radius >= far:
        return length
    along = np.clip(centre @ toward / far, -1, 1)
    angle = np.arccos(along) - np.arcsin(radius / far)
    return length * min(1.0, max(0.0, np.cos(max(0.0, angle))) + ANGLE)


def _pack(vectors: DataFrame, width: int) -> DataFrame:
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(low, BLOCK)
                x = piece.column(1).flatten().to_numpy().astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), ids, pa.array([x.tobytes()])], ["_block", "_ids", "_vectors"])
                number += 1

    kind = vectors.schema["_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"_block string, _ids array<{kind}>, _vectors binary")


def _write(df: DataFrame, buckets: int, name: str, made: list[str]) -> DataFrame:
    """A table bucketed by block, in the folder that all executors share; only its name is in the session's catalog."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "_block").option("path", folder(df.sparkSession, name)).saveAsTable(table)
    made.append(table)
    return df.sparkSession.table(table)


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, width)


def _settled_block(x, cluster, lower, step: Step):
    """New clusters, squared distances and bounds of a block's vectors, and which of them were ambiguous."""
    if step.loosen is None:
        return (*assign(x, step.centroids), np.ones(len(x), bool))
    lower = lower - step.loosen[cluster]
    own = own_distances(x, step.centroids[cluster])
    unsure = ~(np.sqrt(own.astype(np.float64)) * (1 + SAFE) < lower)
    cluster = cluster.astype(np.int64)
    if unsure.any():
        cluster[unsure], own[unsure], lower[unsure] = assign(x[unsure], step.centroids)
    return cluster, own, lower, unsure


def _round(met: DataFrame, step: Step, width: int) -> DataFrame:
    """The state after one assignment, with what each block adds to the clusters' counts and sums and their radius."""
    import pyarrow as pa

    sent = met.sparkSession.sparkContext.broadcast(step)
    k = len(step.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = sent.value
        stats_type = pa.list_(
            pa.struct([("cluster", pa.int32()), ("count", pa.int64()), ("radius", pa.float64()), ("sums", pa.list_(pa.int64()))])
        )
        for batch in batches:
            out = [[], [], [], [], []]
            for block, vectors, old, lower in zip(*[c.to_pylist() for c in batch.columns]):
                x = _matrix(vectors, width)
                old = None if old is None else np.frombuffer(old, "<i4")
                lower = None if lower is None else np.frombuffer(lower, "<f8")
                cluster, own, lower, unsure = _settled_block(x, old, lower, step)
                count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
                changed = np.ones(len(x), bool) if old is None else cluster != old
                np.add.at(count, cluster[changed], 1)
                np.add.at(sums, cluster[changed], x[changed].astype(np.int64))
                if old is not None:
                    np.subtract.at(count, old[changed], 1)
                    np.subtract.at(sums, old[changed], x[changed].astype(np.int64))
                radius = np.full(k, -1.0)
                np.maximum.at(radius, cluster, np.sqrt(own.astype(np.float64)) * (1 + SAFE))
                stats = [
                    {"cluster": j, "count": int(count[j]), "radius": float(radius[j]), "sums": sums[j].tolist()}
                    for j in range(k)
                    if radius[j] >= 0 or sums[j].any() or count[j]
                ]
                row = (block, cluster.astype("<i4").tobytes(), lower.astype("<f8").tobytes(), int(unsure.sum()), stats)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), stats_type]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], ["_block", "_cluster", "_lower", "_ambiguous", "_stats"]
            )

    return met.select("_block", "_vectors", "_cluster", "_lower").mapInArrow(run, _STATE)


def _gathered(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Changes of the counts, radii and changes of the sums, added up by Spark."""
    each = state.select(F.inline("_stats"))
    count, radius = np.zeros(k, np.int64), np.full(k, -1.0)
    for r in each.groupBy("cluster").agg(F.sum("count").alias("n"), F.max("radius").alias("r")).collect():
        count[r.cluster], radius[r.cluster] = r.n, r.r
    sums = [[0] * width for _ in range(k)]
    cells = each.select("cluster", F.posexplode("sums").alias("dim", "x"))
    for r in cells.groupBy("cluster", "dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect():
        sums[r.cluster][r.dim] = int(r.s)
    return count, radius, sums


def _finished(met: DataFrame, step: Step, width: int, id_type: str) -> DataFrame:
    """The last assignment as one row a vector."""
    import pyarrow as pa

    sent = met.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vectors, old, lower = (batch.column(i).slice(row, 1) for i in range(4))
                x = _matrix(vectors[0].as_py(), width)
                old, lower = np.frombuffer(old[0].as_py(), "<i4"), np.frombuffer(lower[0].as_py(), "<f8")
                cluster, own, _, _ = _settled_block(x, old, lower, step)
                yield pa.RecordBatch.from_arrays(
                    [ids.flatten(), pa.array(cluster.astype(np.int32)), pa.array(own)], ["vec_id", "cluster", "distance"]
                )

    return met.select("_ids", "_vectors", "_cluster", "_lower").mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def cluster(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
    trace: list[dict] | None = None,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector; the rounds run when this is
    called. ``trace`` gets the vectors, the ambiguous ones and the bounds' loosening of each round."""
    spark = df.sparkSession
    vectors = usable(df, vec_id, embedding, width, scale)
    id_type = vectors.schema["_id"].dataType.simpleString()
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        ddl = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], ddl)
    k, made = len(centroids), []
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    blocks = _write(_pack(vectors, width).repartition(buckets, "_block"), buckets, "blocks", made)
    count, sums, loosen = np.zeros(k, np.int64), [[0] * width for _ in range(k)], None
    met = blocks.select("*", F.lit(None).cast("binary").alias("_cluster"), F.lit(None).cast("binary").alias("_lower"))
    for _ in range(rounds):
        state = _write(_round(met, Step(centroids, loosen), width), buckets, "clusters", made)
        more, radius, shift = _gathered(state, k, width)
        count = count + more
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, shift)]
        moved = np.array([[s // int(n) for s in row] if n else old.tolist() for row, n, old in zip(sums, count, centroids)], np.int64)
        loosen = loosened(centroids, moved, radius)
        if trace is not None:
            drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1))
            trace.append({"vectors": int(count.sum()), "ambiguous": state.agg(F.sum("_ambiguous")).first()[0], "loosen": loosen, "drift": drift})
        met = blocks.join(state.select("_block", "_cluster", "_lower").hint("shuffle_hash"), "_block")
        if (moved == centroids).all():
            break
        centroids = moved
    if loosen is None:  # no rounds: the only assignment scans
        met = blocks.join(_write(_round(met, Step(centroids, None), width), buckets, "clusters", made).hint("shuffle_hash"), "_block")
        loosen = np.zeros(k)
    found = settle(_finished(met, Step(centroids, loosen), width, id_type), "assigned")
    for table in made:  # the names; the folders stay as long as the checkpoints
        spark.sql(f"DROP TABLE {table}")

    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(inertia.values())

    def of_cluster(values) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    own = [min(inertia.get(j, 0), (1 << 63) - 1) for j in range(k)]
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(own).cast("long").alias("cluster_inertia"),
        F.lit(min(total, (1 << 63) - 1)).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
