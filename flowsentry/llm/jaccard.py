"""N-gram Jaccard join: documents whose shingle sets are alike, by an R-tree over count vectors.

A document's set holds the hashes of its distinct five-word shingles. Hash ranges are the groups; the
numbers of shingles per group are the document's point. Two sets share at most the sum of the smaller of
their counts in each group, so that sum bounds the overlap, for points as for the bounding boxes of leaves.

One tree over all points would compare all leaves of one size: points of unrelated documents lie close
together in every dimension. So the tree's upper level routes by exact cells. In any order of hashes that all
documents share, two sets that are similar enough share one of their first ``n - ceil(0.8 n) + 1`` hashes; those
are a set's cells. The order puts hashes of rarely used ranges first, by counts over all documents, so that
passages which many documents share make few cells. Each cell that several sets share is a subtree: its
points, in order of size, are packed into leaves; pairs of leaves are pruned by their boxes, pairs of points by
their counts, and what survives is verified on the whole texts.

The place of a cell in its set's order bounds the partners it is for: in the first hash that two sets share, at places ``i`` and
``j`` from 0, no more than ``min(n - i, m - j)`` are shared, which is enough only if ``4 m <= 5 n - 9 i`` and ``4 n <= 5 m - 9 j``.
Sets without such a partner leave the cell. Two sets that are similar enough both stay in the cell of their first shared hash.

* Equal sets are one node, so copies cost nothing further on.
* In a group of many near copies not all pairs are tried. First each node is compared with one other, the
  most connected of those in its cells, which shares cells with the most others. Links found make
  components; the tree is then joined only for pairs of nodes of different components, so that every pair that
  could still join two components is tried and no link between them is lost.
* Verification streams: the texts that are compared with one node follow its own text, in bounded stretches.

Hashes and the fingerprints that stand for sets have 64 bits. Null texts and texts without words have an
empty set and link with nothing; with fewer than five words the whole sequence is the one shingle. Rows that
share an id are one document for links, whatever their texts; a row without an id links with nothing and has no
component. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm import words
from flowsentry.llm.common import buffers, settle, short_batches, utf8
from flowsentry.llm.components import components

LEAF = 128  # points of a leaf
STRETCH = 200  # texts that follow one node's text in verification
BROADCAST_NODES = 50_000  # rows of four short columns, some megabytes
COARSE, FINE = (4, 256), (1, 4096)  # members per group, and most groups, of the two points of a set
RANGE_BITS = 17  # hash ranges whose use is counted: a table of fixed size, half a megabyte
BATCH_BYTES = "8m"  # a row of two leaves holds up to a megabyte, and tasks hold some batches at once
PARTS = 1280  # of a set's size, for the places of its cells: a fifth of them, so a byte holds a place
KNOWN = 100_000  # sets that a task remembers to have emitted


def sets(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    low = words.lowered(data)
    starts, ends = words.spans(offsets, low, words.is_space(low))
    hashes = words.span_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    for i in range(len(offsets) - 1):
        yield words.shingles(hashes[first[i] : first[i + 1]])


def point(hashes: np.ndarray, scale: tuple[int, int]) -> np.ndarray:
    """The counts of a set per group; the number of groups, a power of two, follows its size."""
    per_group, most = scale
    bits = 3
    while (1 << bits) < min(most, len(hashes) / per_group):
        bits += 1
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts over fewer groups; neighbouring groups add up."""
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(axis=1)


def enough(shared, a, b):
    """Whether 100 * shared >= 80 * union, for sets of ``a`` and ``b`` members."""
    return 9 * shared >= 4 * (a + b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def fingerprint(hashes: np.ndarray) -> int:
    """A set's fingerprint, as a signed 64-bit integer; 0 is the empty set's."""
    return int(words._mixed(hashes + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)) if len(hashes) else 0


def _ranges(hashes: np.ndarray) -> np.ndarray:
    # Not the bits that make the groups of points.
    return ((hashes >> np.uint64(16)) & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64)


def cells_of(hashes: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The first hashes of a set, rarely used ranges first, of which similar enough sets share one."""
    count = len(hashes) - (4 * len(hashes) + 4) // 5 + 1
    return hashes[np.lexsort((hashes, use[_ranges(hashes)]))[:count]]


def _profiles(documents: DataFrame) -> DataFrame:
    """Of ``documents (_id, _text)`` rows of kind 0 ``(_id, _n, _print)``, and of kind 1 the use of hash ranges."""
    import pyarrow as pa

    names = ["_kind", "_id", "_n", "_print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(1 << RANGE_BITS, np.int64)
        for batch in batches:
            n, prints, held = [], [], []
            for own in sets(*buffers(batch.column(1))):
                n.append(len(own))
                prints.append(fingerprint(own))
                held.append(_ranges(own))
            if held:
                use += np.bincount(np.concatenate(held), minlength=len(use))
            kind = pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([kind, batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.int64())], names)
        used = np.flatnonzero(use)
        columns = [pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(use[used]), pa.array(np.zeros(len(used), np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names)

    return documents.mapInArrow(run, "_kind int, _id long, _n long, _print long")


def _cells(documents: DataFrame, use: np.ndarray) -> DataFrame:
    """``_cell, _node`` of each cell that sets share which may be similar enough, by their sizes and the cell's places."""
    import pyarrow as pa

    sent = documents.sparkSession.sparkContext.broadcast(use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            cells, nodes, places = [], [], []
            for own in sets(*buffers(batch.column(1))):
                node = fingerprint(own)
                if not len(own) or node in known:
                    continue
                if len(known) >= KNOWN:
                    known.clear()
                known.add(node)
                cells.append(cells_of(own, sent.value))
                nodes.append(np.full(len(cells[-1]), node))
                at = np.arange(len(cells[-1])) * PARTS // len(own)
                places.append((len(own) << 8) + np.minimum(at, 255))
            if cells:
                made = [np.concatenate(cells).view(np.int64), np.concatenate(nodes), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["_cell", "_node", "_place"])

    # The size of the set and the cell's place in it, in parts of the size, travel as one short number.
    emitted = documents.where("_id IS NOT NULL").mapInArrow(run, "_cell long, _node long, _place long")
    # Copies in other tasks meet in the cell; one shuffle serves to drop them and to look at the others.
    sets_of = emitted.repartition("_cell").dropDuplicates(["_cell", "_node", "_place"])
    return _partnered(sets_of.select("_cell", "_node", F.shiftright("_place", 8).alias("_n"), F.col("_place").bitwiseAND(255).alias("_at")))


def _partnered(places: DataFrame) -> DataFrame:
    """``_cell, _node`` of the rows of ``places (_cell, _node, _n, _at)`` that may have a partner in their cell.

    Exact for cells of two sets, up to the rounding of places, which is down; in larger ones each bound is held against the
    best of all that come before or after by size.
    """
    by_size = Window.partitionBy("_cell").orderBy("_n", "_at", "_node")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    size = 4 * PARTS * F.col("_n")
    most = F.col("_n") * (5 * PARTS - 9 * F.col("_at"))  # the size of a partner, in the same unit
    smaller = (F.max(most).over(before) >= size) & (F.min(size).over(before) <= most)
    larger = (F.lead(size).over(by_size) <= most) & ((F.lead(most).over(by_size) >= size) | F.lead("_n", 2).over(by_size).isNotNull())
    return places.withColumn("_near", smaller | larger).where("_near").select("_cell", "_node")


def _different(cells: DataFrame) -> DataFrame:
    """One of the cells that hold the same nodes, as the cells of a passage or of two copies do."""
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("_node"))).alias(f"_mark{seed}") for seed in (1, 2)]
    signed = cells.groupBy("_cell").agg(*marks, F.count(F.lit(1)).alias("_size"))
    kept = signed.groupBy("_mark1", "_mark2", "_size").agg(F.min("_cell").alias("_cell")).select("_cell")
    return cells.join(kept, "_cell", "left_semi")


def _involved(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``_node, _n, _point, _fine, _text`` of the nodes in ``ids (_node, _first)``; repeated rows may give a node twice."""
    import pyarrow as pa

    names = ["_node", "_n", "_point", "_fine", "_text"]
    # One way at every size: a small table of ids would be broadcast, and shuffles then grow by a jump.
    ids = ids.hint("merge")
    found = documents.join(ids, documents["_id"] == ids["_first"]).select("_node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            nodes, own = batch.column(0).to_pylist(), []
            for i, x in enumerate(sets(*buffers(batch.column(1)))):
                if fingerprint(x) == nodes[i] and nodes[i] not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(nodes[i])
                    own.append((i, x))
            at = pa.array([i for i, _ in own], pa.int64())
            sizes = pa.array([len(x) for _, x in own], pa.int64())
            points = [pa.array([_packed(point(x, scale), len(x)) for _, x in own], pa.binary()) for scale in (COARSE, FINE)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), sizes, *points, batch.column(1).take(at)], names)

    return found.mapInArrow(run, "_node long, _n long, _point binary, _fine binary, _text string")


def _kind(n: int) -> str:
    """The type of counts of a set of ``n`` members."""
    return "u1" if n < 1 << 8 else "<u2" if n < 1 << 16 else "<u4"


def _packed(counts: np.ndarray, n: int) -> bytes:
    """A point as it travels: with every cell of its set. Most counts are 0 to 3, which compress to a few bits."""
    return zlib.compress(counts.astype(_kind(n)).tobytes(), 1)


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), _kind(n)).astype(np.int32)


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose points, from ``points (_node, _n, _point)``, allow enough overlap."""
    import pyarrow as pa

    asked = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
    points = points.join(asked, "_node")

    sides = pairs.join(points.select(F.col("_node").alias("a"), F.col("_n").alias("na"), F.col("_point").alias("pa")), "a").join(
        points.select(F.col("_node").alias("b"), F.col("_n").alias("nb"), F.col("_point").alias("pb")), "b"
    )
    sized = sides.where((5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, pa_, pb = (column.to_pylist() for column in batch.columns)
            keep = []
            for i in range(len(a)):
                x, y = _counts(pa_[i], na[i]), _counts(pb[i], nb[i])
                groups = min(len(x), len(y))
                keep.append(bool(enough(np.minimum(folded(x, groups), folded(y, groups)).sum(), na[i], nb[i])))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return sized.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole texts, from ``texts (_node, _text)``, are similar enough."""
    import pyarrow as pa

    # Few documents are broadcast, so that the texts of all others need no shuffle.
    asked = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_k")).select("a", F.ceil(F.col("_k") / STRETCH).cast("int").alias("_parts"))
    followers = pairs.join(asked, "a").select(
        F.col("a").alias("_lead"), F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("_part"), F.col("b").alias("_node")
    )
    leaders = asked.select(
        F.col("a").alias("_lead"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("a").alias("_node")
    )
    wanted = settle(followers.unionByName(leaders), "wanted")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    found = (
        texts.join(wanted, "_node")
        .select("_lead", "_part", (F.col("_lead") != F.col("_node")).alias("_follows"), "_node", "_text")
        .repartition("_lead", "_part")
        .sortWithinPartitions("_lead", "_part", "_follows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            lead, part, follows, node = (batch.column(i).to_pylist() for i in range(4))
            links = []
            for i, hashes in enumerate(sets(*buffers(batch.column(4)))):
                if (lead[i], part[i]) != at:
                    at, own = (lead[i], part[i]), []
                if not follows[i]:
                    own.append(hashes)
                elif any(enough(overlap(x, hashes), len(x), len(hashes)) and len(hashes) for x in own):
                    links.append((lead[i], node[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return found.mapInArrow(run, "a long, b long").distinct()


def _tree_pairs(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of one cell and different components whose points allow enough overlap.

    ``cells`` has ``_cell, _node, _component``.
    """
    import pyarrow as pa

    within = Window.partitionBy("_cell")
    members = cells.join(points, "_node").select(
        "_cell",
        F.struct("_node", "_component", "_n", "_point").alias("_member"),
        F.col("_n").alias("_size"),
        F.floor((F.row_number().over(within.orderBy("_n", "_node")) - 1) / LEAF).cast("int").alias("_leaf"),
        (F.count(F.lit(1)).over(within) > LEAF).alias("_split"),
    )
    leaves = members.groupBy("_cell", "_leaf").agg(
        F.collect_list("_member").alias("_members"), F.min("_size").alias("_low"), F.max("_size").alias("_high"), F.first("_split").alias("_split")
    )
    leaves = settle(leaves, "leaves")
    # Most cells are one leaf, which meets itself without a join.
    alone = leaves.where("NOT _split").select(F.col("_members").alias("_members_a"), F.expr("slice(_members, 1, 0)").alias("_members_b"))
    leaves = leaves.where("_split")
    left = leaves.select("_cell", *[F.col(c).alias(c + "_a") for c in ("_leaf", "_members", "_low", "_high")])
    right = leaves.select("_cell", *[F.col(c).alias(c + "_b") for c in ("_leaf", "_members", "_low", "_high")])
    # Leaves are in order of size: the later one may be larger, by a quarter at most.
    pairs = left.join(right, "_cell").where("_leaf_a <= _leaf_b AND 4 * _low_b <= 5 * _high_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                sides = []
                for column in (0, 1):
                    own = batch.column(column)[i].values
                    if not len(own):  # one leaf, which meets itself
                        sides.append(sides[0])
                        continue
                    n = own.field("_n").to_numpy(zero_copy_only=False)
                    raw = [_counts(x, k) for x, k in zip(own.field("_point").to_pylist(), n)]
                    nodes = own.field("_node").to_numpy(zero_copy_only=False)
                    sides.append((nodes, own.field("_component").to_numpy(zero_copy_only=False), n, raw))
                groups = min(len(x) for side in sides for x in side[3])
                a, b = ((nodes, parts, n, np.array([folded(x, groups) for x in raw])) for nodes, parts, n, raw in sides)
                # The boxes first: no pair can share more than the sum of the smaller upper corners.
                if not enough(np.minimum(a[3].max(axis=0), b[3].max(axis=0)).sum(), a[2].min(), b[2].min()):
                    continue
                for j in range(len(a[0])):
                    sized = (5 * a[2][j] >= 4 * b[2]) & (5 * b[2] >= 4 * a[2][j]) & (b[1] != a[1][j])
                    if not sized.any():
                        continue
                    at = np.flatnonzero(sized)
                    bound = np.minimum(b[3][at], a[3][j]).sum(axis=1)
                    at = at[enough(bound, a[2][j], b[2][at])]
                    out_a.append(np.minimum(a[0][j], b[0][at]))
                    out_b.append(np.maximum(a[0][j], b[0][at]))
            both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["a", "b"])

    met = alone.unionByName(pairs.select("_members_a", "_members_b"))
    return met.mapInArrow(run, "a long, b long").distinct()


def similar(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id``."""
    short_batches(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    documents = df.select(df[doc_id].cast("long").alias("_id"), utf8(df[text]).alias("_text"))
    profiles = settle(_profiles(documents), "profiles")
    rows = profiles.where("_kind = 0").select("_id", "_n", "_print")
    known = rows.where("_id IS NOT NULL AND _n > 0").withColumnRenamed("_print", "_node")
    use = np.zeros(1 << RANGE_BITS, np.int64)
    ranges = profiles.where("_kind = 1").groupBy(F.col("_id").alias("_range")).agg(F.sum("_n").alias("_use"))
    for place, number in ranges.collect():  # a row per range, however many documents
        use[place] = number

    found = settle(_cells(documents, use), "cells")
    cells = settle(_different(found), "cells")
    firsts = settle(known.groupBy("_node").agg(F.min("_id").alias("_first")), "firsts")
    ids = settle(cells.select("_node").distinct().join(firsts, "_node"), "ids")
    involved = settle(_involved(documents, ids), "involved")
    points, texts = involved.select("_node", "_n", "_point"), involved.select("_node", "_text")
    fine = involved.select("_node", "_n", F.col("_fine").alias("_point"))

    reach = found.groupBy("_node").agg(F.count(F.lit(1)).alias("_reach"))
    reached = cells.join(reach, "_node").select("_cell", "_node", F.struct("_reach", "_node").alias("_rank"))
    # Each node is compared with the most connected one that it shares a cell with: one pair a node.
    best = reached.groupBy("_cell").agg(F.max("_rank").alias("_lead"))
    stars = reached.join(best, "_cell").groupBy("_node").agg(F.max("_lead").alias("_lead"))
    tried = stars.select(F.col("_lead._node").alias("a"), F.col("_node").alias("b")).where("a <> b")
    pairs = settle(_bounded(tried, points), "pairs")
    links = settle(_verified(pairs, texts), "links")

    # An id with several texts joins their sets.
    several = known.groupBy("_id").agg(F.min("_node").alias("a"), F.max("_node").alias("_other")).where("a <> _other")
    more = known.join(several.select("_id", "a"), "_id").where("_node <> a").select("a", F.col("_node").alias("b"))
    grouped = settle(components(links.unionByName(more)), "components")

    in_cell = Window.partitionBy("_cell")
    placed = cells.join(grouped, cells["_node"] == grouped["node"], "left").select(
        "_cell", "_node", F.coalesce("component", "_node").alias("_component")
    )
    mixed = (
        placed.withColumn("_from", F.min("_component").over(in_cell))
        .withColumn("_to", F.max("_component").over(in_cell))
        .where("_from <> _to")
        .select("_cell", "_node", "_component")
    )
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = settle(_tree_pairs(mixed, fine).join(done, ["a", "b"], "left_anti"), "rest")
    late = settle(_verified(rest, texts), "late")
    if not late.isEmpty():
        joined = grouped.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(late)
        grouped = settle(components(joined), "components")

    of_node = firsts.join(grouped, F.col("_node") == F.col("node"), "left").select(
        "_node", "_first", F.coalesce("component", "_node").alias("_component")
    )
    least = of_node.groupBy("_component").agg(F.min("_first").alias("component_id"))
    named = of_node.join(least, "_component").select(F.col("_node").alias("_print"), "component_id")
    return rows.join(named, "_print", "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("_id"))).alias("component_id"),
    )
