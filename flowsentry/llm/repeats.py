"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that starts anywhere else.

Equal strings are brought together by content. Each window of ``length`` bytes has an anchor, the place
in it whose 48 bytes have the smallest hash (the leftmost of equals); equal windows have equal anchors at
equal distance. The windows that share an anchor form a piece of text, about one piece in 90 bytes.

1. Each document gives its pieces as (anchor hash, fingerprint, place, windows). Equal pieces of a batch are
   collapsed before the shuffle. Anchors that occur once drop out. Pieces with an equal fingerprint repeat each
   other whole; only one of them goes on.
2. Where an anchor has several different pieces, one text of each is routed by its anchor hash, so that all
   windows that could be equal reach one task. There texts are put together to shards; each shard gets a
   suffix array (Larsson and Sadakane) and its common prefixes (Kasai), in which windows that share
   ``length`` bytes are neighbours.
3. An anchor with more texts than fit a shard spans several: their sorted window keys are merged shard by
   shard with binary searches, which marks windows that equal one of another shard.
   The texts of a crowded anchor are dealt over many tasks instead. Each shard marks what repeats within it and gives
   each different window once, and equal windows of different shards then meet by their key.
   Crowded anchors are found on a sample; that only decides who meets where, not what is found.
4. The marked windows of a document become byte spans that are cut out.

No string is sampled or capped; strings are judged on the input. A task holds one shard at a time, besides
the texts and keys of the one anchor that spans shards and was not found to be crowded. Texts of any length are read in stretches that overlap by
``length - 1`` bytes. Null texts are empty; texts shorter than ``length`` stay whole; rows that are equal,
id included, are separate places, so they repeat each other. An empty table gives an empty result. Other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm import suffix
from flowsentry.llm.common import buffers, settle, short_batches, utf8, worker_cache

LENGTH = 200
GRAM = 48  # bytes whose hash chooses the anchor; short ones are shared by unrelated texts
STRETCH = 1 << 21  # bytes worked on at once; a place in a stretch takes the lower bits of a sort key
SHARD = 1 << 19  # bytes of a suffix array
SAMPLE = 64  # one document in so many is looked at for crowded anchors
CROWD = 32  # pieces in the sample that make an anchor crowded; they are dealt by as many salts
CROWDED = 1 << 16  # anchors, the most crowded ones, that are dealt by salts


def _gram(length: int) -> int:
    """The bytes of an anchor in windows of ``length`` bytes."""
    if length < 32:
        raise ValueError("strings of less than 32 bytes repeat everywhere")
    return GRAM if length >= 2 * GRAM else length // 32 * 8


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place."""
    n = len(data) - gram + 1
    loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.full(n, np.uint64(gram))
    for low in range(0, gram, 8):
        h ^= loads[low : low + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring keys, from running minima of blocks in both directions."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    blocks = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(rows, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    cache = worker_cache()
    if "powers" not in cache:
        odd = 0x5851F42D4C957F2D
        size = STRETCH + (1 << 12)
        both = []
        for base in (odd, pow(odd, -1, 1 << 64)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        cache["powers"] = both
    return cache["powers"]


def _stretches(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (document, place in it, start, end) of at most about ``STRETCH`` bytes each."""
    group, held = [], 0
    for i in range(len(offsets) - 1):
        start, end = int(offsets[i]), int(offsets[i + 1])
        for low in range(start, end - length + 1, STRETCH // 2):
            high = min(end, low + STRETCH // 2 + length - 1)
            if held and held + high - low > STRETCH:
                yield group
                group, held = [], 0
            group.append((i, low - start, low, high))
            held += high - low
    if group:
        yield group


def collapsed(anchor: np.ndarray, mark: np.ndarray, place: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of which each equal piece but the first has one of its own, and which pieces have equals.

    Equal pieces repeat each other, so one is enough to meet others; the rest would only crowd its anchor.
    """
    order = np.lexsort((mark, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (mark[order][1:] != mark[order][:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    twice, extra = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order] = np.repeat(sizes > 1, sizes)
    extra[order] = ~new
    own = (anchor ^ (place + 1) * np.int64(0x2545F4914F6CDD1D)) * np.int64(0x9E3779B97F4A7C1) + document
    return np.where(extra, own, anchor), twice


def pieces(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of (document, anchor hash, fingerprint, first window's place, windows)."""
    powers, inverses = _powers()
    gram = _gram(length)
    for group in _stretches(offsets, length):
        joined = np.concatenate([data[low:high] for _, _, low, high in group])
        sizes = np.array([high - low for _, _, low, high in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        valid = np.zeros(len(joined) + 1, np.int8)
        np.add.at(valid, starts, 1)
        np.add.at(valid, ends - length + 1, -1)
        windows = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
        h = _hashes(joined, gram)
        places = np.uint64((1 << 22) - 1)
        keys = (h & ~places) | np.arange(len(h), dtype=np.uint64)
        anchor = (_smallest(keys, length - gram + 1)[windows] & places).astype(np.int64)
        del keys
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
        new[np.searchsorted(windows, starts)] = True
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(windows)))
        first = windows[head]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[: len(h)], dtype=np.uint64)])
        mark = (sums[first + count - 1 + length - gram + 1] - sums[first]) * inverses[first]
        mark ^= mark >> np.uint64(32)
        mark = mark * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64)
        part = np.searchsorted(ends, first, "right")
        document = np.array([g[0] for g in group])[part]
        place = first - starts[part] + np.array([g[1] for g in group])[part]
        yield document, h[anchor[head]].view(np.int64), mark.view(np.int64), place, count


def _keys_of(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of the ``length`` bytes from each place."""
    powers, inverses = _powers()
    gram = _gram(length)
    h = _hashes(np.concatenate([text, np.zeros(gram, np.uint8)]), gram)[: len(text)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[: len(h)], dtype=np.uint64)])
    return (sums[windows + length - gram + 1] - sums[windows]) * inverses[windows]


def repeated_windows(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows, given by their places in one shard's text, equal another of them."""
    order, rank = suffix.suffix_array(text)
    shared = suffix.common_prefixes(text, order, rank, length, exact=False)
    group = np.cumsum(shared < length)  # suffixes that share ``length`` bytes are one group
    own = group[rank[windows]]
    return np.bincount(own)[own] >= 2


class _Spanning:
    """The windows of one anchor that spans shards: sorted keys so far, and who else has them."""

    def __init__(self, length: int):
        self.length = length
        self.keys = np.zeros(0, np.uint64)
        self.repeated = np.zeros(0, bool)

    def merge(self, keys: np.ndarray, repeated: np.ndarray) -> None:
        """Look each key up among the sorted ones of earlier shards by binary search, then merge."""
        own, back = np.unique(keys, return_inverse=True)
        flags = np.zeros(len(own), bool)
        np.logical_or.at(flags, back, repeated)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        self.repeated[at[known]] = True
        self.keys = np.insert(self.keys, at[~known], own[~known])
        self.repeated = np.insert(self.repeated, at[~known], flags[~known])

    def verdict(self, keys: np.ndarray) -> np.ndarray:
        return self.repeated[np.searchsorted(self.keys, keys)]


def _judge(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One shard: the text, the places of its windows and whether each repeats within the shard."""
    text = np.frombuffer(b"".join(row[-1] for row in rows), np.uint8)
    sizes = np.array([len(row[-1]) for row in rows])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    windows = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return text, windows, repeated_windows(text, windows, length)


def _runs(rows: list[tuple], repeated: np.ndarray, length: int) -> Iterator[tuple]:
    """(key, text hash, first window's place, windows) of the runs of repeated windows of each piece.

    A piece that occurs elsewhere as a whole has been marked already.
    """
    at = 0
    for doc, mark, _, whole, place, text in rows:
        count = len(text) - length + 1
        own = repeated[at : at + count]
        at += count
        if whole or not own.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            yield doc, mark, place + low, high - low


def judge_stream(rows: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """Rows (key, text hash, anchor, whole, place, text), sorted by anchor, to runs of repeated windows."""
    shard, held, spanning, waiting = [], 0, None, []

    def close(last_anchor):
        """Judge the shard; if its last anchor goes on, keep that anchor's rows waiting."""
        nonlocal shard, held, spanning, waiting
        text, windows, repeated = _judge(shard, length)
        keys = None
        if spanning is not None or last_anchor is not None:
            keys = _keys_of(text, windows, length)
        counts = np.cumsum([0] + [len(row[-1]) - length + 1 for row in shard])
        low = 0
        if spanning is not None:
            while low < len(shard) and shard[low][2] == waiting[0][0][2]:
                low += 1
            own = slice(0, counts[low])
            spanning.merge(keys[own], repeated[own])
            waiting += [(row, keys[counts[i] : counts[i + 1]]) for i, row in enumerate(shard[:low])]
            if low < len(shard) or last_anchor is None:
                yield from settle_spanning()
        high = len(shard)
        if last_anchor is not None and spanning is None:
            while high > low and shard[high - 1][2] == last_anchor:
                high -= 1
            spanning = _Spanning(length)
            own = slice(counts[high], counts[-1])
            spanning.merge(keys[own], repeated[own])
            waiting = [(shard[i], keys[counts[i] : counts[i + 1]]) for i in range(high, len(shard))]
        yield from _runs(shard[low:high], repeated[counts[low] : counts[high]], length)
        shard, held = [], 0

    def settle_spanning():
        nonlocal spanning, waiting
        for row, keys in waiting:
            yield from _runs([row], spanning.verdict(keys), length)
        spanning, waiting = None, []

    for row in rows:
        if shard and held + len(row[-1]) > SHARD:
            yield from close(shard[-1][2] if shard[-1][2] == row[2] else None)
        elif spanning is not None and not shard and row[2] != waiting[0][0][2]:
            yield from settle_spanning()
        shard.append(row)
        held += len(row[-1])
    if shard:
        yield from close(None)
    elif spanning is not None:
        yield from settle_spanning()


def asked_windows(rows: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """Rows as for ``judge_stream`` whose anchors are dealt over several tasks, to (key, text hash, place, windows, anchor, window key).

    Runs that repeat within a shard have no anchor. Besides them each different window of the shard is given once, with no
    windows if it is marked already: those given by several shards are repeated.
    """

    def close(shard):
        text, windows, repeated = _judge(shard, length)
        yield from ((*run, None, None) for run in _runs(shard, repeated, length))
        keys = _keys_of(text, windows, length).view(np.int64)
        counts = np.array([len(row[-1]) - length + 1 for row in shard])
        ends = np.cumsum(counts)
        # Equal windows have equal anchors, so one of each key is enough.
        _, first = np.unique(keys, return_index=True)
        part = np.searchsorted(ends, first, "right")
        places = first - (ends - counts)[part]
        for i, low, key, marked in zip(part.tolist(), places.tolist(), keys[first].tolist(), repeated[first].tolist()):
            doc, mark, (anchor, _), whole, place, _ = shard[i]
            yield doc, mark, place + low, int(not (whole or marked)), anchor, key

    shard, held = [], 0
    for row in rows:
        if shard and held + len(row[-1]) > SHARD:
            yield from close(shard)
            shard, held = [], 0
        shard.append(row)
        held += len(row[-1])
    if shard:
        yield from close(shard)


def met_windows(judged: DataFrame) -> DataFrame:
    """The runs of ``judged``, and the windows that several shards gave."""
    equal = Window.partitionBy("_anchor", "_window")
    met = (
        judged.where("_window IS NOT NULL")
        .withColumn("_shards", F.count(F.lit(1)).over(equal))
        .where("_shards > 1 AND _n > 0")
    )
    return judged.where("_window IS NULL").unionByName(met.drop("_shards")).select("_key", "_mark", "_place", "_n")


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that the spans cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def repeated_runs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH):
    """The keyed documents ``(_id, _key, _mark, _text)`` and their runs of repeated windows ``(_key, _mark, _place, _n)``."""
    import pyarrow as pa

    short_batches(df.sparkSession)
    bytes_of = utf8(df[text]).cast("binary")
    # Rows with one id and text share their key: what holds for one holds for the other.
    keyed = df.select(
        df[doc_id].alias("_id"),
        F.xxhash64(df[doc_id]).alias("_key"),
        F.xxhash64(bytes_of).alias("_mark"),
        bytes_of.alias("_text"),
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, salts = sent.value if sent else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            marks = batch.column(1).to_numpy()
            for document, anchor, mark, place, n in pieces(*buffers(batch.column(2)), length):
                anchor, twice = collapsed(anchor, mark, place, marks[document])
                dealt = np.zeros(len(anchor), np.int32)
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, anchor), len(crowded) - 1)
                    dealt = np.where(crowded[at] == anchor, salts[at], 0).astype(np.int32)
                numbers = (anchor, mark, place, n, twice, dealt)
                at = pa.array(document)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x) for x in numbers]],
                    ["_key", "_mark", "_anchor", "_print", "_place", "_n", "_twice", "_salts"],
                )

    long_enough = keyed.where(F.octet_length("_text") >= length).select("_key", "_mark", "_text")
    emitted_as = "_key long, _mark long, _anchor long, _print long, _place long, _n long, _twice boolean, _salts int"
    sent = None
    looked_at = long_enough.where(F.pmod(F.xxhash64("_key", "_mark"), F.lit(SAMPLE)) == 0).mapInArrow(emit, emitted_as)
    crowd = looked_at.groupBy("_anchor").count().where(F.col("count") >= CROWD).orderBy(F.desc("count"), "_anchor").limit(CROWDED).collect()
    crowd = sorted((row[0], row[1]) for row in crowd)
    if crowd:
        sent = df.sparkSession.sparkContext.broadcast(
            (np.array([a for a, _ in crowd], np.int64), np.array([min(n, 1 << 30) for _, n in crowd], np.int32))
        )
    # Of a crowded anchor only equal pieces need to meet here.
    emitted = long_enough.mapInArrow(emit, emitted_as).withColumn(
        "_part", F.when(F.col("_salts") > 0, F.col("_print")).otherwise(F.lit(0))
    )
    anchor, same = Window.partitionBy("_anchor", "_part"), Window.partitionBy("_anchor", "_part", "_print")
    dealt = F.col("_salts") > 0
    tagged = settle(
        emitted.withColumn("_all", F.count(F.lit(1)).over(anchor))
        .where("_salts > 0 OR _all > 1 OR _twice")
        .withColumn("_copies", F.count(F.lit(1)).over(same))
        .withColumn("_first", F.row_number().over(same.orderBy("_key", "_mark", "_place")) == 1)
        .select("_key", "_mark", "_anchor", "_place", "_n", "_first", ((F.col("_copies") > 1) | F.col("_twice")).alias("_whole"), (dealt | (F.col("_copies") < F.col("_all"))).alias("_several"), F.when(dealt, F.pmod("_print", "_salts")).otherwise(F.lit(-1)).cast("int").alias("_deal")),
        "pieces",
    )
    whole = tagged.where("_whole").select("_key", "_mark", "_place", "_n")
    wanted = (
        tagged.where("_first AND _several")
        .groupBy("_key", "_mark")
        .agg(F.collect_list(F.struct("_anchor", "_whole", "_place", "_n", "_deal")).alias("_wanted"))
    )
    # Both joins with the texts need the same columns in the same partitions, so one shuffle serves both.
    documents = keyed.repartition("_key", "_mark")
    found = wanted.join(documents, ["_key", "_mark"]).select("_key", "_mark", "_text", "_wanted", "_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole_text = batch.column(2)[i].as_py()
                own = batch.column(3)[i].values
                places, counts = own.field("_place").to_pylist(), own.field("_n").to_pylist()
                texts = [whole_text[p : p + n - 1 + length] for p, n in zip(places, counts)]
                row = pa.array([i] * len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), own.field("_anchor"), own.field("_whole"), own.field("_place"), pa.array(texts, pa.binary()), own.field("_deal")],
                    ["_key", "_mark", "_anchor", "_whole", "_place", "_piece", "_deal"],
                )

    texts = found.mapInArrow(
        cut, "_key long, _mark long, _anchor long, _whole boolean, _place long, _piece binary, _deal int"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                a, b, c, d, e, g, deal = (column.to_pylist() for column in batch.columns)
                yield from zip(a, b, zip(c, deal), d, e, g)

        def runs():
            for crowded, group in groupby(rows(), lambda row: row[2][1] >= 0):
                if crowded:
                    yield from asked_windows(group, length)
                else:
                    yield from ((*run, None, None) for run in judge_stream(group, length))

        out = []
        for row in runs():
            out.append(row)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    names, types = ["_key", "_mark", "_place", "_n", "_anchor", "_window"], [pa.int64()] * 6
    judged = (
        texts.repartition("_anchor", "_deal")
        .sortWithinPartitions(F.col("_deal") >= 0, "_anchor", "_deal", "_key", "_mark", "_place")
        .mapInArrow(judge, ", ".join(f"{name} long" for name in names))
    )
    judged = met_windows(settle(judged, "judged")) if crowd else judged.select("_key", "_mark", "_place", "_n")
    return documents, whole.unionByName(judged)


def cut_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_bytes, spans, kept`` with the removed byte spans and the rest."""
    import pyarrow as pa

    documents, runs = repeated_runs(df, text, doc_id, length)
    spans = runs.groupBy("_key", "_mark").agg(F.collect_list(F.struct("_place", "_n")).alias("_runs"))
    found = documents.join(spans, ["_key", "_mark"], "left").select("_id", "_text", "_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for i in range(batch.num_rows):
                whole, runs = batch.column(1)[i].as_py(), batch.column(2)[i]
                if not runs.is_valid:
                    kept.append(whole)
                    removed.append([])
                    continue
                start = runs.values.field("_place").to_numpy(zero_copy_only=False)
                n = runs.values.field("_n").to_numpy(zero_copy_only=False)
                low, high = merge_spans(start, start + n - 1 + length)
                edges = [0, *[x for pair in zip(low.tolist(), high.tolist()) for x in pair], len(whole)]
                kept.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            sizes = pa.array([len(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(removed, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    kind = df.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
