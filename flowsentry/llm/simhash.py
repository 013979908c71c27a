"""Document fingerprints by SimHash, and the search for all fingerprints within a Hamming radius.

A text's terms are its words and its shingles of five words (lower case for A-Z). Every term has a hash of 128 bits and an
integer weight, the bit length of how often it occurs; each term votes on every bit with its weight, and the sign of the
sum is the fingerprint's bit. Weights are doubled and the term with the smallest hash gets one more, so that no vote ends
level. Votes are integers, so equal texts have equal fingerprints however the table is partitioned.

The search cuts fingerprints into blocks. Two of them within the radius differ in at most that many blocks, so they agree on
some choice of the others: there is one table per choice, keyed by the blocks it puts first. A pair counts in the first table
in which it agrees. Rows are different fingerprints with their number of documents, so exact copies cost nothing. Inside a
key queries are compared with the other fingerprints as arrays; a key with many queries is cut into a grid of tasks.

A null text counts as empty; a text without words has the fingerprint 0. Documents are in order of falling id, ties in order
of the text's hash and the text, null ids last; behind the last comes the first, and a single document follows itself. Rows
may repeat and then follow each other. An empty table gives an empty result; other columns are not touched and may have any
names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm import words
from flowsentry.llm.common import buffers, settle, utf8

BITS = 128
RADIUS = 4
BLOCKS = 6
SLICE = 512  # texts that a worker fingerprints at once
TERMS = 8192  # terms of a text that vote at once
CROWD = 512  # queries of a key from which it is cut into a grid
PAIRS = 1 << 20  # fingerprints compared at once


def _shingled(hashes: np.ndarray, doc: np.ndarray, documents: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the shingles of ``width`` words; fewer words than that are one shingle."""

    def rolled(starts: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(starts), size, np.uint64)
        for i in range(size):
            h = words._mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + i])
        return h

    count = np.bincount(doc, minlength=documents)
    first = np.cumsum(count) - count
    starts = np.arange(max(0, len(hashes) - width + 1))
    starts = starts[doc[starts] == doc[starts + width - 1]]
    found, owners = [rolled(starts, width)], [doc[starts]]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        found.append(rolled(first[short], size))
        owners.append(short)
    return np.concatenate(found), np.concatenate(owners)


def fingerprints(texts) -> np.ndarray:
    """The fingerprints of an Arrow string column, one row of two 64-bit words each."""
    offsets, data = buffers(texts)
    out = np.zeros((len(texts), BITS // 64), np.uint64)
    low = words.lowered(data)
    starts, ends = words.spans(offsets, low, words.is_space(low))
    hashes = words.span_hashes(low, starts, ends)
    doc = words.document_of(offsets, starts)
    shingles, owners = _shingled(hashes, doc, len(texts), words.SHINGLE)
    hashes, doc = np.concatenate([hashes, shingles]), np.concatenate([doc, owners])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weight = 2.0 * np.frexp(np.diff(np.append(at, len(hashes))).astype(np.float64))[1]
    hashes, doc = hashes[at], doc[at]
    wide = np.stack([hashes, words._mixed(hashes + np.uint64(0xA0761D6478BD642F))], axis=1)
    borders = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(borders)):
        votes, total = np.zeros(BITS), 1.0
        for low_at in range(borders[i], borders[i + 1], TERMS):
            part = slice(low_at, min(low_at + TERMS, borders[i + 1]))
            bits = np.unpackbits(wide[part].view(np.uint8), axis=1)
            votes += weight[part] @ bits
            total += weight[part].sum()
        votes += np.unpackbits(wide[borders[i]].view(np.uint8))
        out[i] = np.packbits(2 * votes > total).view(np.uint64)
    return out


_MADE = (
    "_part int, _edge int, _id {0}, _text string, n_chars long, edited_sha256 string, "
    "hi long, lo long, edited_hi long, edited_lo long, next_hi long, next_lo long"
)
COMPLETE, FIRST, LAST = 0, 1, 2


def _edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _complete(part: int, ids, texts, following, marks: np.ndarray, next_marks: np.ndarray, schema):
    """Whole result rows; ``marks`` are the fingerprints of ``texts``, ``next_marks`` those of ``following``."""
    import pyarrow as pa

    edited = [_edited(a, b) for a, b in zip(texts, following)]
    edited_marks = fingerprints(pa.array(edited, pa.large_string()))
    n = len(texts)
    columns = [
        pa.array(np.full(n, part, np.int32)),
        pa.array(np.full(n, COMPLETE, np.int32)),
        ids,
        pa.nulls(n, pa.string()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        *[pa.array(m[:, i].view(np.int64)) for m in (marks, edited_marks, next_marks) for i in (0, 1)],
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow_schema(spark, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def with_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, n_chars, edited_sha256`` and the words ``hi, lo`` of three fingerprints: the text's, its edited text's
    (``edited_``) and the following document's (``next_``).

    The texts are shuffled once, by ranges of the id (and, inside one id, of the text's hash), and streamed in order; a
    partition's first and last texts are kept in the written table, where the partitions meet.
    """
    import pyarrow as pa

    spark = df.sparkSession
    source = df.select(
        df[doc_id].alias("_id"), utf8(df[text]).alias("_text"), F.monotonically_increasing_id().alias("_salt")
    ).withColumn("_hash", F.xxhash64("_text"))
    by_range = [F.col("_id").desc_nulls_last(), F.col("_hash"), F.col("_salt")]
    along = [F.col("_id").desc_nulls_last(), F.col("_hash"), F.col("_text"), F.col("_salt")]
    ordered = source.repartitionByRange(*by_range).sortWithinPartitions(*along).select("_id", "_text")
    ddl = _MADE.format(source.schema["_id"].dataType.simpleString())
    schema = _arrow_schema(spark, ddl)

    def edge(part: int, kind: int, ids, text: str, mark: np.ndarray):
        values = [part, kind, None, text, len(text), None, *mark.view(np.int64).tolist(), None, None, None, None]
        columns = [pa.array([v], t) for v, t in zip(values, schema.types)]
        columns[2] = ids.cast(schema.types[2])
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # ids, text and fingerprint of the row before
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                ids, texts, marks = batch.column(0), batch.column(1).to_pylist(), fingerprints(batch.column(1))
                if held is None:
                    yield edge(part, FIRST, ids.slice(0, 1), texts[0], marks[0])
                else:
                    ids = pa.concat_arrays([held[0], ids])
                    texts, marks = [held[1], *texts], np.concatenate([held[2][None], marks])
                if len(texts) > 1:
                    yield _complete(part, ids.slice(0, len(texts) - 1), texts[:-1], texts[1:], marks[:-1], marks[1:], schema)
                held = ids.slice(len(texts) - 1, 1), texts[-1], marks[-1]
        if held is not None:
            yield edge(part, LAST, held[0], held[1], held[2])

    made = settle(ordered.mapInArrow(run, ddl), "simhash")

    # One row a partition: each last text meets the first text of the partition behind it.
    in_order = Window.orderBy("_part")
    follows = F.coalesce(F.lead("_part").over(in_order), F.first("_part").over(in_order))
    lasts = made.where(F.col("_edge") == LAST)
    after = lasts.select("_part").withColumn("_after", follows)
    firsts = made.where(F.col("_edge") == FIRST).select(
        F.col("_part").alias("_after"), F.col("_text").alias("_next"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo")
    )
    met = lasts.join(after, "_part").join(firsts, "_after").select("_part", "_id", "_text", "hi", "lo", "_next", "n_hi", "n_lo")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, n_hi, n_lo = (batch.column(i).to_numpy().view(np.uint64) for i in (3, 4, 6, 7))
            texts, following = batch.column(2).to_pylist(), batch.column(5).to_pylist()
            if texts:
                yield _complete(0, batch.column(1), texts, following, np.stack([hi, lo], 1), np.stack([n_hi, n_lo], 1), schema)

    closed = met.mapInArrow(close, ddl)
    return made.where(F.col("_edge") == COMPLETE).unionByName(closed).drop("_part", "_edge", "_text")


def text_of(hi: str, lo: str) -> Column:
    """The fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (hi, lo)]))


def likeness(hi: str, lo: str, other_hi: str, other_lo: str) -> Column:
    """The share of bits in which two fingerprints agree."""
    apart = F.bit_count(F.col(hi).bitwiseXOR(F.col(other_hi))) + F.bit_count(F.col(lo).bitwiseXOR(F.col(other_lo)))
    return 1 - apart / F.lit(float(BITS))


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> np.ndarray:
    """The masks of the tables' keys, two words each: every choice of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("needs 0 <= radius < blocks <= 128")
    borders = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << borders[i + 1]) - (1 << borders[i])) for i in range(blocks)]
    masks = [sum(chosen) for chosen in itertools.combinations(single, blocks - radius)]
    return np.array([[m >> 64, m & ((1 << 64) - 1)] for m in masks], np.uint64)


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``hi, lo, n_near`` for the fingerprints that ask: documents within ``radius`` bits, those of the same one included.

    ``prints (hi, lo, n, asks)`` has each fingerprint once: its documents and whether it is a query. More blocks make the keys
    longer and the tables more; a table much larger than 2^32 rows wants more than the default.
    """
    import pyarrow as pa

    masks = tables(radius, blocks)
    signed = masks.view(np.int64)
    key = [
        F.col(name).bitwiseAND(F.element_at(F.array(*[F.lit(int(v)) for v in signed[:, i]]), F.col("t") + 1)).alias(f"k{i}")
        for i, name in enumerate(("hi", "lo"))
    ]
    dealt = prints.select("hi", "lo", "n", "asks", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
    dealt = dealt.select("*", *key)
    names = ["t", "k0", "k1"]
    asked = dealt.where("asks").groupBy(names).agg(F.count(F.lit(1)).alias("queries"))
    crowded = settle(
        asked.where(F.col("queries") > CROWD).select(*names, F.ceil(F.col("queries") / CROWD).cast("long").alias("grid")), "crowded"
    )
    # Spark broadcasts the crowded keys only if they are few.
    placed = dealt.join(crowded, names, "left").withColumn("grid", F.coalesce("grid", F.lit(1).cast("long")))
    line, every = F.pmod(F.xxhash64("hi", "lo"), F.col("grid")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid") - 1))
    asking = placed.where("asks").select(*names, line.alias("row"), every.alias("cell"), F.lit(0).alias("kind"), "hi", "lo", "n")
    offered = placed.select(*names, every.alias("row"), line.alias("cell"), F.lit(1).alias("kind"), "hi", "lo", "n")
    place = [*names, "row", "cell"]
    met = asking.unionByName(offered).repartition(*place).sortWithinPartitions(*place, "kind")

    def count(x: np.ndarray, y: np.ndarray, n: np.ndarray, table: int) -> np.ndarray:
        """For each row of ``x`` the documents of the rows of ``y`` that it meets in this table first."""
        total = np.zeros(len(x), np.int64)
        step = max(1, PAIRS // len(x))
        for low in range(0, len(y), step):
            apart = x[:, None] ^ y[None, low : low + step]
            left, right = np.nonzero(np.bitwise_count(apart).sum(axis=2, dtype=np.int64) <= radius)
            apart = apart[left, right]
            first = np.ones(len(left), bool)
            for earlier in range(table):
                first &= ((apart & masks[earlier]) != 0).any(axis=1)
            np.add.at(total, left[first], n[low + right[first]])
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(marks: np.ndarray, totals: np.ndarray):
            columns = [marks[:, 0].view(np.int64), marks[:, 1].view(np.int64), totals]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hi", "lo", "n_near"])

        held, queries, totals = None, np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            kind, n = batch.column(5).to_numpy(), batch.column(8).to_numpy()
            marks = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in (6, 7)], axis=1)
            new = np.ones(len(where), bool)
            new[1:] = (where[1:] != where[:-1]).any(axis=1)
            new[0] = held is None or (where[0] != held).any()
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(where))
            pieces = list(zip(starts[kind[starts] == 0], ends[kind[starts] == 0]))
            if not new[0]:  # the key of the batch before goes on
                pieces.insert(0, (0, starts[0] if len(starts) else len(where)))
            done = []
            for start, end in pieces:
                if new[start]:
                    if len(queries):
                        done.append((queries, totals))
                    queries, totals = marks[:0], totals[:0]
                border = start + int(np.searchsorted(kind[start:end], 1))
                if border > start:
                    queries = np.concatenate([queries, marks[start:border]])
                    totals = np.concatenate([totals, np.zeros(border - start, np.int64)])
                if len(queries) and end > border:
                    totals = totals + count(queries, marks[border:end], n[border:end], int(where[start, 0]))
            if len(starts) and kind[starts[-1]] == 1 and len(queries):  # the last key has no query
                done.append((queries, totals))
                queries, totals = marks[:0], totals[:0]
            held = where[-1]
            if done:
                yield result(np.concatenate([q for q, _ in done]), np.concatenate([t for _, t in done]))
        if len(queries):
            yield result(queries, totals)

    found = met.mapInArrow(run, "hi long, lo long, n_near long")
    return found.groupBy("hi", "lo").agg(F.sum("n_near").alias("n_near"))


def with_near(marked: DataFrame, asks: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``marked`` (``hi, lo``) with ``n_near``: the other documents within ``radius`` bits, null for rows that do not ask."""
    asking = F.coalesce(asks, F.lit(False))
    prints = settle(marked.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max(asking).alias("asks")), "prints")
    counts = near_counts(prints, radius, blocks).withColumn("n_near", F.col("n_near") - 1)
    return (
        marked.where(asking)
        .join(counts, ["hi", "lo"], "left")
        .select(*marked.columns, "n_near")
        .unionByName(marked.where(~asking).withColumn("n_near", F.lit(None).cast("long")))
    )
