"""The split fold against a plain loop, with keys spread over many partitions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsentry.operators import ordered
from flowsentry.operators.ordered import ResettingSet, ResettingSum, RunningCount, split_fold

KEYS, ORDER = ["src_ip", "sid"], ["ts_us", "pid"]


def plain_sum(values, limit):
    total, hits = 0, []
    for at, value in enumerate(values):
        total += value
        if total > limit:
            hits.append((at, total))
            total = 0
    return hits, [total]


def plain_set(values, limit):
    seen, hits = set(), []
    for at, value in enumerate(values):
        seen.add(value)
        if len(seen) > limit:
            hits.append((at, len(seen)))
            seen = set()
    return hits, sorted(seen)


def pieces_of(values, cuts):
    edges = sorted({0, len(values), *[cut % (len(values) + 1) for cut in cuts]})
    return [np.array(values[a:b], dtype=np.int64) for a, b in zip(edges, edges[1:])]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(0, 9), min_size=1, max_size=120),
    st.lists(st.integers(0, 200), max_size=8),
    st.integers(0, 40),
)
@pytest.mark.parametrize("kind", ["sum", "set"])
def test_effects_compose_to_the_plain_loop(kind, values, cuts, limit):
    fold, plain = (ResettingSum(limit), plain_sum) if kind == "sum" else (ResettingSet(limit % 7), plain_set)
    hits, state = plain(values, fold.limit)
    run_state, at, measure = fold.run(fold.start, np.array(values, dtype=np.int64))
    assert list(zip(at.tolist(), measure.tolist())) == hits
    assert run_state == state

    pieces = pieces_of(values, cuts)
    stepped, effect = fold.start, None
    for piece in pieces:
        after, _, _ = fold.run(stepped, piece)
        assert fold.apply(fold.effect(piece), stepped) == after
        stepped = after
        effect = fold.effect(piece) if effect is None else fold.compose(effect, fold.effect(piece))
    assert fold.apply(effect, fold.start) == state


def rows_of(seed, rows):
    rng = random.Random(seed)
    data = []
    for pid in range(rows):
        # One source holds most rows, and times repeat.
        src = "hot" if rng.random() < 0.7 else f"s{rng.randrange(30)}"
        data.append((pid, rng.randrange(rows // 4), src, rng.randrange(2) if src != "hot" else 0, rng.randrange(40)))
    return data


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("stretch", [2, 64])
@pytest.mark.parametrize("kind", ["sum", "set", "count"])
def test_split_fold(spark, kind, partitions, stretch, monkeypatch):
    if stretch == 2:  # entry states that are too many to broadcast
        monkeypatch.setattr(ordered, "BROADCAST_ENTRIES", 0)
    data = rows_of(partitions, 3000)
    schema = "pid long, ts_us long, src_ip string, sid long, value int"
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = spark.createDataFrame(data, schema)
        fold = {
            "sum": ResettingSum(100),
            "set": ResettingSet(10),
            "count": RunningCount(lambda numbers: numbers % 7 == 0),
        }[kind]
        found = split_fold(rows, fold, KEYS, ORDER, "value", stretch).select("pid", "measure").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    expected = set()
    for key in {(row[2], row[3]) for row in data}:
        group = sorted((row for row in data if (row[2], row[3]) == key), key=lambda row: (row[1], row[0]))
        values = [row[4] for row in group]
        if kind == "count":
            hits = [(at, at + 1) for at in range(len(values)) if (at + 1) % 7 == 0]
        else:
            hits = (plain_sum if kind == "sum" else plain_set)(values, fold.limit)[0]
        expected |= {(group[at][0], measure) for at, measure in hits}
    assert {tuple(row) for row in found} == expected
    assert len(found) == len(expected)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "pid long, ts_us long, src_ip string, sid long, value int")
    assert split_fold(rows, ResettingSum(1), KEYS, ORDER, "value").count() == 0


def test_no_task_chains_more_than_a_stretch(spark, monkeypatch):
    """40 summaries in stretches of 2: every task that merges or chains sees two at most."""
    most = spark.sparkContext.accumulator(0)
    seen = spark.sparkContext.accumulator(0)
    read = ordered._read

    def counted(frame):
        seen.add(1)
        most.add(max(0, len(frame) - 2))
        return read(frame)

    monkeypatch.setattr(ordered, "_read", counted)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(rows_of(1, 3000), "pid long, ts_us long, src_ip string, sid long, value int")
        assert split_fold(rows, ResettingSum(100), KEYS, ORDER, "value", 2).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen.value > 20 and most.value == 0
