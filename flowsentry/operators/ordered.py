"""Folds over the ordered packets of a key, split over many tasks.

A fold whose result feeds back into its state (a sum or a set that is cleared when a rule fires)
is no window function, and folding a key in one task fails when one source owns a large part of
the table. Instead:

1. rows are range-partitioned by key and event order, so a large key spans many partitions and
   every partition has about the same size; the layout is checkpointed, which fixes it;
2. every partition is summed up by one row: the exit state of its last key, or, if a single key
   fills it, a table that gives the exit state for any entry state;
3. the summaries are chained to the entry state of every partition, first merged in stretches
   side by side, so that one task sees only a summary per stretch;
4. every partition is folded once more from its entry state and gives the hits.

A fold is exact whatever the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.session import ensure_checkpoint_dir

# Entry states of up to this many partitions are broadcast, a few hundred bytes each.
BROADCAST_ENTRIES = 20_000
SUMMARY_SCHEMA = (
    "stretch bigint, part bigint, first_key string, last_key string, whole boolean, "
    "exit_state array<bigint>, effect array<array<bigint>>"
)
_SUMMARY_ARROW = pa.schema(
    [
        ("stretch", pa.int64()),
        ("part", pa.int64()),
        ("first_key", pa.string()),
        ("last_key", pa.string()),
        ("whole", pa.bool_()),
        ("exit_state", pa.list_(pa.int64())),
        ("effect", pa.list_(pa.list_(pa.int64()))),
    ]
)


class RunningCount:
    """State: the number of rows so far. Gives the rows whose number is picked."""

    start: list[int] = [0]

    def __init__(self, pick=None):
        self.pick = pick

    def run(self, state, values):
        numbers = state[0] + 1 + np.arange(len(values), dtype=np.int64)
        hits = np.arange(len(values)) if self.pick is None else np.flatnonzero(self.pick(numbers))
        return [state[0] + len(values)], hits, numbers[hits]

    def effect(self, values):
        return [[len(values)]]

    def apply(self, effect, state):
        return [state[0] + effect[0][0]]

    def compose(self, first, second):
        return [[first[0][0] + second[0][0]]]


class ResettingSum:
    """State: the sum since the last hit. A row that lifts it above the limit is a hit."""

    start: list[int] = [0]

    def __init__(self, limit: int):
        self.limit = limit

    def run(self, state, values):
        sums = np.cumsum(values, dtype=np.int64)
        base = -state[0]
        hits, totals = [], []
        while True:
            at = int(np.searchsorted(sums, base + self.limit, side="right"))
            if at >= len(sums):
                break
            hits.append(at)
            totals.append(int(sums[at]) - base)
            base = int(sums[at])
        total = int(sums[-1]) if len(sums) else 0
        return [total - base], np.array(hits, dtype=np.int64), np.array(totals, dtype=np.int64)

    def effect(self, values):
        """Entry sums above ``floors[i]`` fire first at the i-th candidate and leave ``exits[i]``."""
        sums = np.cumsum(values, dtype=np.int64)
        total = int(sums[-1])
        # After a hit at a row, the next hit and in the end the exit sum follow from the row alone.
        following = np.searchsorted(sums, sums + self.limit, side="right")
        candidates = min(int(np.searchsorted(sums, self.limit, side="right")) + 1, len(sums))
        at = np.arange(candidates)
        while True:
            ahead = following[at]
            more = ahead < len(sums)
            if not more.any():
                break
            at = np.where(more, ahead, at)
        floors, exits = self.limit - sums[:candidates], total - sums[at]
        # Neighbours with one exit are one step of the function.
        keep = np.append(exits[1:] != exits[:-1], True)
        return [floors[keep].tolist(), exits[keep].tolist(), [total]]

    def _leave(self, effect, states) -> np.ndarray:
        floors, exits, total = (np.asarray(part, dtype=np.int64) for part in effect)
        # Floors descend, so the first one below the entry sum is found from the other end.
        at = len(floors) - np.searchsorted(floors[::-1], states, side="left")
        hit = at < len(floors)
        return np.where(hit, exits[np.where(hit, at, 0)], states + total[0])

    def apply(self, effect, state):
        return self._leave(effect, np.asarray(state, dtype=np.int64)).tolist()

    def compose(self, first, second):
        floors, exits = first[0], self._leave(second, np.asarray(first[1], dtype=np.int64)).tolist()
        total = first[2][0]
        if total <= self.limit:
            # Entry sums too small for a hit in the first part may give one in the second.
            floors = floors + [floor - total for floor in second[0]]
            exits = exits + second[1]
        return [floors, exits, [total + second[2][0]]]


class ResettingSet:
    """State: the distinct values since the last hit. The row that makes them too many is a hit."""

    start: list[int] = []

    def __init__(self, limit: int):
        self.limit = limit

    def run(self, state, values):
        seen, hits = set(state), []
        for at, value in enumerate(values.tolist()):
            seen.add(value)
            if len(seen) > self.limit:
                hits.append(at)
                seen.clear()
        return sorted(seen), np.array(hits, dtype=np.int64), np.full(len(hits), self.limit + 1, dtype=np.int64)

    def effect(self, values):
        """The first new values in order, and the set left behind by a first hit at each of them."""
        fresh, at = np.unique(values, return_index=True)
        order = np.argsort(at)[: self.limit + 1]
        fresh, at = fresh[order], at[order]
        after_hit = self._next_hits(values)
        exits = []
        for start in (at + 1).tolist():
            while start < len(values) and after_hit[start] < len(values):
                start = after_hit[start] + 1
            exits.append(np.unique(values[start:]).tolist())
        return [fresh.tolist(), *exits]

    def _next_hits(self, values) -> list[int]:
        """For every start, the row of the next hit of a set that is empty before it."""
        rows = values.tolist()
        found, counts, end = [], {}, 0
        for start, value in enumerate(rows):
            while end < len(rows) and len(counts) <= self.limit:
                counts[rows[end]] = counts.get(rows[end], 0) + 1
                end += 1
            found.append(end - 1 if len(counts) > self.limit else len(rows))
            counts[value] -= 1
            if not counts[value]:
                del counts[value]
        return found

    def apply(self, effect, state):
        seen = set(state)
        for value, left in zip(effect[0], effect[1:]):
            seen.add(value)
            if len(seen) > self.limit:
                return sorted(left)
        return sorted(seen)

    def compose(self, first, second):
        fresh = list(first[0])
        exits = [self.apply(second, left) for left in first[1:]]
        for value, left in zip(second[0], second[1:]):
            if len(fresh) > self.limit:
                break
            if value not in fresh:
                fresh.append(value)
                exits.append(list(left))
        return [fresh, *exits]


class Summary(NamedTuple):
    """What a partition, or a stretch of them, does to the state that enters it."""

    first_key: str
    last_key: str
    whole: bool
    exit_state: list[int] | None
    effect: list[list[int]] | None

    def leave(self, fold, key: str | None, state) -> tuple[str, list[int]]:
        if not self.whole:
            return self.last_key, self.exit_state
        return self.last_key, fold.apply(self.effect, state if key == self.first_key else fold.start)

    def followed_by(self, fold, other: Summary) -> Summary:
        if self.whole and other.whole and self.first_key == other.first_key:
            return Summary(self.first_key, self.last_key, True, None, fold.compose(self.effect, other.effect))
        key, state = (self.first_key, fold.start) if self.whole else (self.last_key, self.exit_state)
        last_key, exit_state = other.leave(fold, key, state)
        return Summary(self.first_key, last_key, False, exit_state, None)


def lay_out(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in even, ordered partitions that stay as they are, numbered by ``part``; ``first`` marks their first row."""
    ensure_checkpoint_dir(rows.sparkSession)
    laid = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return laid.withColumns({"part": F.spark_partition_id().cast("bigint"), "first": row == 0}).checkpoint()


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[str, int, int]]:
    """Stretches of rows with one key."""
    rows = batch.num_rows
    changed = np.zeros(rows, dtype=bool)
    changed[0] = True
    for key in keys:
        column = batch.column(key)
        differs = pc.not_equal(column.slice(1), column.slice(0, rows - 1))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(changed)
    names = batch.select(keys).take(pa.array(starts)).to_pylist()
    edges = starts.tolist()
    for name, start, end in zip(names, edges, [*edges[1:], rows]):
        yield repr(tuple(name.values())), start, end


def _summaries(fold, keys: list[str], value: str, stretch: int):
    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = current = None
        whole, pieces = True, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            values = batch.column(value).to_numpy()
            for key, start, end in _runs(batch, keys):
                if key != current:
                    whole, pieces, current = current is None, [], key
                    first = first or key
                pieces.append(values[start:end])
        if current is None:
            return
        values = np.concatenate(pieces)
        row = {
            "stretch": part // stretch,
            "part": part,
            "first_key": first,
            "last_key": current,
            "whole": whole,
            "exit_state": None if whole else fold.run(fold.start, values)[0],
            "effect": fold.effect(values) if whole else None,
        }
        yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY_ARROW)

    return summarise


def _read(frame: pd.DataFrame) -> Iterator[tuple[int, int, Summary]]:
    for row in frame.itertuples(index=False):
        state = None if row.exit_state is None else [int(x) for x in row.exit_state]
        effect = None if row.effect is None else [[int(x) for x in part] for part in row.effect]
        yield row.stretch, row.part, Summary(row.first_key, row.last_key, bool(row.whole), state, effect)


def _merge_stretch(fold):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        stretch = part = merged = None
        for stretch, part, summary in _read(frame.sort_values("part")):
            merged = summary if merged is None else merged.followed_by(fold, summary)
        return pd.DataFrame([{"stretch": stretch, "part": part, **merged._asdict()}])

    return merge


def _entries(fold, frame: pd.DataFrame, key: str | None, state: list[int]):
    """Entry key and state of every summary in the frame, and what the last one leaves."""
    entries = []
    for stretch, part, summary in _read(frame):
        entries.append((stretch, part, key, state))
        key, state = summary.leave(fold, key, state)
    return pd.DataFrame(entries, columns=["stretch", "part", "entry_key", "entry_state"]), key, state


def _chain(fold):
    def chain(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, fold.start
        for frame in batches:
            entries, key, state = _entries(fold, frame, key, state)
            yield entries

    return chain


def _chain_stretch(fold):
    def chain(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        key, state = entry["entry_key"].iat[0], [int(x) for x in entry["entry_state"].iat[0]]
        return _entries(fold, frame.sort_values("part"), key, state)[0]

    return chain


def _hits(fold, keys: list[str], value: str, columns: list[str]):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, fold.start
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(value).to_numpy()
            found, measures = [], []
            parts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)).tolist()
            edges = sorted({0, *parts, batch.num_rows})
            for low, high in zip(edges, edges[1:]):
                if low in parts:  # a partition of the layout starts here, with its entry state if it has one
                    current = batch.column("entry_key")[low].as_py()
                    state = batch.column("entry_state")[low].as_py()
                for key, start, end in _runs(batch.slice(low, high - low), keys):
                    if key != current:
                        current, state = key, fold.start
                    state, hits, measure = fold.run(state, values[low + start : low + end])
                    found.append(hits + low + start)
                    measures.append(measure)
            picked = batch.select(columns).take(pa.array(np.concatenate(found), type=pa.int64()))
            measure = pa.array(np.concatenate(measures), type=pa.int64())
            yield pa.RecordBatch.from_arrays([*picked.columns, measure], names=[*columns, "measure"])

    return emit


_ENTRY = "stretch bigint, part bigint, entry_key string, entry_state array<bigint>"


def _entry_states(fold, summaries: DataFrame, stretch: int, parts: int) -> DataFrame:
    """The entry state of every summary. No task takes more than ``stretch`` summaries.

    Stretches are merged to one summary each, level by level until one stretch is left; entry states go
    back down the same way.
    """
    if parts <= stretch:
        return summaries.repartition(1).sortWithinPartitions("part").mapInPandas(_chain(fold), _ENTRY)
    by_stretch = summaries.groupBy("stretch")
    merged = by_stretch.applyInPandas(_merge_stretch(fold), SUMMARY_SCHEMA)
    upper = merged.withColumns({"part": F.col("stretch"), "stretch": F.floor(F.col("stretch") / stretch)}).checkpoint()
    above = _entry_states(fold, upper, stretch, -(-parts // stretch))
    handed = above.select(F.col("part").alias("stretch"), "part", "entry_key", "entry_state")
    return by_stretch.cogroup(handed.groupBy("stretch")).applyInPandas(_chain_stretch(fold), _ENTRY)


def split_fold(
    rows: DataFrame,
    fold,
    keys: list[str],
    order: list[str],
    value: str,
    stretch: int = 64,
) -> DataFrame:
    """The rows at which the fold hits, with the ``measure`` of the hit.

    ``value`` is an integer column without NULLs. A summary holds at most as many numbers as the
    fold can tell entry states apart: one, the packets within the limit, or limit squared.
    """
    laid = lay_out(rows, keys, order)
    columns = rows.columns
    summaries = (
        laid.select("part", *keys, value)
        .mapInArrow(_summaries(fold, keys, value, stretch), SUMMARY_SCHEMA)
        .checkpoint()
    )
    parts = summaries.agg(F.max("part")).first()[0]
    entries = _entry_states(fold, summaries, stretch, 0 if parts is None else parts + 1).drop("stretch")
    entries = entries.checkpoint()
    small = entries.count() <= BROADCAST_ENTRIES
    with_entry = laid.join(F.broadcast(entries) if small else entries, "part", "left")
    if not small:  # the join has moved the rows: put each partition's together and in order again
        with_entry = with_entry.repartition("part").sortWithinPartitions("part", *keys, *order)
    # Only the first row of a partition needs the entry state.
    first_only = {name: F.when(F.col("first"), F.col(name)) for name in ("entry_key", "entry_state")}
    prepared = with_entry.withColumns(first_only).drop("part")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return prepared.mapInArrow(_hits(fold, keys, value, columns), f"{kinds}, measure bigint")
