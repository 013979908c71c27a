"""Suffix arrays and common prefixes in numpy, for texts of up to about a million bytes."""

from __future__ import annotations

import numpy as np

# Three numbers of a position each (rank, rank further on, place) share one 64-bit sort key.
BITS = 20
LONGEST = (1 << BITS) - 8
FIRST = 5  # bytes of the first sort: they and the place share a key as well


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted places and the rank of each place, by Larsson and Sadakane's refinement.

    A rank is the first slot of its group. Each round sorts only the places whose group still has several,
    by the rank as many bytes further on as are sorted already, and so doubles the sorted length.
    """
    n = len(text)
    if n > LONGEST:
        raise ValueError("cut the text into shards first")
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    loads = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    keys = (loads >> np.uint64(64 - 8 * FIRST)) << np.uint64(BITS) | np.arange(n, dtype=np.uint64)
    del loads
    keys.sort()
    mask = np.uint64((1 << BITS) - 1)
    order = (keys & mask).astype(np.int64)
    rank = np.empty(n, np.int64)
    slots, places, heads = np.arange(n), order, keys >> np.uint64(BITS)
    depth = FIRST
    while len(slots):
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = heads[1:] != heads[:-1]
        first = np.flatnonzero(new[:-1])
        group = np.repeat(slots[first], np.diff(np.append(first, len(slots))))
        order[slots] = places
        rank[places] = group
        tied = ~(new[:-1] & new[1:])
        slots, places = slots[tied], places[tied]
        ahead = places + depth
        # Zero bytes were added behind the end: a suffix that ends within the sorted length is smaller
        # than all others of its group, the shorter the smaller.
        further = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + depth + 1, n - places).astype(np.uint64)
        keys = rank[places].astype(np.uint64) << np.uint64(2 * BITS + 1) | further << np.uint64(BITS) | places.astype(np.uint64)
        keys.sort()
        places = (keys & mask).astype(np.int64)
        heads = keys >> np.uint64(BITS)
        depth *= 2
    return order, rank


BLOCK = 128


def _lanes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of neighbouring places, cut at ``BLOCK``, the longest first."""
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1] + 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(places)))
    cuts = -(-sizes // BLOCK)
    number = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts = np.repeat(places[first], cuts) + number * BLOCK
    lengths = np.minimum(np.repeat(sizes, cuts) - number * BLOCK, BLOCK)
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, exact: bool = True) -> np.ndarray:
    """For each slot the bytes, ``most`` at most, that its suffix shares with that of the slot before.

    Kasai's walk in text order: one place further on, the shared prefix is at most one shorter. The walk
    runs over many stretches of the text side by side, one step of each at a time. Unless ``exact``, places
    where a few probes show that less than ``most`` bytes are shared are left out and get 0.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    loads = np.ndarray((n,), "<u8", padded, strides=(1,)).astype(np.uint64)
    places = np.flatnonzero(before >= 0)
    if not exact:
        for probe in sorted({0, max(0, most // 2 - 8), max(0, most - 8)}):
            places = places[np.maximum(places, before[places]) + probe < n]
            places = places[loads[places + probe] == loads[before[places] + probe]] if probe + 8 <= most else places
    shared = np.zeros(n, np.int64)
    starts, lengths = _lanes(places)
    height = np.zeros(len(starts), np.int64)
    for step in range(BLOCK):
        lanes = int(np.searchsorted(-lengths, -step, "left"))  # those longer than ``step``
        if not lanes:
            break
        place, height = starts[:lanes] + step, np.maximum(height[:lanes] - 1, 0)
        other = before[place]
        active = np.flatnonzero(height < most)
        while len(active):
            a, b = place[active] + height[active], other[active] + height[active]
            room = n - np.maximum(a, b)
            inside = room > 0
            if not inside.all():
                active, a, b, room = active[inside], a[inside], b[inside], room[inside]
            differ = loads[a] ^ loads[b]
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            equal = np.minimum(equal, room)
            height[active] += equal
            active = active[(equal == 8) & (height[active] < most)]
        height = np.minimum(height, most)
        shared[place] = height
    return shared[order]
