"""Words and shingles of many documents at once, as numpy arrays over an Arrow text buffer."""

from __future__ import annotations

import numpy as np

SHINGLE = 5


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with the ASCII letters A-Z in lower case."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(offsets: np.ndarray, data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``gap``; no run crosses a document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    starts = np.flatnonzero(inside & (before | border[:-1]))
    ends = np.flatnonzero(inside & (after | border[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active, place = np.arange(len(starts)), starts.copy()
    while len(active):
        take = np.minimum(left[active], 8).astype(np.uint64)
        word = loads[place[active]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - take * np.uint64(8)))
        h[active] = _mixed(h[active] ^ word) + np.uint64(0x632BE59BD9B4E019)
        place[active] += 8
        left[active] -= 8
        active = active[left[active] > 0]
    return h


def document_of(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, places, "right") - 1


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of one document's shingles, sorted.

    With fewer words than ``size`` the whole sequence is one shingle; without words there is none.
    """
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    h = np.full(count, width, np.uint64)
    for i in range(width):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    return np.unique(h)
