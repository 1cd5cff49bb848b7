"""Anchors: places in byte strings that depend on the bytes around them only.

Every window of a text has one anchor, the gram of least hash in it (the first, if grams repeat). Equal windows have
their anchors at equal places, wherever they stand, and neighbouring windows mostly share theirs: the windows of a text
fall into runs with one anchor each.
"""

from __future__ import annotations

import numpy as np

from pulsegrid.llm.shingles import mixed

GRAM = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_PLACES = 24  # bits of a place in a piece


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64)), dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of a text in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.append(np.uint64(0), np.cumsum(_VALUE[data] * _powers(int(_BASE), n)[:n], dtype=np.uint64))
        self.back = _powers(pow(int(_BASE), -1, 1 << 64), n)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, from minima inside blocks of that width."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.append(x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def window_runs(hashes: Hashes, n: int, window: int, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of a text of n bytes: first start, last start, and the place of their anchor."""
    firsts, anchors = [], []
    width = window - GRAM + 1
    for low in range(0, max(0, n - window + 1), piece):
        high = min(low + piece, n - window + 1)  # starts low to high - 1
        at = np.arange(low, high + width - 1)
        gram = (hashes.sums[at + GRAM] - hashes.sums[at]) * hashes.back[at]
        packed = mixed(gram) >> np.uint64(_PLACES) << np.uint64(_PLACES) | (at - low).astype(np.uint64)
        place = (sliding_min(packed, width) & np.uint64((1 << _PLACES) - 1)).astype(np.int64) + low
        change = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        firsts.append(change + low)
        anchors.append(place[change])
    if not firsts:
        return (np.empty(0, np.int64),) * 3
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    return first, np.append(first[1:] - 1, n - window), anchor
