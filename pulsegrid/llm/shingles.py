"""Word shingles of texts as 64-bit hashes, computed on whole byte arrays inside Python tasks."""

from __future__ import annotations

import numpy as np

# The six separators as bytes. Lower-casing touches A-Z only.
SEPARATORS = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[list(SEPARATORS)] = True
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                         0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and how many words each text has.

    A word's hash depends on its lower-cased bytes only: a sum of byte values times an odd number of each place, which
    follow no rule, then mixed. (Powers of one number would not do: they hash some long words alike, whatever the number.)
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = _GAP[data]
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    ends = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), dtype=np.int64)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(data))))
    factors = mixed(np.arange(1, int((ends - starts).max()) + 2, dtype=np.uint64) * _MULTIPLIERS[0]) | np.uint64(1)
    value = _BYTE[_LOWER[data]] * factors[np.where(gap, 0, place)]
    value[gap] = 0
    words = np.add.reduceat(value, starts)
    bounds = np.append(0, np.cumsum(sizes + 1))
    return mixed(words + (ends - starts).astype(np.uint64)), np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `size` words; of its whole sequence if it has fewer words."""
    words, counts = word_hashes(texts)
    full = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        full += words[k:k + len(full)] * _MULTIPLIERS[k % 8] + np.uint64(k)
    full = mixed(full)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= size:
            sets.append(np.unique(full[at:at + n - size + 1]))
        elif n:
            sets.append(mixed((words[at:at + n] * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            sets.append(full[:0])
        at += n
    return sets
