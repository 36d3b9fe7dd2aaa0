"""Words of whole texts as hashes, worked out on byte buffers.

A-Z are lower-cased; a word is a run of digits, a-z and any non-ASCII character, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. All bytes of a non-ASCII character in UTF-8 are above 0x7F, so the rule
holds byte by byte.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)

_SPAN = 1 << 18
#: Longer words are hashed one by one.
_LONG = 4096
_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_SPAN + _LONG + 1, base, dtype=np.uint64)
            table[0] = 1
            _POWERS.append(np.multiply.accumulate(table))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, index of each row's first word, plus the end)."""
    low = LOWER[data]
    is_word = IS_WORD[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes from running sums, in spans of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    power, inverse = _powers()
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(starts, base + _SPAN, side="left")))
        if ends[first] - base > _LONG:
            out[first] = xxhash.xxh64_intdigest(low[base:ends[first]].tobytes())
            first += 1
            continue
        if ends[last - 1] - base > _SPAN + _LONG:
            last -= 1
        s, e = starts[first:last] - base, ends[first:last] - base
        sums = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum((low[base:base + int(e[-1])].astype(np.uint64) + np.uint64(1)) * power[:int(e[-1])], out=sums[1:])
        part = (sums[e] - sums[s]) * inverse[s]
        for k in np.flatnonzero(e - s > _LONG):
            part[k] = xxhash.xxh64_intdigest(low[base + s[k]:base + e[k]].tobytes())
        out[first:last] = part
        first = last
    return mix(out)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k - 1 positions have none)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(_GRAM) + words[j:j + n]
    return mix(h)


def inside(first_word: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over n gram positions: those whose k words belong to one row."""
    ok = np.ones(n, bool)
    for back in range(1, k):
        cut = first_word[1:] - back
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok
