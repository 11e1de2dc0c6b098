"""Words and word windows of many texts as 64-bit hashes, in whole-array numpy steps.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. Its hash is a
polynomial over random byte codes modulo 2**64 (one running sum serves all words of a step), then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at once.
BLOCK = 1 << 18
_POWERS: dict[int, np.ndarray] = {}
#: Odd multipliers for the places of a window.
PLACES = np.random.default_rng(20240608).integers(0, 1 << 63, 16, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(BLOCK, n), base, U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if len(have) == BLOCK:
            _POWERS[base] = have
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): the words of text i are ``hashes[offsets[i]:offsets[i + 1]]``.

    Words are hashed in blocks of BLOCK bytes (a longer word is a block of its own), so what a step needs besides
    its result doesn't grow with a document.
    """
    if not texts:
        return np.zeros(0, U), np.zeros(1, np.int64)
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    start, end = edge[::2], edge[1::2]
    out, i = np.empty(len(start), U), 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        block = data[low : end[j - 1]]
        sums = np.zeros(len(block) + 1, U)
        np.cumsum(_CODES[block] * _powers(_BASE, len(block)), out=sums[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * _powers(_INV, len(block))[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out, np.searchsorted(start, begins)


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in each text, a shorter text's words being one run; and offsets."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    total = len(hashes)
    full = np.zeros(max(0, total - size + 1), U)
    for j in range(size):
        full += hashes[j : total - size + 1 + j] * PLACES[j]
    full = mix(full + U(size))
    at = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    got = full[np.minimum(at, max(0, len(full) - 1))] if len(full) else np.zeros(len(at), U)
    for i in np.flatnonzero((n > 0) & (n < size)):
        run = hashes[offsets[i] : offsets[i + 1]]
        got[out[i]] = mix((run * PLACES[: len(run)]).sum(dtype=U)[None] + U(len(run)))[0]
    return got, out


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each list, in ascending order; and offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[keep], np.searchsorted(o[keep], np.arange(len(offsets)))
