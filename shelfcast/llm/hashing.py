"""64-bit hashes of many words or byte windows of a text at once, in numpy.

A window's hash is a difference of prefix sums of ``(byte + 1) * B^i``
modulo 2^64, moved to offset 0 by a power of B's inverse: equal bytes hash
alike wherever they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_KEPT = 1 << 18


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=1)
def _kept() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, _KEPT), _powers(pow(_BASE, -1, 2 ** 64), _KEPT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if n <= _KEPT:
        up, down = _kept()
        return up[:n], down[:n]
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 2 ** 64), n)


def prefix_sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:len(data)], out=sums[1:])
    return sums


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, block: int = _KEPT) -> np.ndarray:
    """Hashes of the words (runs of bytes other than ASCII white space), in order."""
    out, start = [], 0
    while start < len(data):
        end = min(start + block, len(data))
        while end < len(data) and not _SPACE[data[end]]:      # a block ends between words
            ahead = np.flatnonzero(_SPACE[data[end:end + block]])
            end = end + int(ahead[0]) if len(ahead) else min(end + block, len(data))
        part = data[start:end]
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[part], True].view(np.int8)))
        first, last = edge[::2], edge[1::2]
        up, down = powers(len(part) + 1)
        sums = prefix_sums(part, up)
        out.append(mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(U)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, U)
