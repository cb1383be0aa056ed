"""Words of a text as numbers: spans and 64-bit hashes with numpy, whole texts in bounded pieces."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer word is hashed whole.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(14, n.bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, _U)
        down = np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of UTF-8 bytes; ASCII white space separates."""
    edges = np.diff(SPACE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = spans(data)
    if len(data) <= PIECE:
        return mix(_hash_piece(data, starts, ends)) if len(starts) else np.zeros(0, _U)
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        base = starts[at]
        out.append(_hash_piece(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base))
        at = to
    return mix(np.concatenate(out)) if out else np.zeros(0, _U)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles' hashes, sorted; with fewer words the whole sequence as one, without words none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    size = min(k, n)
    h = np.zeros(n - size + 1, _U)
    for j in range(size):
        h = h * _U(0x9FB21C651E98DF25) + words[j : n - size + 1 + j]
        h ^= h >> _U(29)
    return np.unique(mix(h + _U(size)))
