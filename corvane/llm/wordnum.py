"""Words, word hashes and shingles of a block of texts by numpy, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and odd factors for the places in a shingle.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
#: Others, for a second hash that is independent of the first.
BYTE_2 = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 256, dtype=np.uint64)
PLACE = _rng.integers(1, 2**62, 64, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: [^\x20\x09-\x0D]+, and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64, at least n + 1 of each; kept up to 8 M."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    inverse = pow(_BASE, -1, 1 << 64)
    made = []
    for b in (_BASE, inverse):
        p = np.full(n + 1, b, _U)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 8 << 20:
        _powers[:] = made
    return made[0], made[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word in a block, and the n + 1 word offsets of its texts."""
    mask = np.zeros(len(raw) + 2, bool)
    mask[1:-1] = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at[:-1]] = True
    begin = mask[1:-1] & (edge[:-1] | ~mask[:-2])
    edge[:] = False
    edge[at[1:]] = True
    end = mask[1:-1] & (edge[1:] | ~mask[2:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, values: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each word by its bytes' values; fold: A-Z count as a-z."""
    if not len(starts):
        return np.empty(0, _U)
    power, inverse = _tables(len(raw))
    sums = np.zeros(len(raw) + 1, _U)
    table = values[LOWER] if fold else values
    np.cumsum(table[raw] * power[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of one text's k-word shingles by their words' hashes; fewer words: the whole as one."""
    n = len(h)
    if not n:
        return h
    m = min(n, k)
    out = np.zeros(n - m + 1, _U)
    for j in range(m):
        out += h[j : n - m + 1 + j] * PLACE[j]
    return mixed(out + _U(m))
