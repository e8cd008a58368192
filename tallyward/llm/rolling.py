"""Polynomial hashes of words and of rolling windows, in numpy over whole arrays.

All arithmetic is modulo 2**64. A window's hash is a difference of prefix sums times an inverse power of an odd base, and
a final mix; equal windows have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BLOCK_BYTES = 1 << 22
_LONG_WORD = 4096
_CHUNK = 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_WORD_POWERS = _powers(0xD6E8FEB86659FD93, _LONG_WORD)
_POWERS = {b: (_powers(b, _CHUNK + 1), _powers(pow(b, -1, 1 << 64), _CHUNK + 1)) for b in BASES}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (run of bytes other than 20 and 09 to 0D), in order; long texts go in blocks."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK_BYTES)
        if end < len(data):
            cut = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, end - at, at)])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # a word longer than the block
                rest = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, -1, end)])
                end = end + int(rest[0]) if len(rest) else len(data)
        found.append(_block_hashes(data, at, end))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _block_hashes(data: bytes, at: int, end: int) -> np.ndarray:
    octets = np.frombuffer(data, np.uint8, end - at, at)
    inside = np.concatenate(([False], ~_SPACE[octets], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    offset = np.arange(len(octets)) - np.repeat(starts, np.diff(np.append(starts, len(octets)))) if starts[0] == 0 else None
    if offset is None:
        offset = np.arange(len(octets)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(octets)]))))
    values = _TABLE[octets] * _WORD_POWERS[np.minimum(offset, _LONG_WORD - 1)]
    values[_SPACE[octets]] = 0
    lengths = ends - starts
    out = mixed(np.add.reduceat(values, starts) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths >= _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[at + starts[i] : at + ends[i]])
    return out


def windows(items: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """The hash of each run of ``size`` consecutive items."""
    n = len(items) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers, inverse = _POWERS[base]
    out, step = np.empty(n, np.uint64), _CHUNK - size
    for at in range(0, n, step):
        part = items[at : at + step + size - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)], dtype=np.uint64)))
        m = len(part) - size + 1
        out[at : at + m] = (sums[size:] - sums[:m]) * inverse[:m]
    return mixed(out)
