"""Vectorised words and word shingles of Arrow text columns.

A block of texts is one byte buffer with offsets.  Words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased),
their 64-bit hashes and the hashes of five-word shingles come from a few numpy passes over the
buffer, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_U = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = constants(256, 11) | _U(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0xB5AD4ECEDA1CE2A9
_BASE_INV = pow(_BASE, -1, 1 << 64)
_COEF = constants(WIDTH, 23) | _U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for k, b in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n, b, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes.

    A null is an empty text.  A single longer text is a block of its own: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and the index of each text's first word (one more at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    cut = offs[(offs > 0) & (offs < n)]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * up[:n], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9E6C63D0876A9A47))
    return h, np.searchsorted(starts, offs)


def shingles(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in text order, and each text's first one (one more at the end).

    A text of one to four words has its whole sequence as its only shingle; one without words none.
    """
    count = np.diff(at)
    per = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(to[-1], _U)
    with np.errstate(over="ignore"):
        m = len(h) - WIDTH + 1
        if m > 0:
            s = h[:m] * _COEF[0]
            for k in range(1, WIDTH):
                s += h[k : k + m] * _COEF[k]
            ok = np.ones(m, bool)
            for k in range(1, WIDTH):
                edge = at[1:] - k
                ok[edge[(edge >= 0) & (edge < m)]] = False
            long = np.repeat(count >= WIDTH, per)
            out[long] = mix(s[ok])
        for d in np.flatnonzero((count > 0) & (count < WIDTH)):
            s = _U(int(count[d]))
            for x in h[at[d] : at[d + 1]]:
                s = s * _COEF[0] + x
            out[to[d]] = mix(np.array([s], _U))[0]
    return out, to


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of a block, by first word; runs may cross the ends of texts."""
    n = len(h)
    if n < width:
        return np.zeros(0, _U)
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(h * up[:n], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, in order."""
    for _, _, buf, offs in blocks(column):
        s, to = shingles(*words(buf, offs))
        for a, b in zip(to[:-1], to[1:], strict=True):
            yield np.unique(s[a:b])
