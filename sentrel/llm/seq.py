"""Vectorised tokens, hashes and windows over batches of texts.

Words are runs of bytes outside x20 and x09-x0D of the UTF-8 text. Hashes are
64-bit polynomial hashes over random symbol values, mixed at the end; prefix sums
give the hash of any range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240501)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept and grown by doubling."""
    got = _POWERS.get(which)
    if got is None or len(got[0]) < n:
        size, b = max(n, 1 << 16, 2 * len(got[0]) if got else 0), int(BASES[which])
        out = []
        for x in (b, pow(b, -1, 1 << 64)):
            a = np.full(size, x, dtype=U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        got = _POWERS[which] = (out[0], out[1])
    return got


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


class Hasher:
    """Range hashes over one sequence of 64-bit symbol values."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        n = len(values)
        p, self.inverse = _powers(which, n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(x ^ ((end - start).astype(U) * U(0xA24BAED4963EE407)))

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k symbols in a row."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix(((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) ^ U(k * 0xA24BAED4963EE407 % (1 << 64)))


def batches(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts of about
    ``limit`` bytes; a longer text is a group of its own. NULL texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, o, d = texts.buffers()
    offs = np.frombuffer(o, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(d, dtype=np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of a group of texts: starts, ends, per-text offsets, hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> None:
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        solid = ~IS_SPACE[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:n]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.offs = np.searchsorted(self.starts, offs)

    def hashes(self) -> np.ndarray:
        return Hasher(BYTE_VALUES[self.buf], 0).ranges(self.starts, self.ends)


def window_starts(offs: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` symbols of one text begin."""
    n = np.maximum(np.diff(offs) - size + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.repeat(offs[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return first + np.arange(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, in about 2 log2(w) passes."""
    if len(x) < w:
        return x[:0]
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if step < w else x


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n symbols lie in a window that begins at one of ``starts``."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else None
    if len(starts) >= 64:
        d[:] = np.bincount(starts, minlength=n + 1)[: n + 1]
    d[size:] -= d[: n + 1 - size].copy() if len(starts) else 0
    return np.cumsum(d[:n]) > 0


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pack(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, bytes]]]:
    """Rows dealt to buckets, each bucket's columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cols = {k: v[order] for k, v in columns.items()}
    at = group_starts(b)
    for i, j in zip(at, np.append(at[1:], len(b))):
        yield int(b[i]), {k: v[i:j].tobytes() for k, v in cols.items()}


def unpack(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' values in one array, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) if x.is_valid else np.zeros(0, dtype) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], dtype=np.int64)
