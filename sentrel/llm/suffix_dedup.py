"""Operator 6: byte-level removal of every long substring that occurs again.

Suffixes are dealt to buckets by the anchor of repeats.py and one bucket is settled
at a time, so memory is bounded by a bucket. Classes whose runs are all equal are
settled by their totals, hot classes by hashes of their windows. The suffixes of the
others are sorted: the positions of a
difference cover modulo PERIOD are ranked first, by doubling; then suffixes are taken
one block of equal leading bytes at a time, and ties longer than the leading bytes
are resolved by the ranks of the cover positions that two suffixes reach at the same
distance. Bytes decide there.

Empty and NULL texts give no bytes; a text under ``size`` bytes loses nothing; a
text that occurs twice loses all of its ``size``-byte windows in both rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sentrel.llm import repeats, seq
from sentrel.llm.seq import U

#: A perfect difference cover: any two positions reach cover positions at one common
#: distance below PERIOD.
PERIOD = 13
COVER = np.array([0, 1, 3, 9])
SLOT = np.array([{0: 0, 1: 1, 3: 2, 9: 3}.get(i, -1) for i in range(PERIOD)])
#: Windows sorted at a time; more only where more have the same first eight bytes.
BLOCK = 1 << 18
#: A bucket may have 2^32 cover positions and 2^31 ties, more than memory holds.
RANK_BITS = 32


def _symbols(buf: np.ndarray, offs: np.ndarray):
    return seq.BYTE_VALUES[buf], offs, buf, buf


def _keep(buf: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> list[bytes]:
    left = buf[~gone]
    n = np.concatenate(([0], np.cumsum(~gone)))[offs]
    data = left.tobytes()
    return [data[i:j] for i, j in zip(n[:-1].tolist(), n[1:].tolist())]


def split(size: int) -> tuple[int, int]:
    """(depth, edge): cover positions are ranked by their next ``depth`` bytes; a
    window's first and last ``edge`` bytes (12 to 24) are compared directly, so with
    any distance below PERIOD nothing of the window is left out. Windows of under 25
    bytes are compared directly alone."""
    depth = max(0, (size - PERIOD + 1) // PERIOD * PERIOD)
    return depth, size - depth


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros after the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    x = np.zeros(len(raw), U)
    for j in range(8):
        x <<= U(8)
        x |= padded[j : j + len(raw)]
    return x


def _ordinals(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among the different rows in order, from 1."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    at = seq.group_starts(*[k[order] for k in keys])
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(1, len(at) + 1), np.diff(np.append(at, len(order))))
    return out


def _bytes_at(w8: np.ndarray, p: np.ndarray, n: int) -> list[np.ndarray]:
    return [w8[p + i] >> U(8 * max(0, 8 - (n - i))) for i in range(0, n, 8)]


def cover_ranks(w8: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the cover positions, in order of position, by ``depth`` bytes."""
    n = len(w8)
    p = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
    p = p[p < n]
    rank = _ordinals(w8[p], w8[np.minimum(p + 8, n - 1)] >> U(8 * (16 - PERIOD)))
    done = 1
    while done < depth // PERIOD:
        more = min(done, depth // PERIOD - done)
        later = np.zeros_like(rank)
        later[: max(0, len(rank) - more * len(COVER))] = rank[more * len(COVER) :]
        rank = _ordinals((rank << 32) | later)
        done += more
    return rank


def repeated_windows(raw: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes from each of ``pos`` on start at another of ``pos``."""
    again = np.zeros(len(pos), bool)
    if not len(pos):
        return again
    depth, edge = split(size)
    w8 = eights(raw)
    ranks = cover_ranks(w8, depth) if depth else None
    lead = w8[pos] >> U(8 * max(0, 8 - edge))
    order = np.argsort(lead)
    at = seq.group_starts(lead[order])
    cuts = at[np.searchsorted(at, np.arange(0, len(pos), BLOCK), "left").clip(max=len(at) - 1)]
    cuts = np.unique(np.append(cuts, (0, len(pos))))
    del lead
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        m = order[i:j]
        p = pos[m]
        tie = _ordinals(*_bytes_at(w8, p, edge), *(_bytes_at(w8, p + depth, edge) if depth else ()))
        many = np.bincount(tie)[tie] > 1
        m, p, tie = m[many], p[many], tie[many]
        if not depth:
            again[m] = True
            continue
        for far in range(PERIOD):
            q = p + far
            k = SLOT[q % PERIOD]
            reached = np.flatnonzero(k >= 0)
            q, k = q[reached], k[reached]
            key = (tie[reached] << RANK_BITS) | ranks[q // PERIOD * len(COVER) + k]
            o = np.argsort(key)
            g = seq.group_starts(key[o])
            sizes = np.diff(np.append(g, len(o)))
            again[m[reached[o[np.repeat(sizes > 1, sizes)]]]] = True
    return again


def _settle(size: int):
    def f(a, r, n, v, c, raw) -> np.ndarray:
        """How often each window occurs in the bucket, 2 at most."""
        at = np.cumsum(n + size - 1) - (n + size - 1)
        again = repeated_windows(raw, repeats._ranges(at, at + n), size)
        return np.where(again, 2, np.repeat(c.astype(np.int64), n))

    return f


def rule(size: int = 200, gram: int = 64) -> repeats.Rule:
    return repeats.Rule(size, min(gram, size), np.uint8, False, _symbols, _settle(size), _keep, "binary")


def dedup_substrings(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """See repeats.remove_repeats; ``kept`` is binary, a cut may split a character."""
    return repeats.remove_repeats(docs, rule(size), id_col, text_col, carry)
