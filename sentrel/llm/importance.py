"""Operator 5: quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams: one of target texts
(good labels, a sample of at most ``max_target`` ids), one of all texts. A text's log
weight is ``length`` times the mean log ratio of its n-grams, less that of target text:
the sum over ``length`` typical n-grams (``length=None``: over all its own, so that
long texts have the largest weights). ``length`` is a temperature: adding Gumbel noise
by row and keeping the k largest keys samples k texts without replacement, each draw
in proportion to exp(log weight), and at the default the noise decides between texts
of like quality.

k is ``keep`` of all rows; by default the share of good ones among the labels. The
tables have 2^``bits`` entries whatever the corpus. NULL and empty texts have weight
-inf and are kept last; ties go to the smaller id, NULL last; no labels at all: every
ratio is 0. Rows with equal ids are weighed and drawn one by one, and all count as
target text where their id is a good one. Ids must be numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sentrel.llm import graph, seq
from sentrel.llm.repeats import LAST
from sentrel.llm.seq import U

SLICES = 64


def features(buf: np.ndarray, offs: np.ndarray, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every n-gram of a group of texts."""
    w = seq.Words(buf, offs, lower=True)
    h = w.hashes()
    hasher = seq.Hasher(h, 1)
    f, t = [], []
    for n in orders:
        at = seq.window_starts(w.offs, n)
        g = seq.mix(h[at]) if n == 1 else hasher.grams(n)[at]
        f.append((g >> U(64 - bits)).astype(np.int64))
        t.append(np.searchsorted(w.offs, at, "right") - 1)
    return np.concatenate(f), np.concatenate(t)


def _counts(target: np.ndarray, bits: int, orders: tuple[int, ...]):
    def f(batches):
        size = 1 << bits
        raw, tgt = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            ids = b.column("_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            good = target[np.minimum(np.searchsorted(target, ids), len(target) - 1)] == ids if len(target) else np.zeros(len(ids), bool)
            for i, j, buf, offs in seq.batches(b.column("_text")):
                x, t = features(buf, offs, bits, orders)
                raw += np.bincount(x, minlength=size)
                m = good[i:j][t]
                if m.any():
                    tgt += np.bincount(x[m], minlength=size)
        per = size // SLICES
        rows = [(s, raw[s * per : (s + 1) * per], tgt[s * per : (s + 1) * per]) for s in range(SLICES)]
        idx = [np.flatnonzero(r).astype(np.int32) for _, r, _ in rows]
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array([r[0] for r in rows], pa.int64()), "i": pa.array([k.tobytes() for k in idx], pa.binary()),
            "r": pa.array([r[1][k].tobytes() for r, k in zip(rows, idx)], pa.binary()), "t": pa.array([r[2][k].tobytes() for r, k in zip(rows, idx)], pa.binary()),
        })

    return f


def _add(bits: int):
    def f(t):
        per = (1 << bits) // SLICES
        i = seq.unpack(t.column("i"), np.int32)[0].astype(np.int64)
        out = []
        for c in ("r", "t"):
            total = np.zeros(per, np.int64)
            np.add.at(total, i, seq.unpack(t.column(c), np.int64)[0])
            out.append(total)
        return pa.table({"slice": t.column("slice").slice(0, 1), "r": pa.array([out[0].tobytes()], pa.binary()), "t": pa.array([out[1].tobytes()], pa.binary())})

    return f


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = 5.0) -> tuple[np.ndarray, float]:
    """(log ratio of each feature, its mean over target text). ``prior`` counts of
    the raw model are added to both sides, so rare features say little."""
    share = target.sum() / max(1, raw.sum())
    expected = raw * share
    ratio = np.log((target + prior) / (expected + prior))
    return ratio.astype(np.float32), float((ratio * target).sum() / max(1, target.sum()))


def _weights(ratio: np.ndarray, mean: float, length: float | None, bits: int, orders: tuple[int, ...]):
    def f(batches):
        for b in batches:
            out = np.full(b.num_rows, -np.inf)
            for i, j, buf, offs in seq.batches(b.column("_text")):
                x, t = features(buf, offs, bits, orders)
                n = np.bincount(t, minlength=j - i)
                s = np.bincount(t, weights=ratio[x] - mean, minlength=j - i)
                out[i:j] = np.where(n > 0, s if length is None else s * length / np.maximum(n, 1), -np.inf)
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "_h": b.column("_h"), "log_weight": out})

    return f


def gumbel(seed: int, *key: Column) -> Column:
    u = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, max_target: int = 50_000, bits: int = 20, orders: tuple[int, ...] = (1, 2), prior: float = 5.0, length: float | None = 30.0, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, key, rank, kept: one row per input row. ``labels``: doc_id,
    quality, toxic. Runs the two counts over all texts first."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    lab = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(good, F.lit(False)).alias("_good")).filter("_id IS NOT NULL")
    if keep is None:
        a = lab.agg(F.count_if("_good").alias("g"), F.count("*").alias("n")).first()
        keep = a["g"] / a["n"] if a["n"] else 1.0
    sample = lab.filter("_good").select("_id").distinct().orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_target)
    target = np.array(sorted(r[0] for r in sample.collect()), dtype=np.int64)
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    d = d.withColumn("_h", F.xxhash64("_id", "_text"))
    parts = d.mapInArrow(_counts(target, bits, orders), "slice long, i binary, r binary, t binary")
    size = (1 << bits) // SLICES
    raw, tgt = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in parts.groupBy("slice").applyInArrow(_add(bits), "slice long, r binary, t binary").collect():
        at = slice(r["slice"] * size, (r["slice"] + 1) * size)
        raw[at], tgt[at] = np.frombuffer(r["r"], np.int64), np.frombuffer(r["t"], np.int64)
    ratio, mean = log_ratios(raw, tgt, prior)
    table = docs.sparkSession.sparkContext.broadcast(ratio)
    w = d.mapInArrow(lambda it: _weights(table.value, mean, length, bits, orders)(it), "_id long, _h long, log_weight double")
    w = graph.written(w)  # ranges are found by a pass of their own
    w = w.withColumn("key", F.col("log_weight") + gumbel(seed, F.col("_id"), F.col("_h")))
    k = round(keep * w.count())
    out = graph.numbered(w, [F.col("key").desc(), F.col("_id").asc_nulls_last(), F.col("_h").asc()])
    return out.withColumn("kept", F.col("rank") <= k).select(F.col("_id").alias(id_col), "log_weight", "key", "rank", "kept")
