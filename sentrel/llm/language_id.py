"""Operator 3: language of a text by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte trigrams (letters lowered,
all else a blank); a linear softmax over it is trained by stochastic gradient
descent in numpy on a bounded sample: about ``per_language`` whole labelled texts of
each language, at most ``max_train`` in all, as trigram counts. Scores are calibrated
by a temperature on held-out sample rows; ``rejected`` marks scores so low that only
``reject_rate`` of the right answers there lie below.

NULL texts and texts without a letter are "und" with score 0; with no labelled rows
every text is. Whole texts are used everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sentrel.llm import seq

BUCKETS = 1 << 13
SALTS = 32


def _letters_only() -> np.ndarray:
    t = seq.LOWER.copy()
    for i in range(128):
        if not (97 <= t[i] <= 122):
            t[i] = 32
    return t


LETTERS = _letters_only()


def buckets(buf: np.ndarray) -> np.ndarray:
    """The bucket of each trigram of one text, without blank ones."""
    b = LETTERS[buf].astype(np.uint32)
    if len(b) > 1:  # capital letters of the Latin-1 range
        b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)] += 0x20
    if len(b) < 3:
        b = np.concatenate((b, np.full(3 - len(b), 32, np.uint32)))
    t = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    t = t[t != 0x202020]
    return ((t * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)


def has_letter(data: bytes) -> bool:
    return data.upper() != data.lower() or any(map(str.isalpha, data.decode("utf-8", "replace")))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket x label: embedding times output weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum()
        z = (counts @ self.table / max(n, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 12, epochs: int = 6, rate: float = 0.5, seed: int = 5, reject_rate: float = 0.01) -> Model:
    """``rows``: (label, buckets, counts). A fifth is held out to calibrate."""
    labels = sorted({r[0] for r in rows})
    of = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, use = order[: len(rows) // 5], order[len(rows) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    out, bias = np.zeros((dim, len(labels))), np.zeros(len(labels))
    total, step = epochs * max(1, len(use)), 0
    for _ in range(epochs):
        for i in rng.permutation(use):
            lab, ids, n = rows[i]
            w = n / n.sum()
            x = w @ emb[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[of[lab]] -= 1
            lr = rate * (1 - step / total)
            g = out @ p
            out -= lr * np.outer(x, p)
            bias -= lr * 0.1 * p
            # rows of a text share one gradient, scaled up as each weight is small
            emb[ids] -= lr * 10 * np.outer(w, g)
            step += 1
    model = Model(labels, emb @ out, bias)
    if len(held):
        z = np.array([rows[i][2] @ model.table[rows[i][1]] / rows[i][2].sum() + bias for i in held])
        y = np.array([of[rows[i][0]] for i in held])

        def probs(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = [2.0**k for k in np.arange(-4, 4.25, 0.25)]
        loss = [-np.log(probs(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = probs(model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(np.quantile(right, reject_rate)) if len(right) else 0.0
    return model


def _sample(drawn: np.ndarray):
    """Trigram counts of the texts with the ids ``drawn`` (sorted)."""

    def f(batches):
        for b in batches:
            ids = b.column("_id").fill_null(-1).to_numpy(zero_copy_only=False)
            m = drawn[np.minimum(np.searchsorted(drawn, ids), len(drawn) - 1)] == ids if len(drawn) else np.zeros(len(ids), bool)
            b = b.filter(pa.array(m))
            at, counts = [], []
            for i, j, buf, offs in seq.batches(b.column("_text")):
                for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    u, n = np.unique(buckets(buf[s:e]), return_counts=True)
                    at.append(u.astype(np.uint16).tobytes())
                    counts.append(n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "lang": b.column("lang"), "b": pa.array(at, pa.binary()), "n": pa.array(counts, pa.binary())})

    return f


def fit(labelled: DataFrame, per_language: int = 400, max_train: int = 2400, seed: int = 11, **options) -> Model | None:
    """``labelled``: _id, _text, lang. Reads counts by language, then the sample."""
    d = labelled.filter("lang IS NOT NULL")
    n = d.groupBy("lang").agg(F.count("*").alias("_n"))
    langs = max(1, n.count())
    share = F.least(F.lit(1.0), F.lit(float(min(per_language, max(20, max_train // langs)))) / F.col("_n"))
    u = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # ids are drawn without their texts; a language may hold most rows, so the join is salted
    shares = n.select(F.col("lang").alias("_l"), share.alias("_share"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    ids = d.select("_id", "lang", u.alias("_u"), F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SALTS)).cast("int").alias("_salt"))
    ids = ids.join(shares, (F.col("lang") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).filter("_u < _share AND _id IS NOT NULL").select("_id").distinct()
    drawn = np.array(sorted(r[0] for r in ids.collect()), dtype=np.int64)
    got = d.filter("_text IS NOT NULL").select("_id", "_text", "lang").mapInArrow(_sample(drawn), "_id long, lang string, b binary, n binary").collect()
    got = sorted(((r["_id"], r["lang"], bytes(r["b"]), bytes(r["n"])) for r in got))
    data = [(x[1], np.frombuffer(x[2], np.uint16).astype(np.int64), np.frombuffer(x[3], np.uint32).astype(np.float64)) for x in got if x[2]]
    return train(data, **options) if data else None


def _predict(model: Model | None):
    def f(batches):
        for b in batches:
            lab, score, low = ["und"] * b.num_rows, np.zeros(b.num_rows), [True] * b.num_rows
            for i, j, buf, offs in seq.batches(b.column("_text")):
                o = offs.tolist()
                for k in range(j - i) if model else ():
                    part = buf[o[k] : o[k + 1]]
                    if len(part) and has_letter(part.tobytes()):
                        p = model.scores(np.bincount(buckets(part), minlength=BUCKETS))
                        best = int(p.argmax())
                        lab[i + k], score[i + k], low[i + k] = model.labels[best], float(p[best]), bool(p[best] < model.threshold)
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "lang_pred": pa.array(lab, pa.string()), "score": score, "rejected": low})

    return f


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per input row."""
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(_predict(model), "_id long, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)


def held_out(c: Column, mod: int) -> Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod == 2, F.lit(False))


def identify(docs: DataFrame, mod: int = 4, **options) -> DataFrame:
    """Learns from the rows that are not held out, predicts all."""
    train_rows = docs.filter(~held_out(F.col("doc_id"), mod)).select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text"), "lang")
    out = predict(docs, fit(train_rows, **options))
    return out.select("doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), "lang_pred", "score", "rejected")
