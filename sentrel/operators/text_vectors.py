"""Texts as vectors: hashed n-grams, weighted by how rare they are in a corpus.

A text's n-grams are its words and the three-letter pieces of each word between blanks
(" word "). Each goes to one of ``dims`` buckets by its MD5 sum; a bucket's value is the
number of n-grams in it times the bucket's weight, an integer that falls with the number
of corpus texts that have the bucket. So vectors are integers: products of two of them
are exact in any order, and ranks by cosine do not depend on how rows are dealt.

Words are runs of 0-9, a-z and characters beyond ASCII after lower-casing A-Z. NULL and
empty texts have a vector of zeros.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: All that is no part of a word.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: n-grams whose buckets a worker remembers.
REMEMBERED = 1 << 18
#: Bytes of text that are counted together; a longer text is counted alone.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Weights:
    """One weight a bucket; ``dims`` is all that its size depends on."""

    values: tuple[int, ...]

    @property
    def dims(self) -> int:
        return len(self.values)


class Buckets:
    """Counts of texts by bucket. Remembers the buckets of n-grams it has seen."""

    def __init__(self, dims: int):
        self.dims, self.known = dims, {}

    def _of(self, grams: list[str]) -> np.ndarray:
        if len(self.known) + len(grams) > REMEMBERED:
            self.known.clear()
        known, out = self.known, np.empty(len(grams), np.int64)
        for i, g in enumerate(grams):
            at = known.get(g)
            if at is None:
                at = known[g] = int(hashlib.md5(g.encode()).hexdigest()[:6], 16) % self.dims
            out[i] = at
        return out

    def counts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """A matrix of (texts, dims) for each group of texts that follow each other."""
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOGETHER, "right")))
            yield self._counts(texts.slice(i, j - i))
            i = j

    def _counts(self, texts: pa.Array) -> np.ndarray:
        split = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(texts), APART, " "), " ")
        words = split.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        own = self._of(known)
        # the pieces of all different words: three characters around each that is no blank
        chars = np.frombuffer(f" {' '.join(known)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        centre = np.flatnonzero(chars != 32)
        codes, piece = np.unique((chars[centre - 1] << 42) | (chars[centre] << 21) | chars[centre + 1], return_inverse=True)
        flat = self._of([chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in codes.tolist()])[piece]
        size = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        which = words.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        # equal words of a text count at once
        solid = size[which] > 0
        text, which = text[solid], which[solid]
        pair, times = np.unique(text * max(1, len(known)) + which, return_counts=True)
        text, which = np.divmod(pair, max(1, len(known)))
        n = size[which]
        at = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cells = len(texts) * self.dims
        found = np.bincount(text * self.dims + own[which], times, cells) + np.bincount(np.repeat(text * self.dims, n) + flat[at], np.repeat(times, n), cells)
        return found.astype(np.int64).reshape(len(texts), self.dims)


def weight(texts: int, having: int) -> int:
    return 1 + math.floor(16 * math.log((texts + 1) / (having + 1)) + 0.5)


def fit(corpus: DataFrame, text: str = "text", dims: int = 512) -> Weights:
    """Reads every corpus text; ``dims`` + 1 counts reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, having, texts = Buckets(dims), np.zeros(dims, np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for counts in b.counts(batch.column(0)):
                having += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(-1, dims), pa.int32()), "n": pa.array([texts, *having.tolist()], pa.int64())})

    rows = corpus.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = {r.bucket: r.n for r in rows}
    return Weights(tuple(weight(n.get(-1, 0), n.get(i, 0)) for i in range(dims)))


def save(spark: SparkSession, w: Weights, path: str) -> None:
    spark.createDataFrame(list(enumerate(w.values)), "bucket int, weight int").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Weights:
    rows = {r.bucket: r.weight for r in spark.read.parquet(path).collect()}
    return Weights(tuple(rows[i] for i in range(len(rows))))


def vectors(df: DataFrame, w: Weights, text: str = "text", column: str = "vector") -> DataFrame:
    """``df`` with an array<int> of ``w.dims`` values in place of its text."""
    rest = [c for c in df.columns if c != text]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, weights = Buckets(w.dims), np.array(w.values)
        for batch in batches:
            i = 0
            for counts in b.counts(batch.column("_text")):
                n = len(counts)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w.dims), pa.array((counts * weights).astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, n) for c in rest], rows], [*rest, column])
                i += n

    d = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text")
    return d.mapInArrow(f, f"{schema}, `{column}` array<int>")
