"""Cosine top-k over tables of vectors: one query, or many against a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Vectors of each side in one block pair, and queries multiplied at a time.
BLOCK, ROWS = 4096, 512


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(corpus: DataFrame, query: DataFrame, k: int = 2, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query``: one row with the same vector column. Distance is 1 - cosine; zero
    vectors and NULLs rank last and are never returned."""
    q = F.broadcast(query.limit(1).select(F.col(column).alias("_q")))
    a, b = F.col(column), F.col("_q")
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    rows = corpus.crossJoin(q).select(key, (1 - _dot(a, b) / F.nullif(norm, F.lit(0.0))).alias("d")).filter(F.col("d").isNotNull())
    return rows.orderBy("d", key).limit(k).select(key, F.round("d", 4).alias("distance"))


def seed_corpus(existing: DataFrame, seed: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` and the rows of ``seed`` whose key it lacks."""
    return existing.unionByName(seed.join(existing.select(key), key, "left_anti"))


# ---- many queries -----------------------------------------------------------------------


def topk_join(queries: DataFrame, corpus: DataFrame, k: int = 2, query_key: str = "query_id", key: str = "id", column: str = "vector", block: int = BLOCK, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Of every query the ``k`` corpus rows of the least distance (1 - cosine), the
    smaller key first on ties: (query_key, rank from 1, key, distance).

    Both sides are dealt to stripes of about ``block`` rows; each pair of stripes is one
    group, which multiplies two matrices and keeps k rows a query. These partial lists,
    k rows per query and stripe, are merged by a window that drops all but k rows before
    its shuffle too. No task holds more than a stripe of each side. Vectors of different
    lengths do not pair, NULL, empty and zero ones with nothing. Query keys are distinct.
    ``sizes``: about how many rows both sides have, where counting them is dear."""
    q = queries.select(F.col(query_key).alias("_q"), F.col(column).alias("_v")).filter("_q IS NOT NULL AND size(_v) > 0")
    c = corpus.select(F.col(key).alias("_c"), F.col(column).alias("_v")).filter("_c IS NOT NULL AND size(_v) > 0")
    stripes = [max(1, -(-n // block)) for n in (sizes or (q.count(), c.count()))]

    def dealt(df: DataFrame, name: str, own: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(name), F.lit(own)).cast("int")
        side = "_r" if name == "_q" else "_s"
        return df.withColumn(side, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = dealt(q, "_q", stripes[0], "_s", stripes[1]), dealt(c, "_c", stripes[1], "_r", stripes[0])
    types = {n: df.schema[n].dataType.simpleString() for df, n in ((q, "_q"), (c, "_c"))}
    found = left.groupBy("_r", "_s").cogroup(right.groupBy("_r", "_s")).applyInArrow(_pair(k), f"_q {types['_q']}, _c {types['_c']}, d double")
    w = W.partitionBy("_q").orderBy("d", "_c")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("_q").alias(query_key), "rank", F.col("_c").alias(key), F.col("d").alias("distance"))


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, wide: int) -> np.ndarray:
    return column.take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def _pair(k: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_c")  # so that the first of equal distances has the least key
        la, lb = _lengths(left.column("_v")), _lengths(right.column("_v"))
        q_at, c_at, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for wide in np.intersect1d(la, lb):
            at, bt = np.flatnonzero(la == wide), np.flatnonzero(lb == wide)
            b = _matrix(right.column("_v"), bt, wide)
            nb = np.sqrt((b * b).sum(axis=1))
            for i in range(0, len(at), ROWS):
                a = _matrix(left.column("_v"), at[i : i + ROWS], wide)
                norm = np.sqrt((a * a).sum(axis=1))[:, None] * nb
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1 - (a @ b.T) / norm
                d[~np.isfinite(d)] = np.inf
                # all rows not above the k-th least, so that ties are whole
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
                r, c = np.nonzero((d <= edge) & (d < np.inf))
                order = np.lexsort((c, d[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                q_at.append(at[r[keep] + i])
                c_at.append(bt[c[keep]])
                dist.append(d[r[keep], c[keep]])
        take = lambda t, c, at: t.column(c).take(pa.array(np.concatenate(at)))
        return pa.table({"_q": take(left, "_q", q_at), "_c": take(right, "_c", c_at), "d": pa.array(np.concatenate(dist))})

    return f


# ---- the knowledge base of alerts --------------------------------------------------------


def alert_question(al: DataFrame, name: str = "question") -> DataFrame:
    """Adds the text by which an alert's rules are looked up."""
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return al.withColumn(name, F.concat(F.lit("rules for "), part("payment_method"), F.lit(" in "), part("governorate")))


def alert_contexts(al: DataFrame, corpus: DataFrame, k: int = 2, key: str = "id", text: str = "text", dims: int = 512) -> DataFrame:
    """Per alert and rank: transaction_id, question, rank, the corpus row's key, its
    text and distance. Alerts with the same question are looked up once; a corpus
    without texts gives no rows."""
    from sentrel.operators import text_vectors as tv

    w = tv.fit(corpus, text, dims)
    asked = alert_question(al).select("transaction_id", "question")
    distinct = asked.select("question").distinct()
    sizes = (distinct.count(), corpus.count())
    q = tv.vectors(distinct.select("question", F.col("question").alias("text")), w)
    c = tv.vectors(corpus.select(key, F.col(text).alias("text")), w)
    top = topk_join(q, c, k, "question", key, sizes=sizes)
    texts = top.join(corpus.select(key, F.col(text).alias("context")), key)
    return asked.join(texts, "question").select("transaction_id", "question", "rank", key, "context", "distance")
