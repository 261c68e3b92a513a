"""Operator 1: benchmark passages in documents, by the q-gram lemma.

A passage of m characters with at most E edits keeps m - q + 1 - E q of the item's
q-grams, all in a band of E + 1 diagonals. Hits (position in the document minus
position in the item) are counted in bands of width 2E that overlap by half, so one
band holds them all. Hits are counted in slices of bounded size, in order of position:
a band is judged as soon as no later position can reach it, so memory does not grow
with a text that repeats itself. Bands that reach the bound are verified by banded
alignment: only diagonals within E of the band are computed.

Texts and items are compared as characters; letters A-Z are lowered and every run of
white space is one blank on both sides, so wrapped or indented passages cost no edits.
Places of one item that overlap are one place, the one with the fewest edits.

The benchmark is read in shards of bounded bytes. One shard at a time is in the driver
and broadcast; where there are several, each one's result is written before the next
is read. Items of under ``gram`` characters share no q-gram and are not looked for.
NULL or empty texts and items match nothing. Rows are searched one by one: equal ids
give the rows of each, a NULL id gives NULL. Ids of items must be numbers; documents'
ids, where they are numbers, come as bigint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentrel.llm import graph, seq
from sentrel.llm.seq import U

SHARD_BYTES = 4 << 20
FILTER_BITS = 23
#: Hits counted at a time, and characters hashed at a time.
SLICE = 1 << 17
SEGMENT = 1 << 19
FAR = 1 << 30


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each begins) of UTF-8 bytes."""
    if not len(buf) or int(buf.max()) < 0x80:
        return buf.astype(np.uint32), np.arange(len(buf))
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    first = buf[at].astype(np.uint32)
    more = (first >= 0xC0).astype(np.int8) + (first >= 0xE0) + (first >= 0xF0)
    cp = np.where(more == 0, first, first & (0x3F >> more).astype(np.uint32))
    for k in (1, 2, 3):
        m = np.flatnonzero(more >= k)
        cp[m] = (cp[m] << np.uint32(6)) | (buf[np.minimum(at[m] + k, len(buf) - 1)] & 0x3F)
    return cp, at


def plain(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters as compared, offsets of the texts, the place of each character
    among the characters of the group) of a group of texts."""
    cp, at = characters(buf)
    offs = np.searchsorted(at, offs)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    cp[blank] = 32
    upper = (cp >= 65) & (cp <= 90)
    cp[upper] += 32
    again = np.zeros(len(cp), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[offs[:-1][offs[:-1] < len(cp)]] = False
    place = np.flatnonzero(~again)
    return cp[place], np.searchsorted(place, offs), place


def _grams(cp: np.ndarray, q: int) -> np.ndarray:
    return seq.Hasher(seq.mix(cp.astype(U) * U(0x9E3779B97F4A7C15) + U(1)) | U(1), 0).grams(q)


def edit_budget(m: int, rate: float, q: int) -> int:
    """floor(rate m), less where the lemma would demand no shared q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


class Index:
    """The q-grams of a benchmark shard."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q, rows = q, []
        self.ids, self.texts = [], []
        for i, t in items:
            b = np.frombuffer((t or "").strip().encode(), np.uint8)
            cp = plain(b, np.array([0, len(b)]))[0]
            if len(cp) >= q:
                self.ids.append(i)
                self.texts.append(cp)
                rows.append(_grams(cp, q))
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array([edit_budget(int(m), rate, q) for m in self.m], np.int64)
        n = np.array([len(r) for r in rows], np.int64)
        h = np.concatenate(rows) if rows else np.zeros(0, U)
        item, pos = np.repeat(np.arange(len(n), dtype=np.int32), n), np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if rows else np.zeros(0, np.int32)
        o = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[o], item[o], pos[o]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(h >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.width = 2 * np.maximum(self.budget, 1)
        self.need = np.maximum(self.m - q + 1 - self.budget * q, 1)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole item in ``text`` on the
    diagonals low to high (place in the text minus place in the item), None above the
    budget; of several the one that ends first."""
    m, n, size = len(item), len(text), high - low + 1
    t = np.full(size + m, 0xFFFFFFFF, np.uint32)
    a, z = max(0, low), min(n, low + size + m)
    if a >= z:
        return None
    t[a - low : z - low] = text[a:z]
    data, whole = t.tobytes(), item.tobytes()
    at = data.find(whole)
    while at >= 0 and at % 4:
        at = data.find(whole, at + 1)
    if 0 <= at // 4 < size:
        return 0, low + at // 4, low + at // 4 + m
    steps = np.arange(size)
    start = low + steps
    cost = np.where((start >= 0) & (start <= n), 0, FAR)
    outside = np.where((low + np.arange(size + m) >= 0) & (low + np.arange(size + m) < n), 0, FAR)
    for i in range(m):
        best = cost + (t[i : i + size] != item[i]) + outside[i : i + size]
        src = start
        skip = cost[1:] + 1  # the item's character has no partner
        less = np.flatnonzero(skip < best[:-1])
        if len(less):
            src = start.copy()
            best[less], src[less] = skip[less], start[less + 1]
        # characters of the text without partner: the least of best[k] - k over k <= j
        run = np.minimum.accumulate(best - steps)
        where = np.maximum.accumulate(np.where(best - steps == run, steps, 0))
        cost, start = run + steps, src[where]
        if int(cost.min()) > budget:
            return None
    end = low + steps + m
    cost = np.where(end <= n, cost, FAR)
    j = int(np.argmin(cost))
    return (int(cost[j]), int(start[j]), int(end[j])) if cost[j] <= budget else None


def _bands(index: Index, chars: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first and last diagonal) of the bands that reach the bound."""
    q, total = index.q, len(chars)
    pairs, bands, counts = (np.zeros(0, np.int64) for _ in range(3))

    def judge(until: int):
        """Bands that positions from ``until`` on cannot reach: judged, and forgotten."""
        nonlocal pairs, bands, counts
        if len(pairs):
            o = np.lexsort((bands, pairs))
            pairs, bands, counts = pairs[o], bands[o], counts[o]
            at = seq.group_starts(pairs, bands)
            pairs, bands, counts = pairs[at], bands[at], np.add.reduceat(counts, at)
        text, item = np.divmod(pairs, max(1, len(index.ids)))
        w = index.width[item]
        low = (bands >> 1) * w - (bands & 1) * (w // 2)
        over = (offs[text] + low + w + index.m[item] <= until) | (offs[text + 1] <= until)
        good = np.flatnonzero(over & (counts >= index.need[item]))
        found = sorted(zip(text[good].tolist(), item[good].tolist(), low[good].tolist(), (low + w - 1)[good].tolist()))
        pairs, bands, counts = pairs[~over], bands[~over], counts[~over]
        return found

    for s in range(0, total, SEGMENT):
        g = _grams(chars[s : s + SEGMENT + q - 1], q)
        p = np.flatnonzero(index.filter[(g >> U(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(index.h, g[p], "left"), np.searchsorted(index.h, g[p], "right")
        p += s
        text = np.searchsorted(offs, p, "right") - 1
        ok = (hi > lo) & (p + q <= offs[text + 1])
        p, lo, n, text = p[ok], lo[ok], (hi - lo)[ok], text[ok]
        cum = np.concatenate(([0], np.cumsum(n)))
        for a in range(0, int(cum[-1]), SLICE):
            f = np.arange(a, min(a + SLICE, int(cum[-1])))
            x = np.searchsorted(cum, f, "right") - 1
            k = lo[x] + f - cum[x]
            item = index.item[k].astype(np.int64)
            diag, w = p[x] - offs[text[x]] - index.pos[k], index.width[item]
            pair = text[x] * len(index.ids) + item
            pairs = np.concatenate((pairs, pair, pair))
            bands = np.concatenate((bands, 2 * (diag // w), 2 * ((diag + w // 2) // w) + 1))
            counts = np.concatenate((counts, np.ones(2 * len(f), np.int64)))
            yield from judge(int(p[x[-1]]))
    yield from judge(total + 1)


def places(index: Index, chars: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits): places of benchmark items in a group of texts;
    those of one item do not overlap."""
    last: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, low, high in _bands(index, chars, offs) if len(index.h) else ():
        e, old = int(index.budget[i]), last.get((t, i))
        if old and high + e < old[1]:
            continue
        got = align(index.texts[i], chars[offs[t] : offs[t + 1]], low - e, high + e, e)
        if got is None:
            continue
        edits, start, end = got
        if old and start < old[1]:
            if edits < old[2]:
                last[t, i] = (start, end, edits)
            continue
        if old:
            yield (t, i, *old)
        last[t, i] = (start, end, edits)
    for (t, i), x in last.items():
        yield (t, i, *x)


_BUILT: dict[str, Index] = {}


def _index(name: str, shared, q: int, rate: float) -> Index:
    """Built once in a Python worker, whatever number of tasks it runs."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(shared.value, q, rate)
    return _BUILT[name]


def _search(shared, q: int, rate: float):
    name = uuid.uuid4().hex

    def f(batches):
        index = _index(name, shared, q, rate)
        for b in batches:
            row, item, start, end, edits = [], [], [], [], []
            for i, _, buf, offs in seq.batches(b.column("_text")):
                chars, offs, place = plain(buf, offs)
                for t, k, s, e, c in places(index, chars, offs):
                    row.append(i + t)
                    item.append(index.ids[k])
                    zero = int(place[offs[t]])
                    start.append(int(place[offs[t] + s]) - zero)
                    end.append(int(place[offs[t] + e - 1]) + 1 - zero)
                    edits.append(c)
            kept = {n: b.column(n).take(pa.array(row, pa.int64())) for n in b.schema.names if n != "_text"}
            yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v, pa.int64()) for k, v in (("item_id", item), ("start_char", start), ("end_char", end), ("edits", edits))})

    return f


def _clean(shared, q: int, rate: float, text_col: str):
    name = uuid.uuid4().hex

    def f(batches):
        index = _index(name, shared, q, rate)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, _, buf, offs in seq.batches(b.column(text_col)):
                chars, offs, _ = plain(buf, offs)
                for t, *_ in places(index, chars, offs):
                    keep[i + t] = False
            yield b.filter(pa.array(keep))

    return f


def _shards(benchmark: DataFrame) -> tuple[int, DataFrame]:
    b = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).filter("text IS NOT NULL")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // SHARD_BYTES))
    return n, b.withColumn("_s", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))


def _shared(b: DataFrame, s: int):
    items = sorted((r[0] if r[0] is not None else -1, r[1], r[0]) for r in b.filter(F.col("_s") == s).select("item_id", "text").collect())
    return b.sparkSession.sparkContext.broadcast([(x[2], x[1]) for x in items])


def _found(docs: DataFrame, benchmark: DataFrame, gram: int, rate: float, schema: str) -> DataFrame:
    """``docs``: ``_text`` and the columns of ``schema``."""
    n, b = _shards(benchmark)
    out = None
    for s in range(n):
        shared = _shared(b, s)
        x = docs.mapInArrow(_search(shared, gram, rate), f"{schema}, item_id long, start_char long, end_char long, edits long")
        if n > 1:
            x = graph.written(x)
            shared.unpersist()
        out = x if out is None else out.unionByName(x)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, gram: int = 16, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_char, end_char, edits: one row per place, in characters
    of the text as it is. Reads the benchmark before it returns."""
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return _found(d, benchmark, gram, rate, "_id long").withColumnRenamed("_id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, gram: int = 16, rate: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns. With
    one shard rows are filtered where they are, without any shuffle."""
    n, b = _shards(benchmark)
    if n == 1:
        return docs.mapInArrow(_clean(_shared(b, 0), gram, rate, text_col), docs.schema)
    text = F.col(f"`{text_col}`")
    keys = [F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(2)).alias("_h2")]
    bad = _found(docs.select(text.alias("_text"), *keys), benchmark, gram, rate, "_h1 long, _h2 long").select("_h1", "_h2").distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_x"), *keys)
    return d.join(bad, ["_h1", "_h2"], "left_anti").select("_x.*")
