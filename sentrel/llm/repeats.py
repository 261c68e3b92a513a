"""Finding every window of L symbols that occurs again, without sending windows.

Each window of L symbols has one anchor: of the k-grams it holds, the one with the
least hash (the first on ties). Equal windows have equal anchors, so occurrences
of a window only ever meet within its anchor's class. Consecutive windows with one
anchor form a run; only runs are sent.

* Documents are dealt to chunks by id and text (equal or missing ids spread). A chunk sends each different (anchor, run)
  once, however many of its documents hold it: copies and very common passages
  are combined before the shuffle.
* A bucket of anchors settles each class. A class whose runs are all equal is
  settled by its totals alone ("even"); the runs of the others are "open".
* Open runs are sent once more with their symbols, and windows are compared there.
* The classes at the edges of a very common passage have a run of their own for each
  occurrence. A chunk tells a class of more than MANY runs by two of them and their
  number; classes of more than HOT runs are "hot": their windows, each different one
  of a chunk once, are dealt by 128-bit hashes of their own and settled by these.
* The verdicts go back to the chunks, which remove the covered symbols.

So a class never brings more than MANY entries a chunk, or HOT runs, to one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sentrel.llm import seq
from sentrel.llm.seq import U

CHUNK_BYTES = 4 << 20
POS_BITS = 28
MANY = 16
HOT = 1024
LAST = np.iinfo(np.int64).max


@dataclass
class Runs:
    """One row per run: text index, window starts [s, e), anchor and run hashes."""

    text: np.ndarray
    s: np.ndarray
    e: np.ndarray
    a: np.ndarray
    r: np.ndarray


def runs_of(values: np.ndarray, offs: np.ndarray, size: int, gram: int) -> Runs:
    """``values``: symbol hashes of a group of texts with offsets ``offs``. Sequences of
    over 2^POS_BITS symbols are cut into pieces that overlap by a window."""
    step, parts = (1 << POS_BITS) - size, []
    for a in range(0, max(1, len(values) - size + 1), step):
        z = min(len(values), a + step + size - 1)
        parts.append(_runs_of(values[a:z], np.clip(offs, a, z) - a, size, gram, a))
    both = [np.concatenate(x) for x in zip(*parts)] if len(parts) > 1 else parts[0]
    return Runs(np.searchsorted(offs, both[0], "right") - 1, *both)


def _runs_of(values: np.ndarray, offs: np.ndarray, size: int, gram: int, first: int):
    at = seq.window_starts(offs, size)
    if not len(at):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z.astype(U), z.astype(U)
    grams = seq.Hasher(values, 0).grams(gram)
    key = ((grams >> U(POS_BITS)) << U(POS_BITS)) | np.arange(len(grams), dtype=U)
    best = (seq.sliding_min(key, size - gram + 1)[at] & U((1 << POS_BITS) - 1)).astype(np.int64)
    cut = seq.group_starts(best)
    s, e = at[cut], at[np.append(cut[1:], len(at)) - 1] + 1
    return s + first, e + first, grams[best[cut]], seq.Hasher(values, 1).ranges(s, e + size - 1)


@dataclass
class Rule:
    """What is compared: how texts become symbols, and how open runs are settled.

    symbols(buf, offs) -> (values, offsets, raw symbols to send, context)
    settle(runs, lengths, values, counts, raw symbols) -> one int64 per window
    hit(ids, verdicts) -> which windows are removed; keep(...) -> the kept bytes.
    by_id: verdicts are the least id (else the number of occurrences, 2 at most).
    """

    size: int
    gram: int
    raw: type
    by_id: bool
    symbols: Callable
    settle: Callable
    keep: Callable
    kept_type: str


def chunk_count(df: DataFrame, of: Column | None = None) -> tuple[int, int]:
    """(chunks of about CHUNK_BYTES of ``_text``, bytes of the texts where ``of``). A
    row counts 64 bytes besides its text."""
    n = F.octet_length("_text")
    a = df.agg(F.sum(F.coalesce(n, F.lit(0)).cast("bigint") + 64).alias("all"), F.sum(F.when(of, n) if of is not None else n).alias("of")).first()
    return max(1, -(-(a["all"] or 0) // CHUNK_BYTES)), a["of"] or 0


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64) if t.num_rows else np.zeros(0, np.int64)


def _each(t: pa.Table, rule: Rule):
    """(first row, end row, offsets, symbols, context, runs, ids of the runs' texts,
    symbol hashes) of each group of texts."""
    ids = _ids(t)
    for i, j, buf, offs in seq.batches(t.column("_text")):
        values, so, raw, ctx = rule.symbols(buf, offs)
        runs = runs_of(values, so, rule.size, rule.gram)
        yield i, j, so, raw, ctx, runs, ids[i + runs.text], values


def _combine(rule: Rule, a, r, v, c, *more):
    """Equal (a, r) as one: least id, number of occurrences up to 2, any ``more``."""
    order = np.lexsort((v, r, a))
    a, r, v, c = a[order], r[order], v[order], c[order]
    at = seq.group_starts(a, r)
    total = np.minimum(np.add.reduceat(c.astype(np.int64), at), 2).astype(np.uint8) if len(at) else c
    return (a[at], r[at], v[at], total, *[m[order][at] for m in more])


def _windows(values: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window."""
    return seq.Hasher(values, 0).ranges(at, at + size), seq.Hasher(values, 1).ranges(at, at + size)


#: kind 0: runs (k: how many different ones an entry stands for); 3: single windows.
HEADS = "bucket long, chunk long, kind int, a binary, r binary, v binary, c binary, k binary, n binary, raw binary"
#: kind 0: class is open; 1: even, v its least id; 3: hot; 2: verdicts w on the windows
#: of run a; 4: verdicts w on the windows with hashes a, v.
VERDICTS = "chunk long, kind int, a binary, v binary, n binary, w binary"


def _heads(rule: Rule, buckets: int):
    def f(key, t):
        got = [[], [], []]
        for *_, runs, ids, _ in _each(t, rule):
            one = _combine(rule, runs.a, runs.r, ids, np.ones(len(ids), np.uint8))
            for g, x in zip(got, (one[0], one[1], one[2])):
                g.append(x)
            got.append(one[3])
        a, r, v = (np.concatenate(g) if g else np.zeros(0, U) for g in got[:3])
        c = np.concatenate(got[3:]) if got[3:] else np.zeros(0, np.uint8)
        a, r, v, c = _combine(rule, a, r, v, c)
        v, k = v.astype(np.int64), np.ones(len(a), np.uint32)
        if len(a):  # of classes with many runs the least and the largest stay
            at = seq.group_starts(a)
            size = np.diff(np.append(at, len(a)))
            many = np.flatnonzero(size > MANY)
            last = at[many] + size[many] - 1
            k[at[many]] = size[many] - 1
            v[at[many]] = v[last] = np.minimum.reduceat(v, at)[many]
            stay = np.repeat(size <= MANY, size)
            stay[at[many]] = stay[last] = True
            a, r, v, c, k = a[stay], r[stay], v[stay], c[stay], k[stay]
        rows = [(b, 0, x) for b, x in seq.pack((a % U(buckets)).astype(np.int64), a=a, r=r, v=v, c=c, k=k)] if len(a) else []
        return _head_table(key[0].as_py(), rows)

    return f


def _head_table(chunk: int, rows: list) -> pa.Table:
    names = ("a", "r", "v", "c", "k", "n", "raw")
    cols = {k: pa.array([x.get(k) for *_, x in rows], pa.binary()) for k in names}
    return pa.table({"bucket": pa.array([b for b, *_ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "kind": pa.array([k for _, k, _ in rows], pa.int32()), **cols})


def _verdict_table(rows: list) -> pa.Table:
    cols = {k: pa.array([x.get(k) for _, _, x in rows], pa.binary()) for k in ("a", "v", "n", "w")}
    return pa.table({"chunk": pa.array([c for c, _, _ in rows], pa.int64()), "kind": pa.array([k for _, k, _ in rows], pa.int32()), **cols})


def _classes(rule: Rule):
    """One bucket of heads: the verdict on each class with two occurrences or more."""

    def f(t):
        a, n = seq.unpack(t.column("a"), U)
        r, v, c, many = (seq.unpack(t.column(k), d)[0] for k, d in (("r", U), ("v", np.int64), ("c", np.uint8), ("k", np.uint32)))
        chunk = np.repeat(t.column("chunk").to_numpy(), n)
        order = np.argsort(a, kind="stable")
        a, r, v, c, many, chunk = a[order], r[order], v[order], c[order], many[order], chunk[order]
        at = seq.group_starts(a)
        if not len(at):
            return _verdict_table([])
        sizes = np.diff(np.append(at, len(a)))
        total = np.add.reduceat(c.astype(np.int64), at)
        even = np.minimum.reduceat(r, at) == np.maximum.reduceat(r, at)
        least = np.minimum.reduceat(v, at)
        hot = ~even & (np.add.reduceat(many.astype(np.int64), at) > HOT)
        again, even, least, hot = (np.repeat(x, sizes) for x in (total >= 2, even, least, hot))
        rows = []
        for kind, m in ((1, again & even), (0, again & ~even & ~hot), (3, hot)):
            one = seq.group_starts(a[m], chunk[m]) if m.any() else []
            if len(one):
                rows += [(ch, kind, x) for ch, x in seq.pack(chunk[m][one], a=a[m][one], v=least[m][one])]
        return _verdict_table(rows)

    return f


class Verdicts:
    """What a chunk got back, for look-ups."""

    def __init__(self, t: pa.Table) -> None:
        kind = t.column("kind").to_numpy() if t.num_rows else np.zeros(0, int)
        pick = lambda k: t.filter(pa.array(kind == k))
        even, opened, done, single = pick(1), pick(0), pick(2), pick(4)
        self.hot = np.unique(seq.unpack(pick(3).column("a"), U)[0])
        w1, w2, w = (seq.unpack(single.column(c), d)[0] for c, d in (("a", U), ("v", U), ("w", np.int64)))
        o = np.argsort(w1)
        self.w1, self.w2, self.w = w1[o], w2[o], w[o]
        a, v = seq.unpack(even.column("a"), U)[0], seq.unpack(even.column("v"), np.int64)[0]
        o = np.argsort(a)
        self.even, self.even_v = a[o], v[o]
        self.open = np.unique(seq.unpack(opened.column("a"), U)[0])
        r, n, w = seq.unpack(done.column("a"), U)[0], seq.unpack(done.column("n"), np.int32)[0].astype(np.int64), seq.unpack(done.column("w"), np.int64)[0]
        at = np.cumsum(n) - n
        o = np.argsort(r)
        self.done, self.done_at, self.done_w = r[o], at[o], w

    @staticmethod
    def find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where absent."""
        if not len(sorted_keys):
            return np.full(len(x), -1)
        i = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
        return np.where(sorted_keys[i] == x, i, -1)


def _open(rule: Rule, buckets: int):
    """The open runs of a chunk with their symbols, each different run once, and the
    windows of hot classes by their hashes."""

    def f(key, t, back):
        known = Verdicts(back)
        best: dict[int, list] = {}
        single: list[list] = [[], [], [], []]
        for _, _, so, raw, _, runs, ids, values in _each(t, rule):
            m = np.flatnonzero(Verdicts.find(known.hot, runs.a) >= 0)
            if len(m):
                w = _windows(values, _ranges(runs.s[m], runs.e[m]), rule.size)
                v = np.repeat(ids[m], runs.e[m] - runs.s[m])
                for g, x in zip(single, _combine(rule, *w, v, np.ones(len(v), np.uint8))):
                    g.append(x)
            m = np.flatnonzero(Verdicts.find(known.open, runs.a) >= 0)
            if not len(m):
                continue
            a, r, v, c, s, e = _combine(rule, runs.a[m], runs.r[m], ids[m], np.ones(len(m), np.uint8), runs.s[m], runs.e[m])
            for x in zip(a.tolist(), r.tolist(), v.tolist(), c.tolist(), s.tolist(), e.tolist()):
                old = best.get(x[1])
                if old is None:
                    best[x[1]] = [x[0], x[2], x[3], x[5] - x[4], raw[x[4] : x[5] + rule.size - 1].tobytes()]
                else:
                    old[1], old[2] = min(old[1], x[2]), 2
        dealt: dict[int, list] = {}
        for r, x in best.items():
            dealt.setdefault(x[0] % buckets, []).append((r, *x))
        rows = []
        for b, xs in dealt.items():
            col = list(zip(*xs))
            rows.append((b, 0, {"r": np.array(col[0], U).tobytes(), "a": np.array(col[1], U).tobytes(), "v": np.array(col[2], np.int64).tobytes(), "c": np.array(col[3], np.uint8).tobytes(), "n": np.array(col[4], np.int32).tobytes(), "raw": b"".join(col[5])}))
        if single[0]:
            a, r, v, c = _combine(rule, *(np.concatenate(x) for x in single))
            rows += [(b, 3, x) for b, x in seq.pack((a % U(buckets)).astype(np.int64), a=a, r=r, v=v.astype(np.int64), c=c)]
        return _head_table(key[0].as_py() if rows else 0, rows)

    return f


def _settle_windows(rule: Rule, t) -> list:
    """Windows by their hashes: verdicts for the chunks that have one that counts."""
    a, per = seq.unpack(t.column("a"), U)
    if not len(a):
        return []
    r, v, c = (seq.unpack(t.column(k), d)[0] for k, d in (("r", U), ("v", np.int64), ("c", np.uint8)))
    chunk = np.repeat(t.column("chunk").to_numpy(), per)
    order = np.lexsort((r, a))
    a, r, v, c, chunk = a[order], r[order], v[order], c[order], chunk[order]
    at = seq.group_starts(a, r)
    sizes = np.diff(np.append(at, len(a)))
    total, least = np.add.reduceat(c.astype(np.int64), at), np.minimum.reduceat(v, at)
    w = np.repeat(least if rule.by_id else np.minimum(total, 2), sizes)
    m = np.flatnonzero(np.repeat(total >= 2, sizes))
    if not len(m):
        return []
    return [(ch, 4, x) for ch, x in seq.pack(chunk[m], a=a[m], v=r[m], w=w[m])]


def _settle(rule: Rule):
    def f(t):
        kind = t.column("kind").to_numpy()
        single = _settle_windows(rule, t.filter(pa.array(kind == 3)))
        t = t.filter(pa.array(kind == 0))
        a, per = seq.unpack(t.column("a"), U)
        if not len(a):
            return _verdict_table(single)
        r, v, c, n = (seq.unpack(t.column(k), d)[0] for k, d in (("r", U), ("v", np.int64), ("c", np.uint8), ("n", np.int32)))
        raw = seq.unpack(t.column("raw"), rule.raw)[0]
        w = rule.settle(a, r, n.astype(np.int64), v, c, raw)
        at = np.cumsum(n.astype(np.int64)) - n
        ends, rows, i = at + n, single, 0
        for chunk, k in zip(t.column("chunk").to_pylist(), per.tolist()):
            if k:
                rows.append((chunk, 2, {"a": r[i : i + k].tobytes(), "n": n[i : i + k].tobytes(), "w": w[at[i] : ends[i + k - 1]].tobytes()}))
            i += k
        return _verdict_table(rows)

    return f


def _apply(rule: Rule, extra: bool):
    def f(t, back):
        known = Verdicts(back)
        n_all, n_gone, n_spans, kept = [], [], [], []
        for i, j, so, raw, ctx, runs, ids, values in _each(t, rule):
            k = Verdicts.find(known.even, runs.a)
            m = np.flatnonzero(k >= 0)
            if rule.by_id:
                m = m[ids[m] > known.even_v[k[m]]]
            starts = [_ranges(runs.s[m], runs.e[m])]
            d = Verdicts.find(known.done, runs.r)
            m = np.flatnonzero((k < 0) & (d >= 0))
            if len(m):
                pos, size = _ranges(runs.s[m], runs.e[m]), runs.e[m] - runs.s[m]
                w = known.done_w[_ranges(known.done_at[d[m]], known.done_at[d[m]] + size)]
                starts.append(pos[np.repeat(ids[m], size) > w] if rule.by_id else pos[w >= 2])
            m = np.flatnonzero(Verdicts.find(known.hot, runs.a) >= 0)
            if len(m):
                pos = _ranges(runs.s[m], runs.e[m])
                w1, w2 = _windows(values, pos, rule.size)
                x = Verdicts.find(known.w1, w1)
                x = np.where((x >= 0) & (known.w2[x] == w2), x, -1) if len(known.w1) else x
                own = np.repeat(ids[m], runs.e[m] - runs.s[m])
                starts.append(pos[(x >= 0) & ((own > known.w[x]) if rule.by_id else True)] if len(known.w1) else pos[:0])
            gone = seq.covered(int(so[-1]), np.concatenate(starts), rule.size)
            before = np.zeros(len(gone), dtype=bool)
            before[1:] = gone[:-1]
            before[so[:-1][so[:-1] < len(gone)]] = False
            total, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, gone & ~before))
            n_all.append(np.diff(so))
            n_gone.append(total[so[1:]] - total[so[:-1]])
            n_spans.append(spans[so[1:]] - spans[so[:-1]])
            kept += rule.keep(ctx, so, gone)
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        kind = pa.string() if rule.kept_type == "string" else pa.binary()
        out = {"_id": t.column("_id"), "n_symbols": cat(n_all), "n_removed": cat(n_gone), "n_spans": cat(n_spans), "kept": pa.array(kept, kind)}
        if extra:
            out["_x"] = t.column("_x")
        return pa.table(out)

    return f


def _ranges(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = e - s
    total = int(n.sum()) if len(n) else 0
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(s - (np.cumsum(n) - n), n) + np.arange(total)


def remove_repeats(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_symbols, n_removed, n_spans, kept, and with ``carry`` the other
    columns of ``docs`` as struct ``_x``. One row per input row. Adds up the texts' bytes first.
    Ids must be numbers; a NULL one comes after all others."""
    cols: list[Column] = [F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text")]
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    extra = carry and bool(rest)
    if extra:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_x"))
    cut = docs.select(*cols)
    chunks, _ = chunk_count(cut)
    buckets = max(1, chunks // 4)
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)))
    by_chunk = cut.groupBy("chunk")
    first = by_chunk.applyInArrow(_heads(rule, buckets), HEADS).groupBy("bucket").applyInArrow(_classes(rule), VERDICTS)
    opened = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_open(rule, buckets), HEADS)
    second = opened.groupBy("bucket").applyInArrow(_settle(rule), VERDICTS)
    schema = f"_id long, n_symbols long, n_removed long, n_spans long, kept {rule.kept_type}"
    if extra:
        schema += ", _x " + cut.schema["_x"].dataType.simpleString()
    out = by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(_apply(rule, extra), schema)
    return out.withColumnRenamed("_id", id_col)
