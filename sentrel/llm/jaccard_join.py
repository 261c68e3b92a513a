"""Operator 8: all links between documents whose word shingle sets are similar, and
the groups they make.

1. Documents with equal sets are one: the least id stands for them.
2. Shingles are counted over all different sets. By the prefix rule, linked sets
   share one of their rarest shingles; those of a count over 1 are sent to buckets,
   where documents of fitting sizes that share one are tied to one candidate block.
3. A block's sets meet once. A signature tree per block (nodes hold OR-combined
   shingle bitmaps and size ranges) is traversed against itself; pairs of nodes that
   cannot reach the overlap needed are left out, pairs of documents that are already
   connected need no test, and the others are tested exactly.
4. Large blocks are cut into tiles and each pair of tiles is a task, so no task
   grows with a block; what tiles find is joined again by connected components.

No pair is sent anywhere; results do not depend on chance or order. Documents with
no words link with nothing; NULL text is empty. Each row is a document of its own,
also where ids are equal or NULL: such rows link only by their texts. A group is named
by its least id that is not NULL, and NULL where all are. Ids must be numbers below
2^63 - 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window as W, functions as F

from sentrel.llm import graph, seq
from sentrel.llm.repeats import LAST, _ids, chunk_count
from sentrel.llm.seq import U

BITS = 2048
FANOUT = 16
TILE = 256
SALTS = 32


def shingle_sets(texts, k: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for i, _, buf, offs in seq.batches(texts):
        w = seq.Words(buf, offs, lower=True)
        h = seq.Hasher(w.hashes(), 1)
        grams, o = h.grams(k), w.offs.tolist()
        for j in range(len(o) - 1):
            s, e = o[j], o[j + 1]
            if e - s >= k:
                yield i + j, np.unique(grams[s : e - k + 1])
            elif e > s:
                yield i + j, h.ranges(np.array([s]), np.array([e]))
            else:
                yield i + j, grams[:0]


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; (0, 0) for the empty set."""
    if not len(s):
        return 0, 0
    return tuple(int(x.astype(np.int64)) for x in (np.add.reduce(seq.mix(s ^ U(0x1234567))), np.add.reduce(seq.mix(s + U(0x89ABCDEF01)))))


def _shapes(k: int):
    def f(batches):
        for b in batches:
            n, a, c = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for row, s in shingle_sets(b.column("_text"), k):
                n[row] = len(s)
                a[row], c[row] = _key(s)
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "n": n, "k1": a, "k2": c, **{x: b.column(x) for x in ("chunk", "h1", "h2")}})

    return f


def _rep_sets(t: pa.Table, reps: pa.Table, k: int):
    """(node, set) of the different sets of a chunk that it stands for; their rows are
    found by id and told apart by the keys of the sets."""
    want = {(a, b): n for a, b, n in zip(*(reps.column(c).to_pylist() for c in ("k1", "k2", "node")))}
    if not want or not t.num_rows:
        return
    rows = np.flatnonzero(np.isin(_ids(t), reps.column("rep").to_numpy()))
    for row, s in shingle_sets(t.column("_text").take(pa.array(rows)), k):
        node = want.pop(_key(s), None)
        if node is not None:
            yield node, s


TOKENS = "bucket long, chunk long, h binary"
COUNTS = "chunk long, bucket long, df binary, rep long, k1 long, k2 long, node long"


def _chunk_tokens(sets: list[np.ndarray], buckets: int):
    """Of a chunk: its shingles by bucket, shortened to 32 bits within the bucket, with
    the order in which they are sent. Short forms serve only to order shingles."""
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    b = (flat % U(buckets)).astype(np.int64)
    code = (b.astype(U) << U(32)) | (flat >> U(32))
    return flat, code


def _send(k: int, buckets: int):
    def f(key, t, reps):
        sets = [s for _, s in _rep_sets(t, reps, k)]
        _, code = _chunk_tokens(sets, buckets)
        code.sort()
        rows = list(seq.pack((code >> U(32)).astype(np.int64), h=code.astype(np.uint32))) if len(code) else []
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "h": pa.array([x["h"] for _, x in rows], pa.binary())})

    return f


def _count(t):
    h, per = seq.unpack(t.column("h"), np.uint32)
    _, where, n = np.unique(h, return_inverse=True, return_counts=True)
    df = np.minimum(n, 255).astype(np.uint8)[where]
    cuts = np.cumsum(per)
    blobs = [df[c - p : c].tobytes() for c, p in zip(cuts.tolist(), per.tolist())]
    null = pa.nulls(t.num_rows, pa.int64())
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "df": pa.array(blobs, pa.binary()), "rep": null, "k1": null, "k2": null, "node": null})


PREFIXES = "bucket long, h binary, id binary, n binary"


def _prefixes(k: int, buckets: int, num: int, den: int):
    def f(t, back):
        is_rep = back.column("rep").is_valid() if back.num_rows else None
        reps = back.filter(is_rep) if back.num_rows else back
        got = list(_rep_sets(t, reps, k))
        flat, code = _chunk_tokens([s for _, s in got], buckets)
        out = []
        if len(flat):
            counts = back.filter(pa.compute.invert(is_rep)).sort_by("bucket")
            df_sent = seq.unpack(counts.column("df"), np.uint8)[0]
            df = np.empty(len(flat), np.uint8)
            df[np.argsort(code, kind="stable")] = df_sent
            at, hs, ids, ns = 0, [], [], []
            for i, s in got:
                n = len(s)
                d = df[at : at + n]
                at += n
                take = n - -(-num * n // den) + 1
                if take < n:
                    order = np.lexsort((s, d))[:take]
                    order = order[d[order] > 1]
                else:
                    order = np.flatnonzero(d > 1)
                if len(order):
                    hs.append(s[order])
                    ids.append(np.full(len(order), i, np.int64))
                    ns.append(np.full(len(order), n, np.int64))
            if hs:
                h = np.concatenate(hs)
                out = list(seq.pack((h % U(buckets)).astype(np.int64), h=h, id=np.concatenate(ids), n=np.concatenate(ns)))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), **{c: pa.array([x[c] for _, x in out], pa.binary()) for c in ("h", "id", "n")}})

    return f


def _tie(num: int, den: int):
    def f(t):
        """Of one bucket: documents that share a shingle, tied in a star wherever
        their sizes fit in a row."""
        h, i, n = (seq.unpack(t.column(c), d)[0] for c, d in (("h", U), ("id", np.int64), ("n", np.int64)))
        order = np.lexsort((i, n, h))
        h, i, n = h[order], i[order], n[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (den * n[:-1] < num * n[1:])
        at = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(i, at), np.diff(np.append(at, len(i)))) if len(at) else i
        m = least != i
        pairs = np.unique(np.stack([i[m], least[m]], axis=1), axis=0) if m.any() else np.zeros((0, 2), np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return f


BLOCKS = "block long, tile_a int, tile_b int, id long, n long, s binary"


def _blocks(k: int):
    def f(t, nodes):
        block = dict(zip(nodes.column("node").to_pylist(), zip(nodes.column("component").to_pylist(), nodes.column("tiles").to_pylist(), nodes.column("tile").to_pylist())))
        out: list[tuple] = []
        for i, s in _rep_sets(t, nodes, k):
            c, tiles, mine = block[i]
            out += [(c, min(mine, j), max(mine, j), i, len(s), s.tobytes()) for j in range(tiles)]
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("block", "tile_a", "tile_b", "id", "n", "s"), cols, kinds)})

    return f


class SignatureTree:
    """Sets in order of size; each node covers FANOUT nodes of the level below and
    holds the OR of their bitmaps, their sizes' range and the largest number of
    elements that a bitmap does not tell apart."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        n = np.array([len(s) for s in sets], dtype=np.int64)
        bits = np.zeros((len(sets), BITS // 64), dtype=U)
        for i, s in enumerate(sets):
            p = (s >> U(17)) % U(BITS)
            np.bitwise_or.at(bits[i], (p >> U(6)).astype(np.int64), U(1) << (p & U(63)))
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """For pairs of nodes: could any two of their sets link?"""
        b, lo, hi, sl = self.levels[level]
        fits = (den * hi[i] >= num * lo[j]) & (den * hi[j] >= num * lo[i])
        most = np.bitwise_count(b[i] & b[j]).sum(axis=1, dtype=np.int64) + np.minimum(sl[i], sl[j])
        most = np.minimum(most, np.minimum(hi[i], hi[j]))
        return fits & ((num + den) * most >= num * (lo[i] + lo[j]))

    def candidates(self, num: int, den: int):
        """Pairs i < j of sets that bitmaps and sizes do not rule out, in blocks."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            ok = self.may_link(level, i, j, num, den)
            i, j = i[ok], j[ok]
            if level == 0:
                if len(i):
                    yield i, j
                continue
            size = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            for p in range(0, len(i), 64):
                a = (i[p : p + 64, None, None] * FANOUT + step[None, :, None]) + 0 * step[None, None, :]
                c = (j[p : p + 64, None, None] * FANOUT + step[None, None, :]) + 0 * step[None, :, None]
                m = (a < size) & (c < size) & ((a < c) if level == 1 else (a <= c))
                if m.any():
                    stack.append((level - 1, a[m], c[m]))


def links_of(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(id, least id of its group) for the groups of two or more that links make."""
    order = sorted(range(len(ids)), key=lambda x: (len(sets[x]), ids[x]))
    ids, sets = [ids[x] for x in order], [sets[x] for x in order]
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in SignatureTree(sets).candidates(num, den):
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = root(a), root(b)
            if ra == rb:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[rb] = ra
    least: dict[int, int] = {}
    for x, i in enumerate(ids):
        r = root(x)
        least[r] = min(least.get(r, i), i)
    return [(i, least[root(x)]) for x, i in enumerate(ids) if i != least[root(x)]]


def _test(num: int, den: int):
    def f(t):
        sets = [np.frombuffer(x.as_buffer(), dtype=U) for x in t.column("s")]
        found = links_of(t.column("id").to_pylist(), sets, num, den)
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return f


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: _id, h1, h2 (hashes of the row), n, group (the least
    node its set is linked to; NULL without words), least (the group's least id,
    LAST where all are NULL)."""
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    chunks, _ = chunk_count(d)
    buckets = max(1, chunks // 4)
    cut = d.withColumns({"h1": F.xxhash64("_id", "_text"), "h2": F.xxhash64("_text", F.lit(2))}).withColumn("chunk", F.pmod("h1", F.lit(chunks)))
    shapes = graph.written(cut.mapInArrow(_shapes(k), "_id long, n long, k1 long, k2 long, chunk long, h1 long, h2 long"))
    # one row stands for each set: copies are first joined within a chunk
    local = shapes.filter("n > 0").groupBy("k1", "k2", "chunk").agg(F.min(F.coalesce("_id", F.lit(LAST))).alias("local"))
    local = graph.written(local.withColumn("first", F.min(F.struct("local", "chunk")).over(W.partitionBy("k1", "k2"))))
    reps = local.filter("local = first.local AND chunk = first.chunk").select(F.col("local").alias("rep"), "k1", "k2", "chunk", F.monotonically_increasing_id().alias("node"))
    reps = graph.written(reps)
    cut = cut.select("_id", "_text", "chunk")
    by_chunk = cut.groupBy("chunk")
    counts = by_chunk.cogroup(reps.groupBy("chunk")).applyInArrow(_send(k, buckets), TOKENS).groupBy("bucket").applyInArrow(_count, COUNTS)
    back = counts.unionByName(reps.select("chunk", F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("df"), "rep", "k1", "k2", "node"))
    prefixes = by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(_prefixes(k, buckets, num, den), PREFIXES)
    ties = prefixes.groupBy("bucket").applyInArrow(_tie(num, den), "src long, dst long")
    candidate = graph.written(graph.components(ties))
    sizes = candidate.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    nodes = candidate.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    nodes = nodes.join(reps, "node").select("rep", "k1", "k2", "node", "component", "tiles", "tile", "chunk")
    blocks = by_chunk.cogroup(nodes.groupBy("chunk")).applyInArrow(_blocks(k), BLOCKS)
    links = blocks.groupBy("block", "tile_a", "tile_b").applyInArrow(_test(num, den), "src long, dst long")
    groups = reps.join(graph.components(links), "node", "left").select("k1", "k2", "rep", F.coalesce("component", "node").alias("group"), F.pmod("k1", F.lit(SALTS)).alias("salt"))
    # one group may hold most sets: its least id comes to them salted
    least = groups.groupBy("group").agg(F.min("rep").alias("least"), F.count("*").alias("_n"))
    salted = least.filter("_n > 1").select("group", "least", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    groups = groups.join(salted, ["group", "salt"], "left").select("k1", "k2", "group", F.coalesce("least", "rep").alias("least"))
    named = local.select("k1", "k2", "chunk").join(groups, ["k1", "k2"])
    return shapes.join(named, ["k1", "k2", "chunk"], "left").select("_id", "h1", "h2", "n", "group", F.coalesce("least", "_id", F.lit(LAST)).alias("least"))


def similar_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row. Documents link when
    den * |A and B| >= num * |A or B|. Runs jobs and writes intermediate results."""
    g = _grouped(docs, k, num, den, id_col, text_col)
    return g.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.nullif("least", F.lit(LAST)).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group one row of ``docs`` with the least id (NULL last; of several the
    one with the least hash); rows without words all stay. Columns as they are."""
    g = _grouped(docs, k, num, den, id_col, text_col)
    # of the rows with the group's least id one is taken, so no group meets in a task
    least = g.filter((F.col("n") > 0) & (F.coalesce("_id", F.lit(LAST)) == F.col("least")))
    stay = least.groupBy("group").agg(F.min(F.struct(F.coalesce("_id", F.lit(LAST)).alias("i"), "h1", "h2")).alias("r")).select("r.*", F.lit(False).alias("empty"))
    stay = stay.unionByName(g.filter("n = 0").select(F.coalesce("_id", F.lit(LAST)).alias("i"), "h1", "h2", F.lit(True).alias("empty")).distinct())
    i = F.col(f"`{id_col}`").cast("bigint")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x"), F.coalesce(i, F.lit(LAST)).alias("i"), F.xxhash64(i, F.col(f"`{text_col}`")).alias("h1"), F.xxhash64(F.col(f"`{text_col}`"), F.lit(2)).alias("h2"))
    # rows with equal id and text are told apart by their number
    j = d.join(stay, ["i", "h1", "h2"]).withColumn("again", F.row_number().over(W.partitionBy("i", "h1", "h2").orderBy(F.xxhash64("x"))))
    return j.filter("empty OR again = 1").select("x.*")
