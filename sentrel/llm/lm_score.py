"""Operator 2: log probability of texts under a causal self-attention model.

The model (attention.py) reads subword ids of a public tokenizer (``tokenizer``: its
rank file) and its softmax covers all of them, so a text's score is the log10
probability of its sequence of ids, end included: words are read lower-cased and each
after a blank, and the next word's blank or the end tells where a word ends. Nothing
else enters the score.

Training: the shares of all ids in all training texts are the start; a first pass over
about START_BYTES of whole texts, then ROUNDS passes over all training texts (over a
``share`` of them if one is asked for). They are trained in parts of about PART_BYTES
side by side; each round averages the parts' models by their windows, in a tree of
tasks.

Word counts (for ``base_score``) and id counts come from all training texts: chunks
send their different words to buckets, which add them up and send each chunk the
totals of its own words. Counts are 64-bit. Texts are read and encoded once, while
words are counted; a chunk's texts are kept as numbers of its different words, and
those as ids, and both training and scoring go on from there.

NULL and empty texts are a single end. The held-out texts add to no count and to no
training. Rows with equal ids, or none, are all scored. Without training texts every
count is 0 and all ids are equally likely.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrel.llm import graph, seq
from sentrel.llm.attention import OWN, Attention, descend, id_scores, new_model, ranges
from sentrel.llm.language_id import held_out
from sentrel.llm.repeats import chunk_count
from sentrel.llm.seq import U

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed values of the tokenizer: its word pattern and its first free id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
VOCAB = 50257
START_BYTES = 2 << 20
PART_BYTES = 8 << 20
ROUNDS = 1
FAN = 8  # models averaged by one task, and sent to the driver at last
ID = np.uint16  # of ids as they are kept; VOCAB fits
DRAWS = 1 << 30
END_HASH = int(seq.mix(np.array([0x5E0F], dtype=U))[0])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


_ENCODERS: dict[int, object] = {}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    if id(ranks) not in _ENCODERS:
        _ENCODERS[id(ranks)] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[id(ranks)]


def encode_words(words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each): each word is read after a blank."""
    enc = encoder(ranks)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    out, size = [], []
    for i in range(0, len(words), 20_000):
        part = words[i : i + 20_000]
        ids = np.array(enc.encode_ordinary("".join(f" {w}\n" for w in (x.decode("utf-8", "replace") for x in part))), dtype=np.int32)
        line = ids == 198
        if int(line.sum()) == len(part) and ids[-1] == 198:
            at = np.flatnonzero(line)
            n = np.diff(np.concatenate(([-1], at))) - 1
            ids = ids[~line]
        else:  # a word holds what the pattern takes for white space
            each = [enc.encode_ordinary(" " + x.decode("utf-8", "replace")) for x in part]
            n, ids = np.array([len(x) for x in each]), np.concatenate([np.array(x, np.int32) for x in each])
        out.append(ids)
        size.append(n)
    return np.concatenate(out), np.concatenate(size).astype(np.int64)


def shrink(a: np.ndarray, kind=np.int64) -> bytes:
    """Whole numbers as compressed bytes, their length first: all lowest bytes, then all
    next ones, as high bytes are mostly equal."""
    x = np.ascontiguousarray(a, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def grow(x, kind=np.int64) -> np.ndarray:
    b, size = memoryview(x.as_buffer()), np.dtype(kind).itemsize
    y = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(y.reshape(size, -1).T).view(kind).ravel()


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted different values, where each is first, which of them each is)."""
    code, values = pd.factorize(x)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(x) else np.zeros(0, np.int64)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return values[order], first[order], rank[code]


class Chunk:
    """The words of a chunk's texts, each with one end; different words by hash."""

    def __init__(self, texts) -> None:
        hs, lens, starts, ends, bufs, base = [], [], [], [], [], 0
        for _, _, buf, offs in seq.batches(texts):
            w = seq.Words(buf, offs, lower=True)
            hs.append(w.hashes())
            lens.append(np.diff(w.offs))
            starts.append(w.starts + base)
            ends.append(w.ends + base)
            bufs.append(w.buf)
            base += len(buf)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        n, flat = cat(lens, np.int64), cat(hs, U)
        unique, first, inverse = distinct(flat)
        data, s, e = cat(bufs, np.uint8).tobytes(), cat(starts, np.int64)[first].tolist(), cat(ends, np.int64)[first].tolist()
        self.words: list[bytes] = [data[i:j] for i, j in zip(s, e)]  # the end comes last, without a word
        self.unique = np.append(unique, U(END_HASH))
        self.n_tokens = n + 1
        self.offs = np.concatenate(([0], np.cumsum(self.n_tokens)))
        self.inverse = np.full(int(self.offs[-1]), len(unique), np.int32)
        is_word = np.ones(len(self.inverse), bool)
        is_word[self.offs[1:] - 1] = False
        self.inverse[is_word] = inverse
        self.text = np.repeat(np.arange(len(n), dtype=np.int32), self.n_tokens)

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        b = (self.unique % U(buckets)).astype(np.int64)
        o = np.argsort(b, kind="stable")
        return b, o


WORDS = "bucket long, chunk long, h binary, c binary, ids binary"
TEXTS = "flat binary, size binary, codes binary, n_tokens binary, _id array<bigint>, held_out array<boolean>, u array<bigint>, v array<bigint>"
TOTALS = "chunk long, bucket long, c binary, n_sum long, v_sum long, ids binary"


def _times(x: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``size`` numbers occurs when x[i] is there n[i] times; whole numbers."""
    out = np.zeros(size, np.int64)
    np.add.at(out, x, n)
    return out


def _send(buckets: int, ranks):
    def f(key, t):
        c = Chunk(t.column("_text"))
        train = ~t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool) if t.num_rows else np.zeros(0, bool)
        counts = np.bincount(c.inverse[train[c.text]], minlength=len(c.unique))
        flat, size = encode_words(c.words, ranks.value)
        per_id = _times(flat, np.repeat(counts[:-1], size), VOCAB)
        per_id[END] += counts[-1]
        b, o = c.order(buckets)
        b = b[o]
        at = seq.group_starts(b).tolist()
        cuts = list(zip(at, [*at[1:], len(b)]))
        n = len(cuts)
        # words are numbered as their totals come back
        flat, size, number = np.append(flat, END), np.append(size, 1), np.empty(len(o), np.int32)
        number[o] = np.arange(len(o), dtype=np.int32)
        start = np.cumsum(size) - size
        out = {
            "bucket": pa.array([int(b[i]) for i, _ in cuts] + [None], pa.int64()), "chunk": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
            "h": pa.array([c.unique[o[i:j]].tobytes() for i, j in cuts] + [None], pa.binary()), "c": pa.array([shrink(counts[o[i:j]]) for i, j in cuts] + [None], pa.binary()),
            "ids": pa.array([shrink(per_id) if i == 0 else None for i, _ in cuts] + [None], pa.binary()),
            **{k: pa.array([None] * n + [shrink(x, kind)], pa.binary()) for k, x, kind in (("flat", flat[ranges(start[o], (start + size)[o])], ID), ("size", size[o], np.int32), ("codes", number[c.inverse], np.int32), ("n_tokens", c.n_tokens, np.int64))},
        }
        return pa.table(out | {k: pa.array([None] * n + [t.column(k).to_pylist()], pa.list_(kind)) for k, kind in (("_id", pa.int64()), ("held_out", pa.bool_()), ("u", pa.int64()), ("v", pa.int64()))})

    return f


def _add(t):
    h, per = seq.unpack(t.column("h"), U)
    c = np.concatenate([grow(x) for x in t.column("c")])
    u, where = np.unique(h, return_inverse=True)
    total = _times(where, c, len(u))
    cuts, n = np.cumsum(per).tolist(), t.num_rows
    per_id = sum((grow(x) for x in t.column("ids") if x.is_valid), np.zeros(VOCAB, np.int64))
    return pa.table({
        "chunk": t.column("chunk"), "bucket": t.column("bucket"), "c": pa.array([shrink(total[where[e - k : e]]) for e, k in zip(cuts, per.tolist())], pa.binary()),
        "n_sum": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), "v_sum": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
        "ids": pa.array([shrink(per_id)] + [None] * (n - 1), pa.binary()),
    })


def _merge_ids(batches):
    total = np.zeros(VOCAB, np.int64)
    for b in batches:
        for x in b.column("ids"):
            total += grow(x)
    yield pa.RecordBatch.from_pydict({"ids": pa.array([shrink(total)], pa.binary())})


class Encoded:
    """A chunk's texts, from its row of TEXTS: numbers of its different words, whose ids
    are kept; texts' ids on demand."""

    def __init__(self, t, row: int = 0) -> None:
        self.flat, self.size, self.codes, self.n_tokens = (grow(t.column(k)[row], kind) for k, kind in (("flat", ID), ("size", np.int32), ("codes", np.int32), ("n_tokens", np.int64)))
        self.start = np.cumsum(self.size) - self.size
        self.offs = np.concatenate(([0], np.cumsum(self.n_tokens)))

    def texts(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Of texts [i, j): (ids, offsets of texts)."""
        codes = self.codes[self.offs[i] : self.offs[j]]
        s, k = self.start[codes], self.size[codes]
        tok = np.concatenate(([0], np.cumsum(k)))
        return self.flat[ranges(s, s + k)].astype(np.int32), tok[self.offs[i : j + 1] - self.offs[i]]

    def blocks(self, tokens: int = 1 << 15):
        """Texts [i, j) of about so many tokens; a longer text is alone."""
        i, n = 0, len(self.n_tokens)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offs, self.offs[i] + tokens, "right")) - 1)
            yield i, j
            i = j


def _learned(share: float, parts: int):
    """Training texts of chunks one by one, as the bytes of their ids."""

    def f(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                held, u, v = (np.array(batch.column(k)[row].as_py()) for k in ("held_out", "u", "v"))
                mine = np.flatnonzero(~held.astype(bool) & (u < share * DRAWS))
                if not len(mine):
                    continue
                c, numbers = Encoded(batch, row), batch.column("_id")[row].values.take(pa.array(mine))
                part = v[mine] % parts
                for i, j in c.blocks():
                    here = slice(*np.searchsorted(mine, (i, j)).tolist())
                    if here.start < here.stop:
                        ids, offs = c.texts(i, j)
                        data, at = ids.astype(ID).tobytes(), (offs * np.dtype(ID).itemsize).tolist()
                        texts = pa.array([data[at[k - i] : at[k - i + 1]] for k in mine[here].tolist()], pa.binary())
                        yield pa.RecordBatch.from_pydict({"_id": numbers[here], "part": pa.array(part[here], pa.int64()), "ids": texts})

    return f


def _text_ids(t: pa.Table) -> list[np.ndarray]:
    """Of a part's texts, in an order that does not depend on partitions."""
    return [np.frombuffer(x.as_buffer(), ID).astype(np.int32) for x in t.sort_by([("_id", "ascending"), ("ids", "ascending")]).column("ids")]


def pack_model(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()]).astype(np.float32)


def unpack_model(like: Attention, flat: np.ndarray) -> Attention:
    p, at = {}, 0
    for k, v in like.p.items():
        p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return Attention(like.lay, p)


PARTS = "part long, n double, x binary"


def _add_models(t):
    """Weighted means of models, in order of part."""
    t = t.sort_by("part")
    n = t.column("n").to_pylist()
    return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()), "n": pa.array([sum(n)], pa.float64()), "x": pa.array([_mean(n, t.column("x").to_pylist()).tobytes()], pa.binary())})


def _mean(n: list[float], models: list[bytes]) -> np.ndarray:
    """Summed up in 64 bits, one model at a time."""
    total = 0.0
    for k, x in zip(n, models):
        total = total + k * np.frombuffer(x, np.float32).astype(np.float64)
    return (total / max(1.0, sum(n))).astype(np.float32)


def train_parts(drawn: DataFrame, parts: int, model: Attention, seed: int, rate: float, batch: int, steps: int | None = None) -> Attention:
    """Every part (column ``part`` below ``parts``) goes on from ``model`` over all its
    windows once, or for ``steps``; the parts' models are averaged by their windows."""
    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def f(key, t):
        ids = _text_ids(t)
        n = sum(-(-len(x) // OWN) for x in ids)
        m = Attention(shared.value.lay, dict(shared.value.p))
        descend(m, ids, steps, batch, rate, np.random.default_rng([seed, key[0].as_py()]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.float64()), "x": pa.array([pack_model(m.p).tobytes()], pa.binary())})

    # more partitions than parts, as a task that gets several parts by chance ends late
    sums = drawn.repartition(parts + 200, "part").groupBy("part").applyInArrow(f, PARTS)
    while parts > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(_add_models, PARTS)
        parts = -(-parts // FAN)
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    shared.unpersist()
    n = [r["n"] for r in rows]
    return unpack_model(model, _mean(n, [r["x"] for r in rows])) if sum(n) else model


def _score(shared, big_n: int, big_v: int):
    def f(t, back):
        if not t.num_rows:
            return pa.table({"_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})
        c = Encoded(t)
        total = np.concatenate([grow(x) for x in back.sort_by("bucket").column("c")])
        score = np.zeros(len(c.n_tokens))
        for i, j in c.blocks():
            ids, offs = c.texts(i, j)
            score[i:j] = np.add.reduceat(id_scores(shared.value, ids, offs), offs[:-1])
        base = (np.log10(total + 1.0) - np.log10(big_n + 1.0 * (big_v + 1)))[c.codes]
        add = lambda w: np.add.reduceat(w, c.offs[:-1])
        return pa.table({
            **{k: t.column(k).combine_chunks().flatten() for k in ("_id", "held_out")}, "n_tokens": c.n_tokens, "n_known": add((total > 0)[c.codes].astype(np.int64)),
            "base_score": add(base), "score": score / np.log(10),
        })

    return f


def score_texts(docs: DataFrame, mod: int = 7, share: float = 1.0, start_steps: int = 400, start_batch: int = 256, batch: int = 1024, rate: float = 0.04, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row
    per input row. Counts words and trains before the result is read; ``shape`` is
    that of the model (attention.new_model)."""
    spark: SparkSession = docs.sparkSession
    i = F.col(f"`{id_col}`").cast("bigint")
    d = docs.select(i.alias("_id"), F.col(f"`{text_col}`").alias("_text"), held_out(i, mod).alias("held_out"))
    chunks, size = chunk_count(d, ~F.col("held_out"))
    buckets = max(1, chunks // 4)
    ranks = spark.sparkContext.broadcast(read_ranks(tokenizer))
    drawn = lambda seed: F.xxhash64("_id", "_text", F.lit(seed))
    d = d.withColumns({"chunk": F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)), "u": F.pmod(drawn(77), F.lit(DRAWS)), "v": F.pmod(drawn(78), F.lit(1 << 62))})
    sent = graph.written(d.groupBy("chunk").applyInArrow(_send(buckets, ranks), f"{WORDS}, {TEXTS}"))
    texts = sent.filter("bucket IS NULL").select("chunk", "flat", "size", "codes", "n_tokens", "_id", "held_out", "u", "v")
    graph.free(spark)
    totals = graph.written(sent.filter("bucket IS NOT NULL").select("bucket", "chunk", "h", "c", "ids").groupBy("bucket").applyInArrow(_add, TOTALS))
    sums = totals.agg(F.coalesce(F.sum("n_sum"), F.lit(0)).alias("n"), F.coalesce(F.sum("v_sum"), F.lit(0)).alias("v")).first()
    merged = totals.filter("ids IS NOT NULL").select("ids").mapInArrow(_merge_ids, "ids binary").coalesce(FAN).mapInArrow(_merge_ids, "ids binary")
    counts = sum((grow(pa.scalar(bytes(r["ids"]))) for r in merged.collect()), np.zeros(VOCAB, np.int64))
    model = new_model(counts, END, **shape)
    if size:
        first = min(1.0, START_BYTES / size)
        share = max(first, share)
        parts = max(1, round(share * size / PART_BYTES))
        graph.free(spark)  # the shuffled texts and words go from the disks (see graph.written)
        learned = lambda share, parts: texts.mapInArrow(_learned(share, parts), "_id long, part long, ids binary")
        model = train_parts(learned(first, 1), 1, model, 0, rate, start_batch, start_steps)
        for k in range(ROUNDS):
            model = train_parts(learned(share, parts), parts, model, k + 1, rate, batch)
        graph.free(spark)  # the shuffled training texts go from the disks, too
    shared = spark.sparkContext.broadcast(model)
    out = texts.groupBy("chunk").cogroup(totals.select("chunk", "bucket", "c").groupBy("chunk")).applyInArrow(_score(shared, sums["n"], sums["v"]), "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("bigint").alias("train_tokens"), "base_score", "score")
