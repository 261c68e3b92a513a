import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from sentrel.llm import automaton_dedup, repeats, suffix_dedup

SCHEMA = "doc_id long, text string"


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "of", "and", "è", "x"] + [f"w{i}" for i in range(40)]
    shared = [" ".join(rnd.choice(words) for _ in range(rnd.randint(10, 90))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared).split()
            if rnd.random() < 0.6 and s:
                s[rnd.randrange(len(s))] = f"edit{rnd.random()}"
            parts.append((" " if rnd.random() < 0.7 else "\n\t").join(s))
        rnd.shuffle(parts)
        out.append((i, " ".join(parts)))
    base = out[3][1]
    return out + [(1000, None), (1001, ""), (1002, base), (1003, base), (1004, " ".join(["a"] * 400)), (1005, "x" * 999), (1006, "y" * 200), (1007, " \n ")]


def brute_bytes(rows, size):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + size] for _, b in texts for i in range(len(b) - size + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def brute_words(rows, size):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed,chunk,hot", [(1, 1 << 20, 4096), (2, 12_000, 4096), (3, 4000, 4096), (4, 12_000, 5), (5, 1 << 20, 0)])
def test_bytes(spark, monkeypatch, seed, chunk, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MANY", min(16, hot + 1))
    monkeypatch.setattr("sentrel.llm.repeats.CHUNK_BYTES", chunk)
    rows = corpus(seed)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_symbols, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes(rows, 200)


@pytest.mark.parametrize("seed,chunk,hot", [(1, 1 << 20, 4096), (2, 12_000, 4096), (3, 4000, 4096), (4, 12_000, 5), (5, 1 << 20, 0)])
def test_words(spark, monkeypatch, seed, chunk, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MANY", min(16, hot + 1))
    monkeypatch.setattr("sentrel.llm.repeats.CHUNK_BYTES", chunk)
    rows = corpus(seed)
    got = automaton_dedup.dedup_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_symbols, r.n_removed, r.kept) for r in got) == brute_words(rows, 13)


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup_substrings(df).count() == 0
    wide = spark.createDataFrame([(1, "a b", "kept", 5), (None, None, None, 1)], "doc_id long, text string, kept string, chunk int")
    got = automaton_dedup.dedup_passages(wide, carry=True).collect()
    assert sorted((r["_x"]["kept"] or "", r["_x"]["chunk"]) for r in got) == [("", 1), ("kept", 5)]


@pytest.mark.parametrize("size", [1, 8, 13, 24, 25, 38, 200])
def test_cover_sort(monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    rng = np.random.default_rng(size)
    for kinds in (1, 2, 4, 200):
        base, parts = rng.integers(0, kinds, 600).astype(np.uint8), []
        for _ in range(8):
            part = base[rng.integers(0, 300) :].copy()
            part[rng.integers(0, len(part), rng.integers(0, 3))] = 255
            parts.append(part)
        n = np.array([len(x) - size + 1 for x in parts])
        raw, at = np.concatenate(parts), np.cumsum(n + size - 1) - (n + size - 1)
        pos = repeats._ranges(at, at + n)
        count = Counter(raw[p : p + size].tobytes() for p in pos)
        assert suffix_dedup.repeated_windows(raw, pos, size).tolist() == [count[raw[p : p + size].tobytes()] > 1 for p in pos]


def test_edges_of_a_common_passage_spread():
    """Many texts around one passage: no bucket gets much more than the others."""
    rng = np.random.default_rng(7)
    rule, buckets = automaton_dedup.rule(), 8
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 10**9, 60)), passage, *(f"w{x}" for x in rng.integers(0, 10**9, 60))]) for _ in range(10_000)]
    chunks = [pa.table({"_id": pa.array(range(i, i + 500), pa.int64()), "_text": pa.array(texts[i : i + 500])}) for i in range(0, 10_000, 500)]
    heads = pa.concat_tables([repeats._heads(rule, buckets)((pa.scalar(i),), t) for i, t in enumerate(chunks)])
    by = lambda t, c, k: t.filter(pa.compute.equal(t.column(c), k))
    seen = pa.concat_tables([repeats._classes(rule)(by(heads, "bucket", b)) for b in range(buckets)])
    opened = pa.concat_tables([repeats._open(rule, buckets)((pa.scalar(i),), t, by(seen, "chunk", i)) for i, t in enumerate(chunks)])
    assert 3 in seen.column("kind").to_pylist()
    for sent in (heads, opened):
        size = [sum(len(x.as_buffer()) for c in ("a", "r", "raw") for x in by(sent, "bucket", b).column(c) if x.is_valid) for b in range(buckets)]
        assert max(size) < 2 * sorted(size)[buckets // 2], size


def test_pieces_of_long_texts_have_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(2)
    values, offs = rng.integers(0, 2**63, 3000, dtype=np.uint64), np.array([0, 5, 1700, 1700, 3000])
    whole = repeats.runs_of(values, offs, 13, 5)
    anchor = lambda r: {int(p): int(a) for s, e, a in zip(r.s, r.e, r.a) for p in range(s, e)}
    monkeypatch.setattr(repeats, "POS_BITS", 9)
    part = repeats.runs_of(values, offs, 13, 5)
    assert anchor(part) == anchor(whole) and len(part.s) > len(whole.s)
