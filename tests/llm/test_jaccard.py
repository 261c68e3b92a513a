import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentrel.llm import graph, jaccard_join

SCHEMA = "doc_id long, text string"


def corpus(seed, n=60):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.randint(3, 150))] for _ in range(n // 6)]
    out = [(900, None), (901, ""), (902, "One"), (903, "one"), (904, "a b"), (905, "A B"), (906, "a b c"), (907, "x " * 50), (908, "x " * 70)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            p = rnd.randrange(len(w))
            w[p] = f"e{rnd.randrange(10**6)}" if rnd.random() < 0.8 else w[p].upper()
        out.append((i, " ".join(w)))
    return out


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split() if (t or "").isascii() else None
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return sorted((d, len(sets[d]), label[d]) for d in sets)


@pytest.mark.parametrize("seed,chunk,tile,k,num", [(1, 1 << 20, 1500, 3, 90), (2, 4000, 3, 3, 90), (3, 6000, 2, 5, 80)])
def test_groups(spark, monkeypatch, seed, chunk, tile, k, num):
    monkeypatch.setattr("sentrel.llm.repeats.CHUNK_BYTES", chunk)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = corpus(seed)
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, SCHEMA), k, num).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, num, 100)


def test_tree_keeps_every_link():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, 380, replace=False), rnd.integers(0, 2**63, rnd.integers(0, 40), dtype=np.uint64)])) for _ in range(120)]
    sets.sort(key=len)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - c)}
    got = {(a, b) for i, j in jaccard_join.SignatureTree(sets).candidates(90, 100) for a, b in zip(i.tolist(), j.tolist())}
    assert want and want <= got


def test_components_of_a_path_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0
    assert jaccard_join.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(120)]
    near = " ".join([*words[:119], "other"])
    far = " ".join(f"v{i}" for i in range(60))
    rows = [(5, " ".join(words), 1), (None, near, 2), (None, far, 3), (None, far + " end", 4), (7, "one two three four", 5), (7, far + " tail", 6), (9, "one two three four", 7), (7, "one two three four", 8), (None, None, 9), (None, "", 10), (None, "  ", 11), (None, "", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x long")
    got = sorted(map(tuple, jaccard_join.similar_groups(df).collect()), key=str)
    assert got == sorted([(5, 118, 5), (None, 118, 5), (None, 58, 7), (None, 59, 7), (7, 2, 7), (7, 59, 7), (9, 2, 7), (7, 2, 7), *[(None, 0, None)] * 4], key=str)
    kept = jaccard_join.drop_near_copies(df, 3, 90)
    assert kept.columns == df.columns
    xs = {r.x for r in kept.collect()}
    assert {1, 6, 9, 10, 11, 12} <= xs and len(xs & {5, 8}) == 1 and len(xs) == 7
    none = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 2), (None, "x y z", 3)], df.schema)
    assert [r.component_id for r in jaccard_join.similar_groups(none).collect()] == [None] * 3
    assert len({1, 2} & {r.x for r in jaccard_join.drop_near_copies(none).collect()}) == 1
    odd = df.select("doc_id", "text", *[F.col("x").alias(c) for c in ("i", "h1", "h2", "empty", "again", "_stay", "group", "least", "n", "_id", "chunk", "X_1")])
    assert jaccard_join.drop_near_copies(odd, 3, 90).columns == odd.columns and jaccard_join.drop_near_copies(odd, 3, 90).count() == 7
