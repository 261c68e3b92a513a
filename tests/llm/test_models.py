import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentrel.llm import attention as at, importance, language_id as li, lm_score as lm

SF = "/root/testdata/sf0.01"
EDGES = [(90001, None), (90002, ""), (90003, " \n\t "), (90004, "The"), (90005, "ein wort " * 40), (90006, "z" * 5000), (90004, "The")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


def test_lm_counts_and_base(spark, docs, monkeypatch):
    monkeypatch.setattr("sentrel.llm.repeats.CHUNK_BYTES", 170_000)
    rows = [(r.doc_id, r.text) for r in docs.limit(150).collect()] + EDGES + [(None, "No id here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_texts(df, start_steps=5).collect()
    key = lambda r: (r.doc_id or 0, r.n_tokens, round(r.base_score, 3))
    again = {key(r): r.score for r in lm.score_texts(df.repartition(5), start_steps=5).collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [(d, (t or "").encode().translate(low).split() + [None]) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in words if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d or 0, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in words)
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) and abs(again[key(r)] - r.score) < 1e-3 * max(1, -r.score) for r in got)


def small_model(seed=1, steps=15):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 300, 150)
    counts = np.zeros(400, np.int64)
    counts[:300] = rng.integers(1, 90, 300)
    model = at.new_model(counts, 399, dim=8, hidden=12, inputs=200, hashed=7, single=20, bands=6, vectors=250, tails=3)
    return at.descend(model, [ids], steps, 8, 0.01, rng), ids


def by_hand(model, ids):
    """The log probability of each id, one by one, from the definition."""
    p, lay = {k: v.astype(float) for k, v in model.p.items()}, model.lay
    inputs = np.concatenate(([lay.end], ids[:-1]))
    out = []
    for t, x in enumerate(ids):
        first = max(0, t // at.OWN * at.OWN - at.OWN)
        e = p["E"][lay.row_of[inputs[first : t + 1]]]
        s = np.array([e[-1] @ p["Q"] @ (k @ p["K"]) / np.sqrt(len(k)) + p["R"][len(e) - 1 - j] for j, k in enumerate(e)])
        a = np.exp(s - s.max())
        h = (a / a.sum()) @ (e @ p["V"]) + e[-1]
        before = [p["E"][lay.row_of[inputs[t - k] if t >= k else lay.end]] for k in (1, 2)]
        h = h + before[0] @ p["S1"] + before[1] @ p["S2"]
        h = h + np.maximum(h @ p["U"] + p["c"], 0) @ p["W"]
        z = h @ p["O"] + p["b"]
        c = lay.class_of[x]
        r = z[c] - np.log(np.exp(z).sum()) + lay.inside[x]
        if lay.place[x] >= 0:
            y = p["I"][lay.cuts[c] : lay.cuts[c + 1]] @ h + p["i"][lay.cuts[c] : lay.cuts[c + 1]]
            r += y[lay.place[x] - lay.cuts[c]] - np.log(np.exp(y).sum())
        out.append(r)
    return np.array(out)


def test_each_id_is_scored_once_and_causally():
    model, ids = small_model()
    offs = np.array([0, 0, 1, 17, 100, 150])
    s = at.id_scores(model, ids, offs, batch=2)
    for a, b in zip(offs[:-1], offs[1:]):  # neither other texts nor later ids matter
        assert np.allclose(by_hand(model, ids[a:b]), s[a:b], atol=1e-4)
        if b - a > 20:
            assert np.allclose(at.id_scores(model, ids[a : b - 7], np.array([0, b - a - 7])), s[a : b - 7], atol=1e-5)
    # the probabilities of all ids at a place make one
    every = np.arange(400)
    for prefix in (ids[:0], ids[:5], ids[:40]):
        texts = np.concatenate([np.append(prefix, x) for x in every])
        last = at.id_scores(model, texts, np.arange(401) * (len(prefix) + 1))[len(prefix) :: len(prefix) + 1]
        assert abs(np.exp(last).sum() - 1) < 1e-4


def test_gradients_by_difference():
    model, ids = small_model(2, 3)
    x, valid, y = at.windows(np.array([0, 40, 150]))
    with_end = np.append(ids, 399)
    args = (model.lay.row_of[with_end[x]], valid, with_end[y], y >= 0)

    def loss():
        model.prepare()
        return -model.log_probs(model.hidden(args[0], valid)[-1], args[2].ravel())[args[3].ravel()].mean()

    got, g = at.gradients(model, *args)
    assert abs(got - loss()) < 1e-4
    rng = np.random.default_rng(0)
    for name, v in model.p.items():
        d = rng.normal(0, 1, v.shape).astype(np.float32) * (np.abs(g[name]) > 0)
        old, sides = v.copy(), []
        for sign in (1, -1):
            model.p[name] = old + np.float32(sign * 1e-3) * d
            sides.append(loss())
        model.p[name] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - float((g[name] * d).sum())) < 2e-3 + 0.03 * abs(float((g[name] * d).sum())), name


def texts_of(sizes, seed=4):
    return [np.random.default_rng([seed, i]).integers(0, 300, n) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("run", [1, 4])
def test_runs_train_as_windows_do(monkeypatch, run):
    monkeypatch.setattr(at, "RUN", run)
    model, _ = small_model()
    texts = texts_of((1, 16, 17, 0, 130, 64, 5))
    ids, offs = np.append(np.concatenate(texts), 399), np.cumsum([0, *map(len, texts)])
    x, valid, y = at.windows(offs)
    loss, g = at.gradients(model, model.lay.row_of[ids[x]], valid, ids[y], y >= 0)
    many = at.runs([t for t in texts if len(t)], model.lay)
    loss2, g2 = at.gradients(model, *many)
    assert abs(loss - loss2) < 1e-5 and all(np.allclose(g[k], g2[k], atol=1e-5) and np.abs(g[k]).max() > 1e-4 for k in g)
    # scores that do not fit 32 bits without their maximum taken off
    for k, by in (("O", 300), ("I", 300), ("Q", 3000)):
        model.p[k] *= np.float32(by)
    model.prepare()
    loss, g = at.gradients(model, *many)
    assert math.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


def test_training_sees_every_id_once(monkeypatch):
    model, _ = small_model()
    texts = texts_of([37] * 90 + [700])
    seen, real = [], at.gradients

    def spy(m, rows, valid, ids, there):
        seen.extend(ids[there].tolist())
        return real(m, rows, valid, ids, there)

    monkeypatch.setattr(at, "gradients", spy)
    at.descend(model, texts, None, 64, 0.01, np.random.default_rng(0))
    assert sorted(seen) == sorted(np.concatenate(texts).tolist())


def test_gradients_in_steps_add_up(monkeypatch):
    model, _ = small_model()
    many = at.runs(texts_of((1, 16, 17, 130, 64, 500)), model.lay)
    monkeypatch.setattr(at, "STEP", 1 << 20)
    loss, g = at.gradients(model, *many)
    monkeypatch.setattr(at, "STEP", at.OWN * at.RUN * 2)
    loss2, g2 = at.gradients(model, *many)
    assert abs(loss - loss2) < 1e-5 and g.keys() == g2.keys() == model.p.keys() and all(np.allclose(g[k], g2[k], atol=1e-6) for k in g)


@pytest.mark.parametrize("buckets", [1, 5])
def test_lm_keeps_texts_as_ids(buckets):
    """What is kept of a chunk gives its texts' ids and, in order of bucket, its counts."""
    class Ranks:
        value = lm.read_ranks(lm.TOKENIZER)

    texts = [None, "", "The the THE cat", "Zzyzx, " * 3, "x\u00e9 \u4e2d\u6587 cat", "z" * 5000]
    held = [False, True, False, False, True, False]
    n = len(texts)
    t = pa.table({"_id": pa.array([5, None, 7, 8, 9, 10], pa.int64()), "_text": pa.array(texts, pa.string()), "held_out": held, "u": list(range(n)), "v": list(range(10, 10 + n))})
    out = lm._send(buckets, Ranks)((pa.scalar(3),), t)
    words, kept = out.filter(pa.array([x is not None for x in out.column("bucket").to_pylist()])), out.slice(out.num_rows - 1)
    enc, low = lm.encoder(Ranks.value), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    split = [(x or "").encode().translate(low).split() for x in texts]
    want = [[i for w in ws for i in enc.encode_ordinary(" " + w.decode())] + [lm.END] for ws in split]
    c = lm.Encoded(kept)
    ids, offs = c.texts(0, n)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want and list(c.blocks(4)) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    count = Counter(w for ws, h in zip(split, held) if not h for w in [*ws, None])
    by_bucket = np.concatenate([lm.grow(x) for x in words.sort_by("bucket").column("c")])
    assert [by_bucket[x].tolist() for x in np.split(c.codes, c.offs[1:-1])] == [[count[w] for w in [*ws, None]] for ws in split]
    assert kept.column("_id").to_pylist() == [[5, None, 7, 8, 9, 10]]
    (batch,) = kept.to_batches()
    learned = [r for b in lm._learned(4 / lm.DRAWS, 4)([batch]) for r in b.to_pylist()]  # u below 4, not held out
    assert [(r["_id"], r["part"], np.frombuffer(r["ids"], lm.ID).tolist()) for r in learned] == [(5, 2, want[0]), (7, 0, want[2]), (8, 1, want[3])]


def test_lm_shrinks_whole_numbers():
    for kind in (np.int64, np.int32, np.uint16):
        for x in ([], [7], [0, 65535, 3]):
            assert lm.grow(pa.scalar(lm.shrink(np.array(x, np.int64), kind)), kind).tolist() == [np.array(v).astype(kind) for v in x]


def test_lm_counts_pass_32_bits():
    big = np.array([3_000_000_000, 0, 5], np.int64)
    assert lm.grow(pa.scalar(lm.shrink(big))).tolist() == big.tolist()
    assert lm._times(np.array([1, 1, 2]), np.array([3_000_000_000, 4_000_000_000, 1]), 3).tolist() == [0, 7_000_000_000, 1]


def test_lm_beats_the_base_on_held_out_texts(spark, docs):
    out = lm.score_texts(docs.select("doc_id", "text")).filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert out.s / out.n > out.b / out.n + 0.02


def test_lm_trains_on_a_share_that_grows(spark, docs, monkeypatch):
    seen, real = [], lm.train_parts

    def spy(drawn, parts, model, *a, **b):
        out = real(drawn, parts, model, *a, **b)
        seen.append((drawn.count(), parts, float(np.abs(out.p["E"] - model.p["E"]).max())))
        return out

    monkeypatch.setattr(lm, "train_parts", spy)
    monkeypatch.setattr(lm, "START_BYTES", 10_000)
    monkeypatch.setattr(lm, "PART_BYTES", 40_000)
    monkeypatch.setattr(lm, "FAN", 3)
    for n in (100, 800):
        lm.score_texts(docs.limit(n).select("doc_id", "text"), share=0.3, start_steps=2)
    small, large = seen[1 : lm.ROUNDS + 1], seen[lm.ROUNDS + 2 :]
    assert all(a > 10 and b > 4 * a and p > 3 for (a, _, _), (b, p, _) in zip(small, large)) and all(x[2] > 0 for x in seen)


def test_lm_trains_on_every_training_text(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(200).collect()]
    seen, real = [], lm.train_parts

    def spy(drawn, parts, *a, **b):
        seen.append((sorted(r[0] for r in drawn.select("_id").collect()), drawn.filter(F.col("part") >= parts).count(), parts))
        return real(drawn, parts, *a, **b)

    monkeypatch.setattr(lm, "train_parts", spy)
    monkeypatch.setattr(lm, "START_BYTES", 10_000)
    monkeypatch.setattr(lm, "PART_BYTES", 200_000)
    lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), start_steps=2)
    want = sorted(d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2)
    assert len(seen) == 1 + lm.ROUNDS and all(ids == want and left == 0 and parts > 1 for ids, left, parts in seen[1:])


def test_lm_means_of_models():
    models = [np.array([1.0, 2.0], np.float32), np.array([4.0, 8.0], np.float32)]
    assert lm._mean([1.0, 2.0], [m.tobytes() for m in models]).tolist() == [3.0, 6.0]
    assert lm._mean([0.0], [models[0].tobytes()]).tolist() == [0.0, 0.0]


def test_lm_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_with_odd_blanks():
    ranks = lm.read_ranks(lm.TOKENIZER)
    words = ["a b".encode(), b"plain", "x ".encode(), b"\x1c", "é".encode()]
    ids, n = lm.encode_words(words, ranks)
    assert len(n) == 5 and n.sum() == len(ids) and (n > 0).all()


def test_language_accuracy_and_edges(spark, docs):
    extra = spark.createDataFrame([(d, t, None) for d, t in EDGES] + [(90007, "123 !!", "en")], "doc_id long, text string, lang string")
    out = li.identify(docs.unionByName(extra)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in out if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert {r.lang_pred for r in out if r.doc_id in (90001, 90002, 90003, 90007)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 1000 + len(EDGES) + 1
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.identify(none).collect()] == ["und"]


def test_importance_separates(spark, docs):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(EDGES, "doc_id long, text string"))
    out = importance.resample(df, lab).cache()
    n = df.count()
    assert out.count() == n and sorted(r.rank for r in out.select("rank").collect()) == list(range(1, n + 1))
    j = out.join(lab, "doc_id").groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    k = {r.good: r.k for r in j}
    assert k[True] > 0.9 and k[False] < 0.4
    assert importance.resample(df.limit(0), lab.limit(0)).count() == 0


def words_of(t):
    return (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()


def test_importance_weights_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.geometric(0.1 if i % 2 else 0.2, rng.integers(0, 40)))) for i in range(120)] + [(500, None), (None, "w1 w2"), (None, "w1 w9"), (7, "w3 w4 w5")]
    lab = [(i, int(i % 2), int(i % 10 == 1)) for i in range(80)] + [(81, None, None), (None, 1, 0)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = importance.resample(df, labels).collect()
    good = {d for d, q, t in lab if d is not None and q == 1 and not t}
    grams = lambda t: [(x,) for x in words_of(t)] + list(zip(words_of(t), words_of(t)[1:]))
    slots = {}

    def slot(g):  # hashed features may meet; which ones do is taken from the operator
        if g not in slots:
            b = b" ".join(g)
            f, _ = importance.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 20, (len(g),))
            slots[g] = int(f[0])
        return slots[g]

    raw, tgt = Counter(), Counter()
    for d, t in rows:
        for g in grams(t):
            raw[slot(g)] += 1
            tgt[slot(g)] += d in good
    share = sum(tgt.values()) / sum(raw.values())
    ratio = {k: math.log((tgt[k] + 5) / (raw[k] * share + 5)) for k in raw}
    mean = sum(ratio[k] * n for k, n in tgt.items()) / sum(tgt.values())
    weight = lambda g: round(30 * sum(ratio[slot(x)] - mean for x in g) / len(g), 3) if g else -math.inf
    number = lambda d: -1 if d is None else d
    assert sorted((number(r.doc_id), round(r.log_weight, 3)) for r in got) == sorted((number(d), weight(grams(t))) for d, t in rows)
    assert sum(r.kept for r in got) == round(len(good) / 81 * len(rows))
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))


def test_importance_draws_by_weight(spark):
    """Two kinds of texts, one with three times the weight: how often each is among
    the k largest keys follows the weights, and nobody is certain."""
    n, k, hits = 300, 60, Counter()
    w = spark.createDataFrame([(i, math.log(3.0) if i % 2 else 0.0) for i in range(n)], "id long, w double")
    for seed in range(40):
        keyed = w.withColumn("key", F.col("w") + importance.gumbel(seed, F.col("id")))
        hits.update(r.id for r in keyed.orderBy(F.desc("key")).limit(k).collect())
    odd, even = (sum(v for i, v in hits.items() if i % 2 == m) for m in (1, 0))
    assert 2.0 < odd / even < 3.2 and max(hits.values()) < 36 and len(hits) > 0.95 * n


def test_language_by_hand(spark):
    """Scores from the definition: mean of hashed embeddings, softmax, temperature."""
    rng = np.random.default_rng(0)
    langs = {"aa": "abc", "bb": "xyz", "cc": "mno"}
    rows = [(lang, " ".join("".join(rng.choice(list(ab), 5)) for _ in range(20))) for lang, ab in langs.items() for _ in range(30)]
    data = []
    for lang, t in rows:
        u, n = np.unique(li.buckets(np.frombuffer(t.encode(), np.uint8)), return_counts=True)
        data.append((lang, u, n.astype(float)))
    model = li.train(data)
    texts = ["abc cab", "XYZ zyx yx", "mno abc", "Ünï", "12 34", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in li.predict(df, model).collect()}
    for i, t in enumerate(texts):
        letters = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in t.lower())
        grams = [g for g in (bytes(x) for x in zip(*(list(letters.encode())[k:] for k in range(3)))) if g != b"   "]
        if not grams:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        at_ = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> 19 for g in grams]
        z = (sum(model.table[a] for a in at_) / len(at_) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == model.labels[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-9
        assert got[i].rejected == bool(p.max() < model.threshold)
    assert got[0].lang_pred == "aa" and got[1].lang_pred == "bb"
    model.threshold = 2.0
    assert all(r.rejected for r in li.predict(df, model).collect())


def test_importance_log_ratios_of_nothing():
    ratio, mean = importance.log_ratios(np.array([10, 0, 90]), np.array([0, 0, 0]))
    assert np.isfinite(ratio).all() and mean == 0
