"""Vectors of texts, top-k joins and report prompts, against plain numpy."""

import hashlib
import math
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentrel.config import _zone
from sentrel.operators import reports, retrieval, text_vectors as tv
from sentrel.sources import sinks


def nearest(queries, corpus, k):
    out = []
    for q, a in queries:
        found = []
        for c, b in corpus:
            if not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            a1, b1 = np.array(a, float), np.array(b, float)
            norm = math.sqrt((a1 * a1).sum()) * math.sqrt((b1 * b1).sum())
            if norm > 0:
                found.append((1 - float(a1 @ b1) / norm, c))
        out += [(q, i + 1, c, d) for i, (d, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_topk_join(spark, block):
    """Many stripes, ties, copies, zero, NULL, empty and shorter vectors."""
    r = np.random.default_rng(block)
    row = lambda: [int(x) for x in r.integers(-2, 3, 4)]
    corpus = [(i, row()) for i in range(50)] + [(50, None), (51, []), (52, [0, 0, 0, 0]), (53, [1, 2]), (54, [1, None, 0, 0])] + [(i, [1, 1, 0, 0]) for i in range(60, 80)]
    queries = [(f"q{i}", row()) for i in range(17)] + [("same", [1, 1, 0, 0]), ("null", None), ("zero", [0] * 4), ("short", [2, 1]), ("empty", [])]
    q, c = spark.createDataFrame(queries, "query_id string, vector array<int>"), spark.createDataFrame(corpus, "id long, vector array<int>")
    for k in (1, 4, 200):
        got = sorted((x.query_id, x["rank"], x.id, x.distance) for x in retrieval.topk_join(q, c, k, block=block).collect())
        assert [g[:3] for g in got] == [w[:3] for w in nearest(queries, corpus, k)]
        assert np.allclose([g[3] for g in got], [w[3] for w in nearest(queries, corpus, k)])
    assert retrieval.topk_join(q, c.limit(0), 2).count() == 0 and retrieval.topk_join(q.limit(0), c, 2).count() == 0


def by_hand(text, texts, dims):
    def counts(t):
        out = [0] * dims
        for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")):
            for g in [w, *[f" {w} "[i : i + 3] for i in range(len(w))]]:
                out[int(hashlib.md5(g.encode()).hexdigest()[:6], 16) % dims] += 1
        return out

    having = [sum(counts(t)[i] > 0 for t in texts) for i in range(dims)]
    return [n * (1 + math.floor(16 * math.log((len(texts) + 1) / (h + 1)) + 0.5)) for n, h in zip(counts(text), having)]


def test_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tv, "REMEMBERED", 3)
    texts = ["Rules for Flouci", "rules, rules", None, "", "é 12 ,;", "x " * 500, "wallet transfers in Tunis"]
    df = spark.createDataFrame(list(enumerate(texts)), "vector_id long, text string").repartition(3)
    w = tv.fit(df, dims=32)
    assert {r.vector_id: r.vector for r in tv.vectors(df, w).collect()} == {i: by_hand(t, texts, 32) for i, t in enumerate(texts)}
    tv.save(spark, w, str(tmp_path / "w"))
    assert tv.load(spark, str(tmp_path / "w")) == w
    assert tv.fit(df.limit(0), dims=4).values == (1, 1, 1, 1) and tv.vectors(df.limit(0), w).count() == 0


def test_each_alert_has_its_own_context(spark, tmp_path):
    rules = [("a", "Circular on mobile wallet transfers by Flouci in Tunis"), ("b", "Konnect payments in Sfax are capped"), ("c", None)]
    corpus = spark.createDataFrame(rules, "id string, text string")
    al = spark.createDataFrame([("t-1", "u", 5.0, "Tunis", "Flouci", 0.9, "2024"), ("t:2", None, None, "Sfax", "Konnect", None, None), ("t3", "v", 1.0, None, None, 0.5, "x")], "transaction_id string, user_id string, amount_tnd double, governorate string, payment_method string, ml_probability double, timestamp string")
    top = retrieval.alert_contexts(al, corpus)
    assert {(r.transaction_id, r.id) for r in top.filter("rank = 1 AND transaction_id <> 't3'").collect()} == {("t-1", "a"), ("t:2", "b")}
    assert top.filter("transaction_id = 't3'").first().question == "rules for unknown in unknown"
    prompts = {r.transaction_id: r.prompt.split("\n") for r in reports.sar_prompt(al, contexts=top).collect()}
    assert prompts["t:2"][:7] == ["INVESTIGATION: Analyze suspicious activity for user UNKNOWN.", "Transaction ID: t:2", "ML Score: 0.00", "Amount: 0.00 TND", "Governorate: Sfax", "Payment Method: Konnect", "Timestamp: UNKNOWN"]
    assert prompts["t-1"][7] == "Regulatory Context: " + rules[0][1]
    assert retrieval.alert_contexts(al, corpus.limit(0)).count() == 0
    bare = reports.sar_prompt(al, contexts=retrieval.alert_contexts(al, corpus.limit(0))).first().prompt
    assert "No specific regulatory context found." in bare

    def writer(prompt):
        if "Sfax" in prompt.split("\n")[4]:
            raise ValueError("no answer")
        return prompt.split("\n")[1].upper()

    said = reports.written_reports(reports.sar_prompt(al, contexts=top), writer)
    assert {r.transaction_id: r.sar_report for r in said.collect()} == {"t-1": "TRANSACTION ID: T-1", "t:2": "Error: no answer", "t3": "TRANSACTION ID: T3"}
    assert "Generated: 20" in reports.sar_document(al).first().document
    docs = reports.sar_document(al.join(said, "transaction_id"), datetime(2024, 5, 6, 7, 8, 9))
    one = docs.filter(F.col("filename") == "SAR_t_1.txt").first().document.split("\n")
    assert one[1] == "Generated: 2024-05-06T07:08:09" and one[5:9] == ["Amount: 5.00 TND", "Governorate: Tunis", "Payment Method: Flouci", "Timestamp: 2024"] and one[-2:] == ["REPORT:", "TRANSACTION ID: T-1"]
    for _ in range(2):
        sinks.write_report_files(docs, str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("filename=*/*.txt"))
    assert len(files) == 3 and sorted(f.parent.name for f in files)[0] == "filename=SAR_t3.txt"
    assert next(f for f in files if "t_1" in f.parent.name).read_text().rstrip("\n").split("\n") == one


def test_uncertainty_zone_in_bounds():
    assert _zone("0.3,,0.7") == (0.3, 0.7) and _zone("-1,2") == (0.0, 1.0) and _zone("0.9, 0.2 ,") == (0.2, 0.9)
    assert _zone("0.5") == _zone("1,2,3") == _zone("") == _zone("a,b") == (0.4, 0.6)
