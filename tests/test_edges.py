"""Literal edge cases of the operators."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from sentrel.config import _zone
from sentrel.operators import delivery, drift, features, metrics, ml, quality, reports, routing, scoring, store
from sentrel.schemas import ALERTS, conform
from sentrel.sources import readers, sinks
from sentrel.streaming.query import silver, start


def test_gate(spark):
    rows = [("a", None, None), ("b", -1.0, "Tunis"), ("c", 0.0, "Monastir"), (None, 1.0, "Tunis"), ("d", 0.0, "Tunis")]
    df = spark.createDataFrame(rows, "transaction_id string, amount_tnd double, governorate string")
    assert sorted(r[0] for r in quality.gate_pass(df).collect()) == ["a", "d"]
    assert quality.gate_rejects(df).count() == 3


def test_json_and_times(spark):
    lines = ['{"transaction_id": "1", "timestamp": "2024-01-01T10:00:00+00:00", "amount_tnd": "12.5"}', "not json", '{"transaction_id": "2", "timestamp": "garbage"}', None]
    got = readers.with_event_time(readers.parse_json(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert [r.amount_tnd for r in got] == [None] * 4 and [r.transaction_id for r in got] == ["1", None, "2", None]
    assert got[0].event_time is not None and got[2].event_time is None and got[1].raw_value == "not json"


def test_rules_at_their_limits(spark):
    df = spark.createDataFrame([(3, 1, 1400.0, 0), (4, 2, 1500.0, 1), (5, 1, 1500.01, 0), (6, 1, 5000.01, 1)], "v_count long, g_dist long, avg_amount double, flouci_count long")
    got = scoring.ml_features(scoring.risk_score(df)).collect()
    assert [(r.velocity_risk, r.is_smurfing, r.high_velocity_flag) for r in got] == [(0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1)]
    assert [round(r.risk_score, 3) for r in got] == [0, 0.6, 0.3, 0.7]
    d17 = quality.d17_rule(spark.createDataFrame([("Flouci", 2000.0), ("Flouci", 2000.01), (None, 9999.0)], "payment_method string, amount_tnd double")).collect()
    assert [r.d17_risk_boost for r in d17] == [0.0, 0.2, 0.0]
    p = spark.createDataFrame([("a", 0.85), ("b", 0.8501), ("c", 0.4), ("d", 0.6), ("e", 0.1), ("f", 0.0999), ("g", None)], "transaction_id string, ml_probability double")
    assert [(r[0], r.alert_type) for r in routing.review_routes(p, rate=1.0).orderBy("transaction_id").collect()] == [("b", "high_risk"), ("c", "uncertainty_sample"), ("d", "uncertainty_sample"), ("f", "random_sample")]
    assert routing.random_sample(p, rate=0.0).count() == 0 and _zone("0.7,0.2") == (0.2, 0.7) and _zone("x") == (0.4, 0.6)


def test_empty_inputs(spark):
    al = spark.createDataFrame([], ALERTS)
    fb = spark.createDataFrame([], "transaction_id string, analyst_label string, feedback_id long, timestamp timestamp, branch_id string")
    j = reports.alert_feedback_join(al, fb)
    assert metrics.threshold_sweep(j).count() == 0 and metrics.optimal_threshold(metrics.threshold_sweep(j)).first()["threshold"] == 0.85
    m = metrics.model_performance(al, fb).first()
    assert (m["estimated_fn"], m["estimated_recall"], m["f1"]) == (0, 0, 0)
    assert metrics.latency_percentiles(spark.createDataFrame([], "v double, t long"), "v", ["t"]).first()["p95"] == 0
    assert metrics.auc_rank(spark.createDataFrame([(1, 0.5)], "label int, ml_probability double")).first()["auc"] is None
    assert reports.system_stats(al, fb).first()["high_risk_precision"] == 0


def test_conform_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", None, 1)], "transaction_id string, alert_type string, extra int")
    r = conform(df, ALERTS).first()
    assert r["alert_type"] == "high_risk" and r["created_at"] is None and "extra" not in r.asDict()
    v = sinks.to_json_values(df, "transaction_id").first()
    assert v["key"] == "t" and json.loads(v["value"])["extra"] == 1
    sinks.write_silver(spark.createDataFrame([(datetime(2024, 1, 2, 3), 1)], "window_start timestamp, v int"), str(tmp_path / "s"))
    assert str(spark.read.parquet(str(tmp_path / "s")).first()["day"]) == "2024-01-02"


def test_store(spark):
    fb = spark.createDataFrame([("a", "x", 1, datetime(2024, 1, 1)), ("a", "y", 2, datetime(2024, 1, 1)), ("a", None, 3, datetime(2023, 1, 1))], "transaction_id string, analyst_label string, feedback_id long, timestamp timestamp")
    assert [(r.feedback_id, r.analyst_label) for r in store.latest_feedback(fb).collect()] == [(2, "y")]
    trail = {r.feedback_id: r for r in store.audit_trail(fb).collect()}
    assert trail[3].previous_state is None and json.loads(trail[1].previous_state) == {"analyst_label": None, "analyst_comment": None} and trail[2].previous_label == "x"
    reg = spark.createDataFrame([], "version_id string, f1_score double, is_champion boolean, promoted_at timestamp")
    assert store.promotion_decision(reg, spark.createDataFrame([("v", 0.1)], "version_id string, f1_score double")).first()["promote"]
    assert store.feedback_since_promotion(fb, reg).count() == 3


def test_drift_guards(spark):
    one = spark.createDataFrame([(1.0,)], "v double")
    zero = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    r = drift.drift_mean_std(drift.column_statistics(one), drift.column_statistics(zero)).first()
    assert (r["mean_change"], r["std_change"], r["drifted"]) == (1.0, 0.0, True)
    k = drift.ks_statistic(spark.range(500).select(F.col("id").cast("double").alias("v")), spark.range(100, 600).select(F.col("id").cast("double").alias("v")), "v").first()
    assert abs(k["ks_statistic"] - 0.2) < 1e-9 and k["p_value"] < 1e-6 and k["drifted"]


def test_pane_windows_equal_sliding_windows(spark):
    rows = [(f"t{i}", datetime(2024, 1, 1, 0, i % 13, i % 60), f"u{i % 3}", float(i), ["Tunis", "Sfax", None][i % 3], "Flouci" if i % 2 else "x") for i in range(80)] + [("n", None, "u1", 1.0, None, None)]
    df = spark.createDataFrame(rows, "transaction_id string, event_time timestamp, user_id string, amount_tnd double, governorate string, payment_method string")
    a = {tuple(r) for r in features.sliding_features(df).withColumn("avg_amount", F.round("avg_amount", 6)).collect()}
    w = df.groupBy(F.window("event_time", "5 minutes", "1 minute").alias("w"), "user_id").agg(F.count("transaction_id"), F.countDistinct("governorate"), F.round(F.avg("amount_tnd"), 6), F.sum((F.col("payment_method") == "Flouci").cast("bigint")))
    assert a == {tuple(r) for r in w.select("w.start", "w.end", "user_id", *[F.col(f"`{c}`") for c in w.columns[2:]]).collect()}


def test_stream_to_silver_and_routes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, times):
        rows = [{"transaction_id": f"{name}{i}", "timestamp": t, "user_id": "u", "amount_tnd": 6000.0, "governorate": "Tunis", "payment_method": "Flouci"} for i, t in enumerate(times)]
        (src / name).write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")

    put("a.json", ["2024-01-01T12:00:30"])
    put("b.json", ["2024-01-01T11:48:30"])  # 12 minutes late, but the watermark is a batch behind
    put("c.json", ["2024-01-01T13:00:00"])
    for i, n in enumerate("abc"):
        import os

        os.utime(src / f"{n}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    q = start(silver(readers.text_source(spark, str(src))), str(tmp_path / "silver"), str(tmp_path / "alerts"), str(tmp_path / "ck"), trigger={"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "silver" / "*")).collect()
    late = [r for r in got if r.window_start < datetime(2024, 1, 1, 11, 50)]
    assert len(late) == 5 and len(got) == 10 and all(round(r.risk_score, 2) == 0.4 and r.transaction_id.startswith("u@2024") for r in got)
    assert spark.read.parquet(str(tmp_path / "alerts" / "*")).count() == 10  # 0.4 lies in the uncertainty zone


def test_training(spark):
    rows = readers.mock_training_set(spark, 600).withColumn("transaction_id", F.monotonically_increasing_id().cast("string"))
    assert not ml.champion_challenger(rows, 5, False).trained
    first = ml.champion_challenger(rows, 5, True, trees=3)
    again = ml.champion_challenger(rows, 500, False, first.model, trees=3)
    assert first.promoted and first.f1 > 0.9 and again.trained and not again.promoted
    assert {n for n, _ in ml.importance(first.model)} == set(ml.CANDIDATES)


def test_registered_training_is_whole(spark, monkeypatch):
    from sentrel.plans import catalog

    class Stop(Exception):
        pass

    def spy(**params):
        assert params["maxIter"] == 100
        raise Stop

    monkeypatch.setattr(ml, "GBTClassifier", spy)
    with pytest.raises(Stop):
        catalog.REGISTRY["train_challenger"](spark, "/root/testdata/sf0.001")


def test_training_sees_counts_of_bins_not_rows(spark, monkeypatch):
    """The trees' input does not grow with the rows, and all rows are in it."""
    seen, real = [], ml.GBTClassifier

    class Spy:
        def __init__(self, **params):
            self.params = params

        def fit(self, df):
            seen.append(df.agg(F.count("*"), F.sum("_n")).first())
            return real(**self.params).fit(df)

    monkeypatch.setattr(ml, "GBTClassifier", Spy)
    for n in (2_000, 20_000):
        rows = spark.range(n).select(
            (F.col("id") % 7).alias("v_count"), (F.col("id") % 3).alias("g_dist"), ((F.col("id") % 200) * 10).cast("double").alias("avg_amount"),
            F.when((F.col("id") % 7 > 4) | (F.col("id") % 200 > 150), 1).otherwise(0).alias("label"),
        ).unionByName(spark.range(5).select(F.lit(1).alias("v_count"), F.lit(1).alias("g_dist"), F.lit(None).cast("double").alias("avg_amount"), F.lit(1).alias("label")))
        model = ml.train(rows, trees=3)
        got = ml.evaluate(model, rows).first()
        plain = scoring.score(rows, model).select("label", "ml_probability", F.col("ml_prediction").alias("prediction"))
        assert got == metrics.confusion_metrics(plain).crossJoin(metrics.auc_rank(plain)).first() and got.tp + got.fp + got.tn + got.fn == n and got.f1 > 0.95
        assert not [c for c in scoring.score(rows, model).columns if c.startswith("_")]
    assert [s[1] for s in seen] == [2_000, 20_000] and seen[0][0] <= seen[1][0] <= 7 * 3 * ml.BINS * 2


def test_bin_edges_are_exact(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(5.0).alias("one"), F.when(F.col("id") < 900, 0.0).otherwise(F.col("id")).cast("double").alias("heavy"))
    want = {"few": [1.0, 2.0], "many": [math.nextafter(100.0 * k - 1, math.inf) for k in range(1, 10)], "one": [5.0], "heavy": [math.nextafter(0.0, math.inf)]}
    for df in (rows, rows.repartition(7)):
        got = ml.bin_edges(df, rows.columns, 10)
        assert got == want
    assert ml.bin_edges(rows.filter("few < 0"), rows.columns, 10)["many"] == [0.0]


def test_importance_text(spark):
    from sentrel.operators.reports import parse_importance

    texts = ['[{"feature": "a", "score": "x"}, ["b", 2], ["c"], 3, {"score": 1}]', "no", None, "[]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_importance(F.col("t")).alias("p")).collect()
    assert [[(x.feature, x.score) for x in r.p] for r in got] == [[("a", None), ("b", 2.0)], [], [], []]


@pytest.mark.parametrize("n", [1, 50])
def test_synthetic_is_repeatable(spark, n):
    a, b = readers.synthetic_transactions(spark, n), readers.synthetic_transactions(spark, n).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == n


def test_delivery(spark):
    rows = [("a", 200, None, None), ("b", 503, None, "busy"), ("c", None, None, None), ("d", 200, "connection", "refused"), ("e", None, "processing", None), ("f", 500, None, None)]
    sent = spark.createDataFrame(rows, "transaction_id string, http_status int, failure string, detail string").withColumn("branch_id", F.lit("x"))
    dead = delivery.delivery_failures(sent)
    got = {r.transaction_id: (r.error_code, r.error_message) for r in dead.collect()}
    assert got == {"b": ("503", "503 - busy"), "c": ("NO_RESPONSE", "No response object returned"), "d": ("CONNECTION_ERROR", "refused"), "e": ("PROCESSING_ERROR", None), "f": ("500", "500 - ")}
    again = delivery.retry_payload(dead)
    assert "branch_id" not in again.columns and "alert_type" not in again.columns
    assert {r.transaction_id: r.sar_report for r in again.collect()}["b"] == "503 - busy"
    assert dead.filter("status = 'PENDING' AND attempts = 0").count() == 5


def test_promotion_audit(spark):
    reg = spark.createDataFrame([("v1", 0.7, True, datetime(2024, 1, 1))], "version_id string, f1_score double, is_champion boolean, promoted_at timestamp")
    new = spark.createDataFrame([("v2", 0.8, False, datetime(2024, 1, 2))], reg.schema)
    r = store.promotion_audit(reg, new).first()
    assert json.loads(r.previous_state)["version_id"] == r.previous_version == "v1" and json.loads(r.new_state) == {"version_id": "v2", "f1_score": 0.8}
    assert store.promotion_audit(reg.filter("false"), new).first().previous_state is None


def test_append_feedback(spark):
    fb = spark.createDataFrame([("a", "x", "b1")], "transaction_id string, analyst_label string, branch_id string")
    new = spark.createDataFrame([("a", "y", None), ("a", "y", None), ("zz", None, "")], fb.schema)
    al = spark.createDataFrame([("a", "b2")], "transaction_id string, branch_id string")
    assert sorted(map(tuple, store.append_feedback(fb, new, al).fillna("-").collect())) == [("a", "x", "b1"), ("a", "y", "b2"), ("a", "y", "b2"), ("zz", "-", "-")]


def test_auc_and_ks_over_many_values(spark):
    """Three runs alike and equal to rank sums, with far more scores than ranges."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    score, label = rng.random(200_000), (rng.random(200_000) < 0.3).astype(int)
    score = np.where(label == 1, score**0.5, score)
    rank = pd.Series(score).rank().to_numpy()
    p, n = label.sum(), (1 - label).sum()
    want = round((rank[label == 1].sum() - p * (p + 1) / 2) / (p * n), 6)
    df = spark.createDataFrame(pd.DataFrame({"ml_probability": score, "label": label})).repartition(6)
    assert {metrics.auc_rank(df).first()["auc"] for _ in range(3)} == {want}
    a, b = df.filter("label = 1"), df.filter("label = 0")
    x, y = np.sort(score[label == 1]), np.sort(score[label == 0])
    d = np.abs(np.searchsorted(x, score, "right") / p - np.searchsorted(y, score, "right") / n).max()
    assert {drift.ks_statistic(a, b, "ml_probability").first()["ks_statistic"] for _ in range(2)} == {round(float(d), 6)}
    assert metrics.auc_rank(df.limit(0)).first()["auc"] is None


def test_saved_model_and_reference(spark, tmp_path):
    rows = readers.mock_training_set(spark, 400)
    model = ml.train(rows, trees=3)
    ml.save(model, str(tmp_path / "champion"))
    again = ml.load(str(tmp_path / "champion"))
    want, got = (sorted(scoring.score(rows, m).select("ml_probability").collect()) for m in (model, again))
    assert want == got and ml.importance(again) == ml.importance(model)
    path = str(tmp_path / "reference")
    drift.save_reference(rows, path, "20240101", ["avg_amount"])
    drift.save_reference(rows.filter("avg_amount > 5000"), path, "20240201", ["avg_amount"])
    now = drift.column_statistics(rows, ["avg_amount"])
    assert [r.drifted for r in drift.drift_mean_std(now, drift.load_reference(spark, path)).collect()] == [True]
    assert [r.drifted for r in drift.drift_mean_std(now, drift.load_reference(spark, path, "20240101")).collect()] == [False]


def test_lookup_of_one_alert(spark):
    al = spark.createDataFrame([("a", None), ("b", "random_sample")], "transaction_id string, alert_type string")
    reg = spark.createDataFrame([("v1", True, None, "[]")], "version_id string, is_champion boolean, promoted_at timestamp, feature_importance string")
    assert [tuple(r)[:3] for r in reports.explain_alert(al, reg, "a").collect()] == [("a", "high_risk", None)]
    assert reports.explain_alert(al, reg, "zz").count() == 0
