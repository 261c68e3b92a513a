"""Stored tables, streams that run again, promotions, leases, percentiles."""

import json
import os
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from sentrel.config import DEFAULTS
from sentrel.operators import metrics, store
from sentrel.schemas import ALERTS, LEASED, REGISTRY, _ddl
from sentrel.sources import readers, sinks
from sentrel.sources.versions import Conflict, Table
from sentrel.streaming.service import Service, retry_round

NOW = datetime(2024, 1, 2)
AB = _ddl("a bigint, b string")


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), AB)
    assert rows(t) == [] and t.versions() == []
    t.append(spark.range(2).selectExpr("id a", "'x' b", "1 other"))
    t.append(spark.range(1).selectExpr("id + 5 a"), "s", "1")
    t.append(spark.range(9).selectExpr("id a"), "s", "1")  # the same batch again
    t.append(spark.range(9).selectExpr("id a"), "s", "0")  # one before it
    assert rows(t) == [(0, "x"), (1, "x"), (5, None)]
    t.rewrite(lambda old: old.filter("a > 0").withColumn("a", F.col("a") * 10))
    assert sorted(r.a for r in t.read().collect()) == [10, 50] and sorted(r.a for r in t.read(1).collect()) == [0, 1]
    assert t.versions() == [1, 2, 3] and t.number_of("s", "1") == 2 and t.number_of("s", "7") == 0
    with pytest.raises(ValueError):
        t.read(9)
    assert len(t.vacuum(keep=1)) == 2 and sorted(r.a for r in t.compact() and t.read().collect()) == [10, 50]


def test_two_writers(spark, tmp_path):
    """The second commits while the first is at work; the first starts over."""
    t, other = (Table(spark, str(tmp_path / "t"), ALERTS) for _ in range(2))
    new = lambda name: spark.createDataFrame([("t1", name), (f"t-{name}", name)], "transaction_id string, user_id string")
    calls = []

    def make(old):
        calls.append(old.count())
        if len(calls) == 1:
            other.append_new(lambda o: store.new_rows(o, new("second").withColumn("created_at", F.lit(NOW))))
        return store.new_rows(old, new("first").withColumn("created_at", F.lit(NOW)))

    t.append_new(make)
    assert calls == [0, 2] and sorted((r.transaction_id, r.user_id) for r in t.read().collect()) == [("t-first", "first"), ("t-second", "second"), ("t1", "second")]
    with pytest.raises(Conflict):
        t._change(lambda old: other.append(new("x")) and new("y"), True, "", "", tries=2)


def test_writers_side_by_side(spark, tmp_path):
    """All commits are there, each in a version of its own."""
    def write(k):
        t = Table(spark, str(tmp_path / "t"), AB)
        for i in range(4):
            t.append(spark.range(1).selectExpr(f"{10 * k + i}L a"), f"writer{k}", str(i))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    t = Table(spark, str(tmp_path / "t"), AB)
    assert sorted(r.a for r in t.read().collect()) == [10 * k + i for k in range(4) for i in range(4)]
    assert t.versions() == list(range(1, 17)) and len(list((tmp_path / "t").glob("data-*"))) == 16 and set(t.version().batches.values()) == {"3"}


def test_killed_write(spark, tmp_path, monkeypatch):
    """Rows written but not committed are not there, and do not hinder the next writer."""
    t = Table(spark, str(tmp_path / "t"), AB)
    t.append(spark.range(1).selectExpr("id a"))

    def killed(_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            t.append(spark.range(7).selectExpr("id a"))
    assert t.read().count() == 1 and len(list((tmp_path / "t").glob("data-*"))) == 2
    t.append(spark.range(2).selectExpr("id a"))
    assert t.read().count() == 3 and len(t.vacuum()) == 1


def test_silver_by_day(spark, tmp_path):
    path = str(tmp_path / "silver")
    batch = spark.createDataFrame([(datetime(2024, 1, d), d) for d in (1, 1, 2, 3)], "window_start timestamp, v int")
    for _ in range(2):
        sinks.write_silver_batch(batch, path, 4)
    sinks.write_silver_batch(batch.filter("v = 3"), path, 5)
    got = spark.read.parquet(path)
    assert sorted((r.v, r.batch) for r in got.collect()) == [(1, 4), (1, 4), (2, 4), (3, 4), (3, 5)]
    recent = got.filter("day >= date'2024-01-03'")
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString() and recent.count() == 2


class Constant:
    """Stands in for a model: gives every row one probability."""

    def __init__(self, p):
        self.p = p

    def transform(self, df):
        return df.withColumns({"features": F.lit(0), "rawPrediction": F.lit(0), "prediction": F.lit(1.0), "probability": array_to_vector(F.array(F.lit(1 - self.p), F.lit(self.p)))})


def put(folder, name, at, events):
    lines = [json.dumps({"transaction_id": f"{name}{i}", "timestamp": t, "user_id": u, "amount_tnd": a, "governorate": g, "payment_method": "Flouci"}) for i, (t, u, a, g) in enumerate(events)]
    (folder / name).write_text("\n".join([*lines, "not json", '{"amount_tnd": 3}', ""]))
    os.utime(folder / name, (1_700_000_000 + at, 1_700_000_000 + at))


def test_stream_of_two_promotions(spark, tmp_path):
    """Lines to events and rejects; a promotion between two batches changes the scores;
    batches that run again change nothing."""
    src = tmp_path / "in"
    src.mkdir()
    svc = Service(spark, str(tmp_path / "svc"), replace(DEFAULTS, retrain_feedback=10**9), load=lambda path: Constant(float(path)), now=lambda: NOW)
    reg = lambda v, p: spark.createDataFrame([(v, p, 0.5, 0.5, True, datetime(2024, 1, int(v[1:])), 1, "[]")], REGISTRY)

    def run():
        for q in (svc.ingest(readers.text_source(spark, str(src)), {"availableNow": True}), svc.score(trigger={"availableNow": True})):
            q.awaitTermination()
            assert q.exception() is None

    put(src, "a", 0, [("2024-01-01T12:00:30", "u", 6000.0, "Tunis"), ("2024-01-01T12:01:00", "v", -1.0, "Tunis"), ("2024-01-01T12:01:00", "v", 1.0, "Atlantis"), ("garbage", "w", 1.0, "Tunis")])
    run()
    svc["registry"].rewrite(lambda old: store.promote(old, reg("v1", "0.9")))
    put(src, "b", 1, [("2024-01-01T15:00:30", "u", 6000.0, "Tunis")])
    run()
    put(src, "c", 2, [("2024-01-01T18:00:30", "u", 6000.0, "Tunis")])
    run()
    svc["registry"].rewrite(lambda old: store.promote(old, reg("v2", "0.95")))
    put(src, "d", 3, [("2024-01-02T18:00:30", "u", 6000.0, "Tunis")])
    run()
    events, rejects = spark.read.parquet(f"{svc.path}/events/*"), spark.read.parquet(f"{svc.path}/rejects/*")
    assert sorted(r.reason for r in rejects.collect()) == ["amount", "governorate", *["id"] * 4, *["json"] * 4, "time"]
    assert events.count() + rejects.count() == sum(len((src / n).read_text().split("\n")) - 1 for n in "abcd")  # the last line is empty
    silver = spark.read.parquet(f"{svc.path}/silver")
    by = {(r.window_start.hour, r.model_version, round(r.ml_probability, 2)) for r in silver.collect()}
    assert {x[1:] for x in by} == {("v1", 0.9), ("v2", 0.95)}
    before = rows_of(silver), rows_of(svc["alerts"].read()), rows_of(svc.latency())
    assert len(before[1]) == svc["alerts"].read().select("transaction_id").distinct().count() > 5 and svc.latency().first().n == silver.count()
    for n in sorted({r.batch for r in silver.select("batch").distinct().collect()}):  # every batch again, by the champion of its time
        batch = silver.filter(F.col("batch") == n)
        svc._champion = (batch.first().model_version, Constant(batch.first().ml_probability))
        svc.champion = lambda: svc._champion
        unscored = batch.drop("day", "batch", "model_version", "transaction_id", "ml_prediction", "ml_probability", "score_source")
        svc.process(spark.createDataFrame(unscored.collect(), unscored.schema), n)
    assert (rows_of(spark.read.parquet(f"{svc.path}/silver")), rows_of(svc["alerts"].read()), rows_of(svc.latency())) == before
    for n in range(4):  # events of a batch that is whole are left alone
        files = sorted(p.name for p in (tmp_path / "svc" / "events" / f"batch={n}").iterdir())
        svc.write_events(spark.createDataFrame([], "reason string"), n)
        assert files == sorted(p.name for p in (tmp_path / "svc" / "events" / f"batch={n}").iterdir())


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_broken_champion(spark, tmp_path):
    svc = Service(spark, str(tmp_path / "s"))
    assert svc.champion() == (None, None)
    svc["registry"].append(spark.createDataFrame([("v1", "/nowhere", 0.5, 0.5, True, NOW, 1, "[]")], REGISTRY))
    assert svc.champion() == (None, None)


def test_one_retraining_for_a_batch(spark, tmp_path, monkeypatch):
    """Enough labels start one training; run again, also after a stop between registry
    and audit, the batch adds nothing twice."""
    clock = iter(datetime(2024, 3, d) for d in range(1, 28))
    svc = Service(spark, str(tmp_path / "s"), replace(DEFAULTS, retrain_feedback=40, retrain_min_feedback=40), trees=2, now=lambda: next(clock))
    made = readers.mock_training_set(spark, 200).withColumns({"transaction_id": F.concat(F.lit("t"), F.monotonically_increasing_id()), "window_start": F.lit(NOW)})
    sinks.write_silver_batch(made.drop("label"), f"{svc.path}/silver", 0)
    assert not svc.retrain(0) and svc["registry"].versions() == []
    fb = made.select("transaction_id", F.when(F.col("label") == 1, "Confirmed Fraud").otherwise("False Positive").alias("analyst_label"), F.monotonically_increasing_id().alias("feedback_id"), F.lit(NOW).alias("timestamp"))
    svc["feedback"].append(fb)

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(svc["audit"], "append", stopped)
        with pytest.raises(KeyboardInterrupt):
            svc.retrain(7)
    assert svc["registry"].read().count() == 1 and svc["audit"].read().count() == 0
    for _ in range(2):
        assert svc.retrain(7)
    reg, audit = svc["registry"].read().collect(), svc["audit"].read().collect()
    assert [(r.version_id, r.is_champion) for r in reg] == [("v00000007", True)] and reg[0].f1_score > 0.8 and reg[0].training_samples_count == 200
    assert [(a.entity_id, a.action, a.previous_state) for a in audit] == [("v00000007", "PROMOTE", None)]
    assert json.loads(reg[0].feature_importance)[0]["score"] > 0 and svc.champion()[0] == "v00000007"
    assert not svc.retrain(8)  # no label since the promotion
    svc["feedback"].append(fb.limit(50).withColumn("timestamp", F.lit(datetime(2024, 4, 1))))
    assert not svc.retrain(9) and not svc.retrain(9) and not svc.retrain(10)  # no better, and not tried again with the same labels
    assert sorted((r.version_id, r.is_champion) for r in svc["registry"].read().collect()) == [("v00000007", True), ("v00000009", False)] and svc["audit"].read().count() == 1


def test_leases(spark, tmp_path):
    dead = Table(spark, str(tmp_path / "d"), LEASED)
    dead.append(spark.createDataFrame([(i, f"t{i}", "PENDING", 0) for i in range(6)] + [(6, "t6", "FAILED", 3), (7, "t7", None, None)], "id long, transaction_id string, status string, attempts int"))
    sent = []

    def worker(name, ok, inner=None):
        def deliver(mine):
            if inner:
                inner()
            sent.extend((name, r.id) for r in mine.collect())
            return mine.select("id", F.lit(ok).alias("delivered")).filter("id <> 5")  # 5 never comes back

        return deliver

    five = timedelta(minutes=5)
    at = lambda m: NOW + timedelta(minutes=m)
    got = []
    n = retry_round(dead, worker("a", False, lambda: got.append(retry_round(dead, worker("b", True), "b", at(1), five))), "a", at(0), five)
    assert n == 7 and got == [0] and not [s for s in sent if s[0] == "b"]  # 7: a row without a status is PENDING
    state = lambda: {r.id: (r.status, r.attempts, r.lease_owner) for r in dead.read().collect()}
    assert state()[0] == ("PENDING", 1, None) and state()[5] == ("RETRYING", 1, "a") and state()[6] == ("FAILED", 3, None)
    assert retry_round(dead, worker("b", True), "b", at(2), five) == 6 and state()[0] == ("SUCCESS", 2, None) and state()[5][2] == "a"
    assert retry_round(dead, worker("b", True), "b", at(20), five) == 1 and state()[5] == ("RETRYING", 2, "b")
    dead.rewrite(lambda t: store.dlq_settle(t, spark.createDataFrame([(5, True)], "id long, delivered boolean"), "a"))  # a comes late
    assert state()[5] == ("RETRYING", 2, "b")
    assert retry_round(dead, worker("c", False), "c", at(40), five) == 1 and retry_round(dead, worker("c", False), "c", at(60), five) == 0 and state()[5][:2] == ("FAILED", 3)


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_quantiles(spark, parts):
    r = random.Random(parts)
    data = [(r.choice(["a", "b", "other", None]), r.choice([None, 1.5, 2.0, r.gauss(0, 9), -0.0])) for _ in range(700)] + [("c", 4.0), ("d", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(x.g, x.q): (x["quantile"], x.n) for x in metrics.exact_quantiles(spark.createDataFrame(data, "g string, v double"), "v", "g", ["a", "b", "c", "d"], (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    con = duckdb.connect()
    for g in "abc":
        own = [v for k, v in data if k == g and v is not None]
        for q in (0.0, 0.25, 0.5, 0.99, 1.0):
            want = con.execute("SELECT quantile_cont(v, ?) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [q, own]).fetchone()[0]
            assert got[g, q][0] == pytest.approx(want, abs=1e-12) and got[g, q][1] == len(own)
    assert len(got) == 15


def test_sketch_of_parts(spark):
    values = [float(x) for x in np.random.default_rng(1).lognormal(5, 2, 5000)] + [0.0, -3.0]
    parts = [spark.createDataFrame([(v,) for v in values[i::3]] + [(None,)], "v double") for i in range(3)]
    sketches = [metrics.latency_sketch(p, "v") for p in parts]
    whole = metrics.sketch_percentiles(sketches[0].unionByName(sketches[1]).unionByName(sketches[2])).collect()
    for r in whole:
        exact = sorted(values)[int(r.q * (len(values) - 1))]
        assert abs(r.value - exact) <= metrics.SKETCH_ERROR * exact and r.n == len(values)
    assert sorted(map(tuple, metrics.sketch_percentiles(metrics.latency_sketch(spark.createDataFrame([(v,) for v in values], "v double"), "v")).collect())) == sorted(map(tuple, whole))
    assert metrics.sketch_percentiles(sketches[0].limit(0)).count() == 0


def test_verdicts_and_their_audit(spark, tmp_path, monkeypatch):
    svc = Service(spark, str(tmp_path / "s"), now=lambda: NOW)
    al = spark.createDataFrame([("t1", "b1", NOW), ("t2", "", NOW), ("t1", "later", NOW + timedelta(days=1)), (None, "x", NOW)], "transaction_id string, branch_id string, created_at timestamp")
    svc.add_alerts(al, "api", "1")
    svc.add_alerts(al.withColumn("branch_id", F.lit("other")), "api", "2")
    assert sorted((r.transaction_id, r.branch_id, r.alert_type) for r in svc["alerts"].read().collect()) == [("t1", "b1", "high_risk"), ("t2", "", "high_risk")]
    said = lambda *rows: spark.createDataFrame([(*r, "ann") for r in rows], "transaction_id string, analyst_label string, timestamp timestamp, user_id string")
    first = said(("t1", "False Positive", NOW), ("t9", "Confirmed Fraud", NOW))
    with monkeypatch.context() as m:  # stopped between the two tables
        m.setattr(svc["audit"], "append", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            svc.add_feedback(first, "api", "1")
    for _ in range(2):
        svc.add_feedback(first, "api", "1")
    svc.add_feedback(said(("t1", "Confirmed Fraud", NOW + timedelta(hours=1)), ("t1", None, NOW + timedelta(hours=2))).drop("user_id"), "api", "2")
    assert sorted((r.transaction_id, r.analyst_label or "-", r.branch_id) for r in svc["feedback"].read().collect()) == [("t1", "-", "b1"), ("t1", "Confirmed Fraud", "b1"), ("t1", "False Positive", "b1"), ("t9", "Confirmed Fraud", None)]
    label = lambda state: state and json.loads(state)["analyst_label"]
    log = sorted((a.timestamp, a.entity_id, a.user_id, label(a.previous_state), label(a.new_state)) for a in svc["audit"].read().collect())
    assert log == [(NOW, "t1", "ann", None, "False Positive"), (NOW, "t9", "ann", None, "Confirmed Fraud"), (NOW + timedelta(hours=1), "t1", "unknown", "False Positive", "Confirmed Fraud"), (NOW + timedelta(hours=2), "t1", "unknown", "Confirmed Fraud", None)]


def test_failures_until_sent(spark, tmp_path, capfd):
    """What was not delivered is stored once, and sent by a clock until it arrives."""
    svc = Service(spark, str(tmp_path / "s"), now=lambda: NOW)
    sent = spark.createDataFrame([("a", 200, None), ("b", 503, "busy"), ("c", None, None)], "transaction_id string, http_status int, detail string").withColumns({"failure": F.lit(None).cast("string"), **{c: F.lit(None).cast("string") for c in ("user_id", "governorate", "payment_method", "timestamp")}, "amount_tnd": F.lit(1.0), "ml_probability": F.lit(0.9)})
    for _ in range(2):
        svc.failed(sent, "sender", "1")
    assert sorted((r.transaction_id, r.error_code, r.status) for r in svc["dead_letters"].read().collect()) == [("b", "503", "PENDING"), ("c", "NO_RESPONSE", "PENDING")]
    q = svc.keep_retrying(lambda mine: mine.select("id", (F.col("attempts") > 1).alias("delivered")), "w", "1 second")
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if {r.status for r in svc["dead_letters"].read().collect()} == {"SUCCESS"}:
                break
    finally:
        q.stop()
    assert [(r.status, r.attempts) for r in svc["dead_letters"].read().collect()] == [("SUCCESS", 2)] * 2
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a", 0, [("2024-01-01T12:00:30", "u", 6000.0, "Tunis")])
    shown = svc.show(readers.text_source(spark, str(src)), trigger={"availableNow": True})
    shown.awaitTermination()
    assert shown.exception() is None
