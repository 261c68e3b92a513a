"""Queries that pass through stored tables and streams, with their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sentrel.config import CONFIRMED, DEFAULTS, FALSE_POSITIVE
from sentrel.operators import drift, metrics, quality, scoring, store
from sentrel.operators.features import sliding_features_stream
from sentrel.plans.catalog import SPLIT, _failures, _halves, _money, _text, daily, query, shared_folder
from sentrel.plans.oracle import FAILURES, RISK, SQL, TX, WIN_COLS, _windows, _with
from sentrel.schemas import ALERTS, LEASED
from sentrel.sources import adapters as ad, sinks
from sentrel.sources.readers import encode_json, table
from sentrel.sources.versions import Table
from sentrel.streaming.query import alert_key
from sentrel.streaming.service import Service, retry_round

NOW = datetime(2024, 6, 1)
QUANTILES = (0.25, 0.5, 0.95)
TYPES = ["click", "view", "signup", "purchase", "error"]


@query
def stored_alerts(spark, d):
    """Three batches of alerts into a stored table, each with all alerts of those before
    it; the second one runs twice."""
    t = Table(spark, f"{shared_folder(spark)}/alerts", ALERTS)
    al, part = ad.alerts(spark, d), F.col("transaction_id").cast("bigint") % 3
    for b in (0, 1, 1, 2):
        some = al.filter(part <= b).withColumn("user_id", F.concat_ws("-", F.lit(f"batch{b}"), "user_id"))
        t.append_new(lambda old, some=some: store.new_rows(old, some), "alerts", str(b))
    return t.read().select("transaction_id", "user_id", "alert_type")


@query
def dlq_rounds(spark, d):
    """Rounds over the stored failures until nothing is left to send."""
    dead = Table(spark, f"{shared_folder(spark)}/dead", LEASED)
    dead.append(_failures(spark, d).withColumn("id", F.col("transaction_id").cast("bigint")))
    arrives = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("attempts").cast("string"))), 1, 1) < "8"
    for n in range(DEFAULTS.dlq_max_attempts):
        retry_round(dead, lambda mine: mine.select("id", arrives.alias("delivered")), f"worker{n}", NOW + timedelta(minutes=n), timedelta(minutes=5))
    return dead.read().select("id", "attempts", "status", F.col("lease_owner").isNull().alias("free"))


def _lines(spark, d, which=None):
    """The transactions as JSON lines; some have no readable time, some are no JSON."""
    k, tx = F.col("transaction_id").cast("bigint"), ad.transactions(spark, d)
    tx = (tx if which is None else tx.filter(which)).withColumn("timestamp", F.when(k % 17 == 0, "soon").otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return tx.select("transaction_id", encode_json()).select(F.when(k % 13 == 0, F.concat(F.lit("line "), F.col("transaction_id"))).otherwise(F.col("value")).alias("value"))


def _service(spark, d) -> Service:
    folder = shared_folder(spark)
    _lines(spark, d).write.text(f"{folder}/lines")
    svc = Service(spark, f"{folder}/service", now=lambda: NOW)
    svc.ingest(spark.readStream.text(f"{folder}/lines"), {"availableNow": True}).awaitTermination()
    return svc


@query
def stream_quarantine(spark, d):
    """Each line of a stream: an event, or a reject and why."""
    svc = _service(spark, d)
    events, rejects = spark.read.parquet(f"{svc.path}/events/batch=*"), spark.read.parquet(f"{svc.path}/rejects/batch=*")
    key = F.coalesce(F.get_json_object("raw_value", "$.transaction_id"), F.col("raw_value"))
    return events.select(F.col("transaction_id").alias("line"), F.lit(None).cast("string").alias("reason")).unionByName(rejects.select(key.alias("line"), "reason"))


@query
def stream_service(spark, d):
    """Lines to events, windows, silver rows and stored alerts."""
    svc = _service(spark, d)
    svc.score(trigger={"availableNow": True}).awaitTermination()
    return svc["alerts"].read().select("transaction_id", "alert_type", F.round("ml_probability", 4).alias("ml_probability"))


@query
def exact_quantiles_by_type(spark, d):
    out = metrics.exact_quantiles(table(spark, d, "events"), "value", "event_type", TYPES, QUANTILES)
    return out.select("event_type", "q", F.round("quantile", 6).alias("quantile"), "n")


@query
def latency_sketch_percentiles(spark, d):
    """Percentiles of all values, from sketches of three parts put together."""
    e = table(spark, d, "events")
    known = F.col("event_type").isin(*TYPES[:2])
    parts = [metrics.latency_sketch(e.filter(x), "value") for x in (known, ~known, known.isNull())]
    return metrics.sketch_percentiles(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("q", F.round("value", 6).alias("value"), "n")


@query
def stream_restart(spark, d):
    """As stream_service, but both streams are started twice on one checkpoint: the
    second half of the lines comes when the first has been worked off."""
    folder = shared_folder(spark)
    svc = Service(spark, f"{folder}/service", now=lambda: NOW)
    for early in (True, False):
        _lines(spark, d, (F.col("event_time") < F.lit(SPLIT)) == early).write.mode("append").text(f"{folder}/lines")
        svc.ingest(spark.readStream.text(f"{folder}/lines"), {"availableNow": True}).awaitTermination()
        svc.score(trigger={"availableNow": True}).awaitTermination()
    return svc["alerts"].read().select("transaction_id", "alert_type", F.round("ml_probability", 4).alias("ml_probability"))


@query
def stream_late_events(spark, d):
    """Windows of a stream that sees the second half of the events first: when the first
    half comes, its windows are closed, and its events change nothing."""
    folder, tx = shared_folder(spark), quality.gate_pass(ad.transactions(spark, d))
    for late in (False, True):
        tx.filter((F.col("event_time") < F.lit(SPLIT)) == late).write.mode("append").parquet(f"{folder}/events")
        q = sliding_features_stream(spark.readStream.schema(tx.schema).parquet(f"{folder}/events")).writeStream.outputMode("append").format("parquet")
        q.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return _money(_text(spark.read.parquet(f"{folder}/rows"), "window_start", "window_end"), "avg_amount")


@query
def retrain_by_feedback(spark, d):
    """Silver rows and a verdict on each start one training; the batch runs twice, and
    the next one finds no new verdicts. The model is small: its scores are not shown."""
    svc = Service(spark, f"{shared_folder(spark)}/service", trees=2, now=lambda: NOW)
    silver = scoring.score(scoring.ml_features(scoring.risk_score(daily(spark, d)))).withColumn("transaction_id", alert_key())
    sinks.write_silver_batch(silver, f"{svc.path}/silver", 0)
    verdict = F.when(F.col("label") == 1, CONFIRMED).otherwise(FALSE_POSITIVE)
    written = spark.read.parquet(f"{svc.path}/silver")  # windows are not built again
    svc["feedback"].append(scoring.rule_label(written).select("transaction_id", verdict.alias("analyst_label"), F.xxhash64("transaction_id").alias("feedback_id"), F.lit(datetime(2024, 5, 1)).alias("timestamp")))
    for batch in (1, 1, 2):
        svc.retrain(batch)
    logged = svc["audit"].read().groupBy(F.col("entity_id").alias("version_id"), "action").agg(F.count("*").alias("audit_rows"), F.count("previous_state").alias("replaced"))
    return svc["registry"].read().join(logged, "version_id", "left").select("version_id", "is_champion", "training_samples_count", "action", "audit_rows", "replaced")


@query
def json_export(spark, d):
    """Alerts as JSON lines, read again."""
    path = f"{shared_folder(spark)}/json"
    al = ad.timed_alerts(spark, d).select("transaction_id", "user_id", "amount_tnd", "branch_id", "ml_probability", "alert_type", "timestamp")
    sinks.write_json(al, path)
    return spark.read.schema(al.schema).json(path)


@query
def drift_by_saved_reference(spark, d):
    """Statistics of the first half saved as two versions; the second half against the
    last one."""
    path, (early, late) = f"{shared_folder(spark)}/reference", _halves(spark, d)
    drift.save_reference(late, path, "v1", ["amount_tnd"])
    drift.save_reference(early, path, "v2", ["amount_tnd"])
    return drift.drift_mean_std(drift.column_statistics(late.select("amount_tnd")), drift.load_reference(spark, path))


SQL["stored_alerts"] = _with("SELECT transaction_id, 'batch' || (CAST(transaction_id AS BIGINT) % 3) || '-' || user_id AS user_id, coalesce(alert_type, 'high_risk') AS alert_type FROM alerts", "alerts")
SQL["dlq_rounds"] = _with(f"""SELECT id, CAST(coalesce(first, 3) AS INT) AS attempts, CASE WHEN first IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status, true AS free FROM (
    SELECT CAST(transaction_id AS BIGINT) AS id, list_min(list_filter([1, 2, 3], lambda a: substr(md5(transaction_id || ':' || a), 1, 1) < '8')) AS first FROM ({FAILURES}))""", "alerts")
BAD = "CASE WHEN CAST(transaction_id AS BIGINT) % 13 = 0 THEN 'json' WHEN CAST(transaction_id AS BIGINT) % 17 = 0 THEN 'time' WHEN negative_amount_flag THEN 'amount' WHEN invalid_governorate_flag THEN 'governorate' END"
SQL["stream_quarantine"] = _with(f"SELECT CASE WHEN CAST(transaction_id AS BIGINT) % 13 = 0 THEN 'line ' || transaction_id ELSE transaction_id END AS line, {BAD} AS reason FROM flags", "transactions", "flags")
SQL["stream_service"] = _with(f""", readable AS (SELECT * FROM flags WHERE {BAD} IS NULL), win AS ({_windows(300, 60, 'readable')}),
risk AS (SELECT *, CASE WHEN v_count > 3 THEN 1.0::DOUBLE ELSE 0.0 END AS velocity_risk, CASE WHEN g_dist > 1 THEN 1.0::DOUBLE ELSE 0.0 END AS travel_risk, CASE WHEN avg_amount > 5000 THEN 1.0::DOUBLE ELSE 0.0 END AS high_value_risk,
    CASE WHEN avg_amount > 2000 AND flouci_count > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS d17_risk FROM win WHERE window_end <= (SELECT epoch(max(event_time)) - 600 FROM readable)),
named AS (SELECT user_id || '@' || strftime(to_timestamp(window_start) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS transaction_id, {RISK} AS p FROM risk)
SELECT * FROM (SELECT transaction_id, CASE WHEN p > 0.85 THEN 'high_risk' WHEN p BETWEEN 0.4 AND 0.6 THEN 'uncertainty_sample' WHEN p < 0.1 AND substr(md5(transaction_id), 1, 4) < '028f' THEN 'random_sample' END AS alert_type, p AS ml_probability FROM named) WHERE alert_type IS NOT NULL""", "transactions", "flags")
SQL["exact_quantiles_by_type"] = f"""SELECT event_type, q, round(quantile, 6) AS quantile, n FROM (SELECT event_type, unnest([{', '.join(f'{q}::DOUBLE' for q in QUANTILES)}]) AS q, unnest(quantile_cont(value, [{', '.join(map(str, QUANTILES))}])) AS quantile, count(value) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type HAVING n > 0)"""
SQL["latency_sketch_percentiles"] = f"""WITH b AS (SELECT CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {metrics.log_base()!r}::DOUBLE) AS INT) END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket NULLS FIRST) AS cum, sum(n) OVER () AS total FROM b)
SELECT q, round(coalesce(2 * pow({metrics.gamma()!r}::DOUBLE, bucket) / ({metrics.gamma()!r}::DOUBLE + 1), 0), 6) AS value, CAST(total AS BIGINT) AS n FROM c, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q) WHERE cum > floor(q * (total - 1)) QUALIFY row_number() OVER (PARTITION BY q ORDER BY cum) = 1"""
SQL["stream_restart"] = SQL["stream_service"]
SQL["retrain_by_feedback"] = _with("SELECT 'v00000001' AS version_id, true AS is_champion, count(*) AS training_samples_count, 'PROMOTE' AS action, CAST(1 AS BIGINT) AS audit_rows, CAST(0 AS BIGINT) AS replaced FROM daily", *TX, "daily")
SQL["json_export"] = _with("SELECT transaction_id, user_id, amount_tnd, branch_id, ml_probability, alert_type, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM alerts", "alerts")
SQL["drift_by_saved_reference"] = SQL["drift_mean_std"]
SQL["stream_late_events"] = _with(f", early AS (SELECT * FROM good WHERE event_time >= TIMESTAMP '2024-01-16 00:00:00') SELECT {WIN_COLS} FROM ({_windows(300, 60, 'early')}) WHERE window_end <= (SELECT epoch(max(event_time)) - 600 FROM early)", *TX)
