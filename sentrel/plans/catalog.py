"""Named queries over the driver's tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrel.config import GOVERNORATES
from sentrel.operators import delivery, drift, features, metrics, ml, quality, reports, retrieval, routing, scoring, store
from sentrel.sources import adapters as ad
from sentrel.sources.readers import synthetic_from, table
from sentrel.schemas import T

SPLIT = datetime(2024, 1, 16)
EXPORT_AS_OF = datetime(2024, 1, 2)
COMPARE_AS_OF = datetime(2024, 1, 1, 12)
SAMPLE_RATE = 0.25
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    REGISTRY[f.__name__] = run
    return f


def _text(df: DataFrame, *cols: str) -> DataFrame:
    """Times as text, so engines need not agree on time types."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


def _money(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this
    machine serves if everything runs on this machine; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sentrel-")
    return f"{base.rstrip('/')}/sentrel-{uuid.uuid4().hex}"


#: The alert that is looked up by id.
ONE_ALERT = "7"


def daily(spark, d):
    return features.sliding_features(quality.gate_pass(ad.transactions(spark, d)), "1 day", "6 hours", GOVERNORATES)


@query
def ingest_parse_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("props").alias("value"))
    schema = T.StructType.fromDDL("k int")
    return e.select("event_id", F.from_json("value", schema)["k"].cast("bigint").alias("k"))


@query
def synth_transactions(spark, d):
    """One synthetic transaction per event, at the event's time."""
    out = synthetic_from(table(spark, d, "events").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts")), "event_id", "ts")
    return out.withColumn("amount_tnd", F.round("amount_tnd", 2))


@query
def quality_flags(spark, d):
    return quality.quality_flags(ad.transactions(spark, d)).select("transaction_id", *quality.FLAGS)


@query
def quality_gate_pass(spark, d):
    return _money(_text(quality.gate_pass(ad.transactions(spark, d)), "event_time"), "amount_tnd").drop(*quality.FLAGS)


@query
def quality_gate_rejects(spark, d):
    return _money(_text(quality.gate_rejects(ad.transactions(spark, d)), "event_time"), "amount_tnd").drop(*quality.FLAGS)


@query
def d17_rule(spark, d):
    return quality.d17_rule(ad.transactions(spark, d)).select("transaction_id", "d17_risk_boost")


@query
def sliding_features(spark, d):
    return _money(_text(features.sliding_features(quality.gate_pass(ad.transactions(spark, d))), "window_start", "window_end"), "avg_amount")


@query
def sliding_features_daily(spark, d):
    return _money(_text(daily(spark, d), "window_start", "window_end"), "avg_amount")


@query
def risk_score(spark, d):
    return _money(_text(scoring.risk_score(daily(spark, d)), "window_start", "window_end"), "avg_amount", "risk_score")


@query
def ml_features(spark, d):
    out = scoring.score(scoring.ml_features(scoring.risk_score(daily(spark, d))))
    return _text(out, "window_start").select("window_start", "user_id", "is_smurfing", "high_velocity_flag", "ml_prediction", F.round("ml_probability", 4).alias("ml_probability"))


@query
def rule_label(spark, d):
    return _text(scoring.rule_label(scoring.ml_features(daily(spark, d))), "window_start").select("window_start", "user_id", "label")


@query
def heuristic_label(spark, d):
    return scoring.heuristic_label(ad.alerts(spark, d)).select("transaction_id", "label")


@query
def route_high_risk(spark, d):
    return routing.high_risk(ad.alerts(spark, d)).select("transaction_id", "ml_probability")


@query
def route_random_sample(spark, d):
    return routing.random_sample(ad.alerts(spark, d), rate=SAMPLE_RATE).select("transaction_id", "ml_probability")


@query
def route_uncertainty(spark, d):
    return routing.uncertainty(ad.alerts(spark, d)).select("transaction_id", "ml_probability")


@query
def review_routes(spark, d):
    return routing.review_routes(ad.alerts(spark, d), rate=SAMPLE_RATE).select("transaction_id", "alert_type")


@query
def high_risk_topk(spark, d):
    return reports.high_risk_topk(ad.alerts(spark, d)).select("transaction_id", "user_id", "ml_probability")


@query
def review_queue(spark, d):
    return _text(reports.review_queue(ad.alerts(spark, d)), "created_at").select("transaction_id", "alert_type", "created_at")


@query
def review_mask(spark, d):
    return reports.review_mask(ad.alerts(spark, d)).select("transaction_id", "alert_type", "ml_probability")


@query
def alert_display(spark, d):
    return reports.alert_display(ad.alerts(spark, d))


@query
def risk_level(spark, d):
    return reports.risk_level(ad.alerts(spark, d))


@query
def list_branches(spark, d):
    return reports.list_branches(ad.alerts(spark, d))


@query
def alert_feedback_join(spark, d):
    return _text(reports.alert_feedback_join(ad.alerts(spark, d), ad.feedback(spark, d)), "timestamp").select("transaction_id", "ml_probability", "alert_type", "feedback_id", "analyst_label", "timestamp")


@query
def verified_label(spark, d):
    return scoring.verified_label(reports.alert_feedback_join(ad.alerts(spark, d), ad.feedback(spark, d))).select("transaction_id", "feedback_id", "label", "is_smurfing", "high_velocity_flag")


@query
def feedback_breakdown(spark, d):
    return reports.feedback_breakdown(ad.feedback(spark, d))


@query
def feedback_breakdown_by_type(spark, d):
    return reports.feedback_breakdown_by_type(ad.feedback(spark, d), ad.alerts(spark, d))


@query
def system_stats(spark, d):
    return reports.system_stats(ad.alerts(spark, d), ad.feedback(spark, d))


@query
def system_stats_branch(spark, d):
    return reports.system_stats(ad.alerts(spark, d), ad.feedback(spark, d), branch_id="src1")


@query
def feedback_breakdown_branch(spark, d):
    return reports.feedback_breakdown_by_type(ad.feedback(spark, d), ad.alerts(spark, d), "src1")


@query
def alert_export_one(spark, d):
    return _text(reports.alert_export(ad.alerts(spark, d), ad.feedback(spark, d), ONE_ALERT), "analyst_timestamp")


@query
def explain_alert(spark, d):
    return reports.explain_alert(ad.alerts(spark, d), ad.registry(spark, d), ONE_ALERT)


@query
def alert_insert_ignore_all(spark, d):
    """As alert_insert_ignore, with every alert in one input at least."""
    al, n = ad.alerts(spark, d), F.col("transaction_id").cast("bigint")
    late = al.filter(n >= 100).withColumns({"user_id": F.lit("second"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    return store.insert_ignore(al.filter(n < 300), al.filter((n >= 200) & (n < 600)).unionByName(late)).select("transaction_id", "user_id")


@query
def promote(spark, d):
    reg = ad.registry(spark, d)
    new = store.current_champion(reg).withColumn("version_id", F.lit("v-new"))
    return store.promote(reg, new).select("version_id", "is_champion", F.col("f1_score").cast("double").alias("f1_score"))


@query
def model_performance(spark, d):
    return metrics.model_performance(ad.alerts(spark, d), ad.feedback(spark, d))


@query
def model_performance_branch(spark, d):
    return metrics.model_performance(ad.alerts(spark, d), ad.feedback(spark, d), branch_id="src1")


@query
def feedback_precision(spark, d):
    return metrics.feedback_precision(ad.feedback(spark, d))


@query
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(reports.alert_feedback_join(ad.alerts(spark, d), ad.feedback(spark, d)))


@query
def optimal_threshold(spark, d):
    return metrics.optimal_threshold(threshold_sweep(spark, d))


@query
def latest_feedback(spark, d):
    return _text(store.latest_feedback(ad.feedback(spark, d)), "timestamp").select("transaction_id", "feedback_id", "analyst_label", "timestamp")


@query
def audit_trail(spark, d):
    return _text(store.audit_trail(ad.feedback(spark, d)), "timestamp").select("entity_type", "entity_id", "action", "user_id", "timestamp", "feedback_id", "previous_label", "new_label")


@query
def feedback_branch_backfill(spark, d):
    return store.feedback_branch_backfill(ad.feedback(spark, d), ad.alerts(spark, d)).select("transaction_id", "feedback_id", "branch_id")


@query
def alert_export(spark, d):
    return _text(reports.alert_export(ad.alerts(spark, d), ad.feedback(spark, d)), "analyst_timestamp")


@query
def ctaf_export(spark, d):
    return _text(reports.ctaf_export(ad.alerts(spark, d), ad.feedback(spark, d), ad.registry(spark, d), EXPORT_AS_OF, 1), "analyst_timestamp")


@query
def top_risk_factors(spark, d):
    return reports.top_risk_factors(ad.registry(spark, d))


@query
def alert_insert_ignore(spark, d):
    al, n = ad.alerts(spark, d), F.col("transaction_id").cast("bigint")
    incoming = al.filter(n % 3 != 0).withColumn("user_id", F.lit("second"))
    return store.insert_ignore(al.filter(n % 2 == 0), incoming.unionByName(incoming.withColumns({"user_id": F.lit("third"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")}))).select("transaction_id", "user_id")


@query
def dlq_retry_candidates(spark, d):
    return _text(store.dlq_candidates(ad.dead_letters(spark, d)), "created_at").select("id", "transaction_id", "attempts", "status", "created_at")


@query
def dlq_transition(spark, d):
    return store.dlq_step(ad.dead_letters(spark, d)).select("id", "attempts", "status")


@query
def current_champion(spark, d):
    return store.current_champion(ad.registry(spark, d)).select("version_id", "f1_score", "auc")


@query
def registry_promotions(spark, d):
    return store.registry_promotions(ad.registry(spark, d)).select("version_id", "is_champion")


@query
def promotion_decision(spark, d):
    reg = ad.registry(spark, d)
    return store.promotion_decision(reg, reg.filter("NOT is_champion"))


@query
def feedback_since_promotion(spark, d):
    return store.feedback_since_promotion(ad.feedback(spark, d), ad.registry(spark, d)).select("transaction_id", "feedback_id")


@query
def retrain_decision(spark, d):
    return store.retrain_decision(ad.feedback(spark, d), ad.registry(spark, d))


@query
def column_statistics(spark, d):
    out = drift.column_statistics(ad.transactions(spark, d).select("amount_tnd"))
    return out.select("column_name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


def _halves(spark, d):
    t = ad.transactions(spark, d)
    return t.filter(F.col("event_time") < F.lit(SPLIT)), t.filter(F.col("event_time") >= F.lit(SPLIT))


@query
def drift_recent_window(spark, d):
    return drift.recent_window(ad.transactions(spark, d), datetime(2024, 1, 30)).select("transaction_id")


@query
def drift_mean_std(spark, d):
    ref, cur = _halves(spark, d)
    return drift.drift_mean_std(drift.column_statistics(cur.select("amount_tnd")), drift.column_statistics(ref.select("amount_tnd")))


@query
def drift_ks_statistic(spark, d):
    a, b = _halves(spark, d)
    return drift.ks_statistic(a, b, "amount_tnd").select("ks_statistic", "n1", "n2")


@query
def drift_ks_verdict(spark, d):
    a, b = _halves(spark, d)
    return drift.ks_statistic(a, b, "amount_tnd").select(F.round("p_value", 4).alias("p_value"), "drifted")


@query
def distribution_comparison(spark, d):
    al = ad.alerts(spark, d).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp("created_at") * 60 - 59 * F.unix_timestamp(F.lit(ad.EPOCH))))
    return drift.distribution_comparison(al, "amount_tnd", COMPARE_AS_OF + (datetime(2024, 1, 31) - datetime(2024, 1, 1)))


@query
def latency_percentiles(spark, d):
    return metrics.latency_percentiles(table(spark, d, "events"), "value", ["ts", "event_id"])


def _classified(spark, d):
    return scoring.verified_label(reports.alert_feedback_join(ad.alerts(spark, d), ad.feedback(spark, d))).withColumn("prediction", F.when(F.col("ml_probability") >= 0.5, 1).otherwise(0))


@query
def confusion_metrics(spark, d):
    return metrics.confusion_metrics(_classified(spark, d))


@query
def auc_rank(spark, d):
    return metrics.auc_rank(_classified(spark, d))


@query
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.vector_topk(e, e.filter("vec_id = 0"), 4)


@query
def sar_prompt(spark, d):
    return reports.sar_prompt(ad.timed_alerts(spark, d))


@query
def sar_document(spark, d):
    return reports.sar_document(ad.timed_alerts(spark, d), EXPORT_AS_OF)


@query
def token_hash(spark, d):
    return reports.token_hash(ad.alerts(spark, d).select("transaction_id"), "transaction_id")


@query
def train_test_split(spark, d):
    return ml.split(ad.alerts(spark, d)).select("transaction_id", "split")


@query
def wallet_24h_limit(spark, d):
    return _money(features.wallet_24h_limit(ad.transactions(spark, d)), "amount_24h").select("transaction_id", "amount_24h")


@query
def stream_sliding_features(spark, d):
    """The transactions as a file stream, run to its end; closed windows only."""
    from pyspark.sql.types import StructType

    out = shared_folder(spark)
    plain = spark.read.parquet(f"{d}/events.parquet")
    schema: StructType = plain.schema
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    tx = ad.transactions_of(events)
    q = features.sliding_features_stream(quality.gate_pass(tx), places=GOVERNORATES).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return _money(_text(spark.read.parquet(f"{out}/rows"), "window_start", "window_end"), "avg_amount")


@query
def train_challenger(spark, d):
    rows = scoring.rule_label(scoring.ml_features(daily(spark, d))).withColumn("transaction_id", F.concat_ws("@", "user_id", F.col("window_start").cast("string")))
    parts = ml.split(rows).select("split", "label", *ml.CANDIDATES).persist()
    try:
        return ml.evaluate(ml.train(parts.filter("split = 'train'")), parts.filter("split = 'test'"))
    finally:
        parts.unpersist()


@query
def impossible_travel_60m(spark, d):
    return _text(features.impossible_travel_60m(ad.transactions(spark, d)), "window_start").select("window_start", "user_id", "g_dist")


@query
def system_overview(spark, d):
    return reports.system_overview(latency_percentiles(spark, d), metrics.feedback_precision(ad.feedback(spark, d)), optimal_threshold(spark, d))


@query
def alert_payload(spark, d):
    return routing.alert_payload(ad.alerts(spark, d)).select("transaction_id", "user_id", "branch_id", "timestamp", "sar_report", "amount_tnd", "ml_probability", "alert_type")


@query
def seed_corpus(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.seed_corpus(b.filter("id % 3 = 0"), b)


@query
def append_feedback(spark, d):
    fb = ad.feedback(spark, d)
    again = F.col("feedback_id") >= 1_000_000
    return store.append_feedback(fb.filter(~again), fb.filter(again), ad.alerts(spark, d)).select("transaction_id", "feedback_id", "analyst_label", "branch_id")


@query
def promotion_audit(spark, d):
    reg = ad.registry(spark, d)
    return _text(store.promotion_audit(reg, reg.filter("NOT is_champion")), "timestamp").select("entity_type", "entity_id", "action", "user_id", "timestamp", "previous_version")


def _failures(spark, d):
    k = F.col("transaction_id").cast("bigint") % 5
    return delivery.delivery_failures(ad.alerts(spark, d).withColumns({
        "http_status": F.when(k == 0, 200).when(k == 1, 503), "failure": F.when(k == 3, "connection").when(k == 4, "processing"), "detail": F.concat(F.lit("detail "), F.col("transaction_id")),
    }))


@query
def delivery_failures(spark, d):
    return _failures(spark, d).select("transaction_id", "error_code", "error_message", "attempts", "status")


@query
def retry_payload(spark, d):
    return delivery.retry_payload(_failures(spark, d)).select("transaction_id", "user_id", "amount_tnd", "governorate", "payment_method", "ml_probability", "sar_report")
