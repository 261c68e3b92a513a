"""The driver's tables seen as transactions, alerts, feedback, registry and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentrel.config import BRANCHES, PAYMENT_METHODS
from sentrel.sources.readers import table

EPOCH = "2024-01-01 00:00:00"


def _at(minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + m.cast("bigint") * 60)


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_of(table(spark, sf_dir, "events"))


def transactions_of(e: DataFrame) -> DataFrame:
    """Also for a stream of events."""
    k = F.col("event_id")
    place = F.create_map(*[F.lit(x) for p in (("click", "Tunis"), ("view", "Sfax"), ("signup", "Sousse"), ("purchase", "Ariana")) for x in p])
    return e.select(
        k.cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(k % 97 == 0, -(F.col("value") * 50)).otherwise(F.col("value") * 50).alias("amount_tnd"),
        F.when(k % 101 == 0, None).otherwise(F.coalesce(place[F.col("event_type")], F.lit("Monastir"))).alias("governorate"),
        _pick(PAYMENT_METHODS, k % 5).alias("payment_method"),
        _pick(BRANCHES, F.floor(k / 5) % 5).alias("branch_id"),
        (F.col("value") * 50 > 10000).alias("fraud_seed"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    p = (k * 37) % 101
    return d.select(
        k.cast("string").alias("transaction_id"),
        F.concat(F.lit("user_"), (k % 50).cast("string")).alias("user_id"),
        F.col("n_chars").cast("double").alias("amount_tnd"),
        F.col("lang").alias("governorate"),
        _pick(PAYMENT_METHODS, k % 5).alias("payment_method"),
        F.when(k % 23 == 0, None).when(k % 29 == 0, "").otherwise(F.col("source")).alias("branch_id"),
        (p.cast("double") / 100).alias("ml_probability"),
        F.when(k % 10 == 0, None).when(p > 85, "high_risk").when(p < 10, "random_sample").when(p.between(40, 60), "uncertainty_sample").alias("alert_type"),
        _at(k).alias("created_at"),
    )


def timed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``timestamp``, the time as text."""
    return alerts(spark, sf_dir).withColumn("timestamp", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, k = table(spark, sf_dir, "labels"), F.col("doc_id")
    branch = F.when(k % 3 == 0, None).otherwise(F.concat(F.lit("src"), (k % 20).cast("string"))).alias("branch_id")
    first = lab.select(
        k.cast("string").alias("transaction_id"),
        F.when(F.col("toxic") == 1, "Confirmed Fraud").when(F.col("quality") == 1, "False Positive").alias("analyst_label"),
        k.alias("feedback_id"), _at(k).alias("timestamp"), branch,
    )
    again = lab.filter(k % 7 == 0).select(
        k.cast("string").alias("transaction_id"),
        F.when(F.col("toxic") == 1, "False Positive").otherwise("Confirmed Fraud").alias("analyst_label"),
        (k + 1_000_000).alias("feedback_id"), _at(k + 1440).alias("timestamp"), branch,
    )
    return first.unionByName(again)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of the documents seen as a model version: several champions, versions
    that were never promoted, importances as objects, as pairs, or unreadable."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    langs = [F.count_if(F.col("lang") == x).cast("string").alias(x) for x in ("en", "de", "fr", "es")]
    g = d.groupBy(F.coalesce("source", F.lit("none")).alias("s")).agg(F.count("*").alias("n"), F.sum((k * 37) % 101).alias("p"), F.min(k).alias("first"), F.max(k).alias("last"), *langs)
    f1 = F.col("p") / (F.col("n") * F.lit(101.0))
    item = lambda name, x: F.concat(F.lit(f'{{"feature": "{name}", "score": '), F.col(x), F.lit("}"))
    plain = F.concat(F.lit("["), item("v_count", "en"), F.lit(", "), item("g_dist", "de"), F.lit("]"))
    mixed = F.concat(F.lit('[["avg_amount", '), F.col("fr"), F.lit("], "), item("v_count", "en"), F.lit(', ["g_dist", "x"], {"feature": "custom", "score": '), F.col("es"), F.lit('.12345}, "bad"]'))
    version = F.concat(F.lit("v-"), F.col("s"))
    return g.select(
        version.alias("version_id"), F.concat(F.lit("models/"), version).alias("model_path"), f1.alias("f1_score"), ((f1 + 1) / 2).alias("auc"), (F.col("last") % 3 == 0).alias("is_champion"),
        F.when(F.col("last") % 5 != 0, _at(F.col("first"))).alias("promoted_at"), F.col("n").alias("training_samples_count"),
        F.when(F.col("first") % 4 == 0, plain).when(F.col("first") % 4 == 1, "not json").otherwise(mixed).alias("feature_importance"),
    )


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document seen as an alert that was not delivered; ``delivered``: how its next
    attempt goes (NULL: it is not sent)."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat(F.lit("txn_"), k.cast("string")).alias("transaction_id"), (k % 4).cast("int").alias("attempts"),
        _pick(("PENDING", "RETRYING", "FAILED", "SUCCESS"), F.floor(k / 4) % 4).alias("status"), _at((k * 7919) % 100_000).alias("created_at"), F.when(k % 11 != 0, k % 3 == 0).alias("delivered"),
    )
