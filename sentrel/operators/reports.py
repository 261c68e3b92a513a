"""Review lists, statistics, exports, explanations and report texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sentrel.config import CONFIRMED, DEFAULTS, FALSE_POSITIVE, FEATURE_LABELS, Settings
from sentrel.operators.store import current_champion, latest_feedback


def kind() -> Column:
    return F.coalesce(F.col("alert_type"), F.lit("high_risk"))


def for_branch(df: DataFrame, branch_id: str | None, column: str = "branch_id") -> DataFrame:
    return df if branch_id is None else df.filter(F.col(column) == branch_id)


def high_risk_topk(al: DataFrame, k: int = 50, branch_id: str | None = None, s: Settings = DEFAULTS) -> DataFrame:
    rows = for_branch(al, branch_id).filter((kind() == "high_risk") & (F.col("ml_probability") > s.high_risk))
    return rows.orderBy(F.col("ml_probability").desc(), "transaction_id").limit(k)


def review_queue(al: DataFrame, k: int = 100, alert_type: str | None = None, branch_id: str | None = None) -> DataFrame:
    rows = for_branch(al, branch_id).withColumn("alert_type", kind())
    rows = rows if alert_type is None else rows.filter(F.col("alert_type") == alert_type)
    return rows.orderBy(F.col("created_at").desc(), "transaction_id").limit(k)


def review_mask(al: DataFrame, slider: float = 0.9) -> DataFrame:
    return al.filter((kind() != "high_risk") | (F.col("ml_probability") >= slider))


def alert_display(al: DataFrame) -> DataFrame:
    names = F.create_map(*map(F.lit, ("high_risk", "High Risk", "random_sample", "Random Sample", "uncertainty_sample", "Uncertain")))
    return al.select(
        F.col("transaction_id").alias("Transaction"), F.coalesce(names[kind()], F.lit("High Risk")).alias("Type"),
        F.col("user_id").alias("User"), F.format_string("%.2f", "amount_tnd").alias("Amount"), F.format_string("%.3f", "ml_probability").alias("Probability"),
    )


def risk_level(al: DataFrame) -> DataFrame:
    p = F.col("ml_probability")
    return al.select("transaction_id", "ml_probability", F.when(p > 0.9, "HIGH").when(p > 0.8, "MODERATE").otherwise("LOW").alias("risk_level"))


def list_branches(al: DataFrame) -> DataFrame:
    return al.filter(F.col("branch_id").isNotNull() & (F.col("branch_id") != "")).select("branch_id").distinct().orderBy("branch_id")


def feedback_breakdown(fb: DataFrame, branch_id: str | None = None) -> DataFrame:
    return for_branch(fb, branch_id).groupBy("analyst_label").agg(F.count("*").alias("n"))


def feedback_breakdown_by_type(fb: DataFrame, al: DataFrame, branch_id: str | None = None) -> DataFrame:
    joined = for_branch(fb, branch_id).filter(F.col("analyst_label").isNotNull()).join(al.select("transaction_id", "alert_type"), "transaction_id", "left")
    return joined.groupBy(F.coalesce("alert_type", F.lit("unknown")).alias("alert_type"), "analyst_label").agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def system_stats(al: DataFrame, fb: DataFrame, s: Settings = DEFAULTS, branch_id: str | None = None) -> DataFrame:
    """Counts over alerts and over reviewed alerts. With a branch: the alerts of the
    branch, and its reviews, whatever branch their alerts have."""
    fb = for_branch(fb, branch_id)
    a = for_branch(al, branch_id).agg(
        F.count_if((kind() == "high_risk") & (F.col("ml_probability") > s.high_risk)).alias("high_risk_alerts"),
        F.count_if(kind() == "random_sample").alias("random_samples"),
        F.count_if(kind() == "uncertainty_sample").alias("uncertainty_samples"),
        F.count("*").alias("queue_total"),
    )
    lab = F.col("analyst_label")
    joined = fb.filter(lab.isNotNull()).join(al.select("transaction_id", "alert_type"), "transaction_id")
    j = joined.agg(
        F.count_if((kind() == "high_risk") & (lab == CONFIRMED)).alias("tp"), F.count_if((kind() == "high_risk") & (lab == FALSE_POSITIVE)).alias("fp"),
        F.count_if((kind() == "random_sample") & (lab == CONFIRMED)).alias("rc"), F.count_if((kind() == "random_sample") & (lab == FALSE_POSITIVE)).alias("rf"),
    )
    f = fb.agg(F.count("*").alias("total_feedback"), F.count("analyst_label").alias("feedback_available"))
    out = a.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(j))
    return out.select(
        "total_feedback", "feedback_available", "high_risk_alerts", "random_samples", "uncertainty_samples", "queue_total",
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3).alias("high_risk_precision"), F.round(ratio(F.col("rc"), F.col("rc") + F.col("rf")), 3).alias("random_fraud_rate"),
    )


def parse_importance(text: Column) -> Column:
    """array<struct<feature, score>> from JSON objects or two-element arrays; other
    items go, unreadable JSON gives an empty list, an unreadable score NULL."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))

    def item(x: Column) -> Column:
        d, p = F.from_json(x, "feature string, score string"), F.from_json(x, "array<string>")
        pair = F.when(F.size(p) == 2, F.struct(p[0].alias("feature"), p[1].alias("score")))
        return F.when(F.trim(x).startswith("{"), F.struct(d["feature"].alias("feature"), d["score"].alias("score"))).when(F.trim(x).startswith("["), pair)

    kept = F.filter(F.transform(items, item), lambda r: r["feature"].isNotNull())
    return F.transform(kept, lambda r: F.struct(r["feature"].alias("feature"), r["score"].try_cast("double").alias("score")))


def top_risk_factors(reg: DataFrame, k: int = 3) -> DataFrame:
    """(rank, feature, description, score) of the champion; a NULL score sorts as 0,
    ties keep their order in the JSON text."""
    labels = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    rows = current_champion(reg).select(F.posexplode(parse_importance(F.col("feature_importance"))).alias("pos", "f"))
    top = rows.orderBy(F.coalesce("f.score", F.lit(0.0)).desc(), "pos").limit(k)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("f.score", F.lit(0.0))).alias("o"), "pos", "f"))).alias("a"))
    out = ordered.select(F.posexplode("a").alias("i", "x"))
    return out.select((F.col("i") + 1).alias("rank"), F.col("x.f.feature").alias("feature"), F.coalesce(labels[F.col("x.f.feature")], F.col("x.f.feature")).alias("description"), F.round("x.f.score", 4).alias("score"))


def alert_feedback_join(al: DataFrame, fb: DataFrame) -> DataFrame:
    """Labelled reviews with their alerts; an alert reviewed twice appears twice."""
    f = fb.filter(F.col("analyst_label").isNotNull()).drop("branch_id")
    return al.join(f, "transaction_id")


def one_alert(df: DataFrame, transaction_id: str) -> DataFrame:
    """Point lookup; the filter reaches the scan. No row where there is no such id."""
    return df.filter(F.col("transaction_id") == transaction_id)


def explain_alert(al: DataFrame, reg: DataFrame, transaction_id: str, k: int = 3) -> DataFrame:
    """transaction_id, alert_type and one row per leading factor of the champion; a
    single row without a factor where none are registered."""
    a = one_alert(al, transaction_id).select("transaction_id", kind().alias("alert_type"))
    return a.join(F.broadcast(top_risk_factors(reg, k)), F.lit(True), "left")


def alert_export(al: DataFrame, fb: DataFrame, transaction_id: str | None = None) -> DataFrame:
    if transaction_id is not None:
        al, fb = one_alert(al, transaction_id), one_alert(fb, transaction_id)
    last = latest_feedback(fb).select("transaction_id", "analyst_label", F.col("timestamp").alias("analyst_timestamp"))
    return al.join(last, "transaction_id", "left").select("transaction_id", "user_id", "amount_tnd", "governorate", "payment_method", "branch_id", "ml_probability", "alert_type", "analyst_label", "analyst_timestamp")


def ctaf_export(al: DataFrame, fb: DataFrame, reg: DataFrame, as_of: datetime | None = None, days: int = 7, branch_id: str | None = None) -> DataFrame:
    """Confirmed cases of the last ``days`` with the champion's factors on each."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    recent = fb.filter((F.col("analyst_label") == CONFIRMED) & (F.col("timestamp") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
    cases = for_branch(al, branch_id).join(recent.select("transaction_id", "feedback_id", "analyst_label", F.col("timestamp").alias("analyst_timestamp")), "transaction_id")
    factors = top_risk_factors(reg).agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))), lambda r: r["description"])).alias("top_risk_factors"))
    out = cases.crossJoin(F.broadcast(factors))
    return out.select("transaction_id", "user_id", "amount_tnd", "governorate", "branch_id", "ml_probability", "feedback_id", "analyst_label", "analyst_timestamp", "top_risk_factors").orderBy(F.col("analyst_timestamp").desc(), "feedback_id")


# What the labels of prompts and reports must read.
PROMPT_START = "INVESTIGATION: Analyze suspicious activity for user "
REPORT_TITLE, REPORT_BODY, UNKNOWN = "SUSPICIOUS ACTIVITY REPORT", "REPORT:", "UNKNOWN"
TRANSACTION, USER, SCORE, AMOUNT, PLACE, METHOD, TIME, CONTEXT, GENERATED = "Transaction ID: ", "User ID: ", "ML Score: ", "Amount: ", "Governorate: ", "Payment Method: ", "Timestamp: ", "Regulatory Context: ", "Generated: "
NO_CONTEXT = "No specific regulatory context found."
TASK = "Write a suspicious activity report: summary, risk factors, rules concerned, next steps."


def _line(al: DataFrame, label: str, c: str) -> Column:
    value = F.col(c).cast("string") if c in al.columns else F.lit(None).cast("string")
    return F.concat(F.lit(label), F.coalesce(value, F.lit(UNKNOWN)))


def _score() -> Column:
    return F.concat(F.lit(SCORE), F.format_string("%.2f", F.coalesce("ml_probability", F.lit(0.0))))


def _amount() -> Column:
    return F.concat(F.lit(AMOUNT), F.format_string("%.2f", F.coalesce("amount_tnd", F.lit(0.0))), F.lit(" TND"))


def sar_prompt(al: DataFrame, context: str | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """Instruction text for a report writer, one per alert. ``contexts``: what
    retrieval.alert_contexts found; the nearest text goes into its alert's prompt,
    ``context`` into those without one."""
    if contexts is None:
        own = al.withColumn("_context", F.lit(context).cast("string"))
    else:
        nearest = contexts.filter("rank = 1").select("transaction_id", F.col("context").alias("_context"))
        own = al.join(nearest, "transaction_id", "left").withColumn("_context", F.coalesce("_context", F.lit(context)))
    text = F.concat_ws(
        "\n", F.concat(F.lit(PROMPT_START), F.coalesce("user_id", F.lit(UNKNOWN)), F.lit(".")),
        _line(al, TRANSACTION, "transaction_id"), _score(), _amount(), _line(al, PLACE, "governorate"), _line(al, METHOD, "payment_method"), _line(al, TIME, "timestamp"),
        F.concat(F.lit(CONTEXT), F.coalesce("_context", F.lit(NO_CONTEXT))), F.lit(TASK),
    )
    return own.select("transaction_id", text.alias("prompt"))


def written_reports(prompts: DataFrame, writer: Callable[[str], str]) -> DataFrame:
    """(transaction_id, sar_report): what ``writer`` makes of each prompt, on the
    executors. Where it raises, the report is the error's text, as with a writer that
    cannot be reached."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(p: str) -> str:
            try:
                return writer(p)
            except Exception as e:  # the report tells
                return f"Error: {e}"

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([write(p) for p in b.column(1).to_pylist()], pa.string())], ["transaction_id", "sar_report"])

    return prompts.select("transaction_id", "prompt").mapInArrow(f, "transaction_id string, sar_report string")


def sar_document(al: DataFrame, generated: datetime | None = None) -> DataFrame:
    """File name and text of each report: the alert's fields, and its ``sar_report`` if
    there is one. ``generated``: now, if not given."""
    body = F.coalesce("sar_report", F.lit("No report generated")) if "sar_report" in al.columns else F.lit("No report generated")
    at = F.date_format(F.current_timestamp() if generated is None else F.lit(generated), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat_ws(
        "\n", F.lit(REPORT_TITLE), F.concat(F.lit(GENERATED), at), _line(al, TRANSACTION, "transaction_id"), _line(al, USER, "user_id"), _score(), _amount(),
        _line(al, PLACE, "governorate"), _line(al, METHOD, "payment_method"), _line(al, TIME, "timestamp"), F.lit(""), F.concat(F.lit(REPORT_BODY + "\n"), body),
    )
    name = F.translate(F.coalesce("transaction_id", F.lit("unknown")), ":-", "__")
    return al.select(F.concat(F.lit("SAR_"), name, F.lit(".txt")).alias("filename"), text.alias("document"))


def token_hash(df: DataFrame, column: str) -> DataFrame:
    return df.select(column, F.sha2(F.col(column), 256).alias("token_hash"))


def system_overview(performance: DataFrame, precision: DataFrame, best: DataFrame) -> DataFrame:
    """The three one-row metrics side by side."""
    p = performance.select(F.col("avg").alias("latency_avg"), F.col("p95").alias("latency_p95"), F.col("p99").alias("latency_p99"))
    return p.crossJoin(F.broadcast(precision)).crossJoin(F.broadcast(best.select(F.col("threshold").alias("optimal_threshold"))))
