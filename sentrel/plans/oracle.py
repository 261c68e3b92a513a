"""DuckDB SQL for the catalogue's queries, written against the raw tables."""

from __future__ import annotations

from sentrel.config import BRANCHES, GOVERNORATES, PAYMENT_METHODS

T0 = "TIMESTAMP '2024-01-01 00:00:00'"
FMT = "'%Y-%m-%d %H:%M:%S'"
METHOD = "CASE {k} % 5 WHEN 0 THEN 'eDinar' WHEN 1 THEN 'Flouci' WHEN 2 THEN 'Konnect' WHEN 3 THEN 'Carte Bancaire' ELSE 'Cash on Delivery' END"


CTES = {
    "transactions": f"""SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts AS event_time, 'USER_' || user_id AS user_id,
        CASE WHEN event_id % 97 = 0 THEN -(value*50) ELSE value*50 END AS amount_tnd,
        CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_type='click' THEN 'Tunis' WHEN event_type='view' THEN 'Sfax' WHEN event_type='signup' THEN 'Sousse' WHEN event_type='purchase' THEN 'Ariana' ELSE 'Monastir' END AS governorate,
        {METHOD.format(k="event_id")} AS payment_method,
        CASE CAST(floor(event_id/5) AS BIGINT) % 5 WHEN 0 THEN 'Tunis-GNC' WHEN 1 THEN 'Sfax-Agency' WHEN 2 THEN 'Sousse-Agency' WHEN 3 THEN 'Ariana-Desk' ELSE 'Bizerte-Unit' END AS branch_id,
        value*50 > 10000 AS fraud_seed FROM events""",
    "flags": """SELECT *, coalesce(amount_tnd < 0, false) AS negative_amount_flag,
        coalesce(governorate NOT IN ('Tunis','Sfax','Sousse','Ariana','Bizerte','Gabes','Kairouan'), false) AS invalid_governorate_flag,
        transaction_id IS NULL AS null_id_flag FROM transactions""",
    "good": "SELECT * FROM flags WHERE NOT (negative_amount_flag OR invalid_governorate_flag OR null_id_flag)",
    "alerts": f"""SELECT CAST(doc_id AS VARCHAR) AS transaction_id, 'user_' || (doc_id % 50) AS user_id, CAST(n_chars AS DOUBLE) AS amount_tnd, lang AS governorate,
        {METHOD.format(k="doc_id")} AS payment_method,
        CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN '' ELSE source END AS branch_id,
        CAST((doc_id*37) % 101 AS DOUBLE)/100 AS ml_probability,
        CASE WHEN doc_id % 10 = 0 THEN NULL WHEN (doc_id*37) % 101 > 85 THEN 'high_risk' WHEN (doc_id*37) % 101 < 10 THEN 'random_sample' WHEN (doc_id*37) % 101 BETWEEN 40 AND 60 THEN 'uncertainty_sample' ELSE NULL END AS alert_type,
        {T0} + to_minutes(CAST(doc_id AS INT)) AS created_at FROM documents""",
    "feedback": f"""SELECT CAST(doc_id AS VARCHAR) AS transaction_id, CASE WHEN toxic=1 THEN 'Confirmed Fraud' WHEN quality=1 THEN 'False Positive' ELSE NULL END AS analyst_label,
        doc_id AS feedback_id, {T0} + to_minutes(CAST(doc_id AS INT)) AS timestamp, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src' || (doc_id % 20) END AS branch_id FROM labels
        UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN toxic=1 THEN 'False Positive' ELSE 'Confirmed Fraud' END, doc_id + 1000000, {T0} + to_minutes(CAST(doc_id + 1440 AS INT)),
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src' || (doc_id % 20) END FROM labels WHERE doc_id % 7 = 0""",
    "registry": f"""SELECT 'v-' || s AS version_id, 'models/v-' || s AS model_path, CAST(p AS DOUBLE) / (n * 101.0::DOUBLE) AS f1_score, (CAST(p AS DOUBLE) / (n * 101.0::DOUBLE) + 1) / 2 AS auc, last % 3 = 0 AS is_champion,
        CASE WHEN last % 5 <> 0 THEN {T0} + to_minutes(CAST(first AS INT)) END AS promoted_at, n AS training_samples_count,
        CASE first % 4 WHEN 0 THEN '[{{"feature": "v_count", "score": ' || en || '}}, {{"feature": "g_dist", "score": ' || de || '}}]' WHEN 1 THEN 'not json'
        ELSE '[["avg_amount", ' || fr || '], {{"feature": "v_count", "score": ' || en || '}}, ["g_dist", "x"], {{"feature": "custom", "score": ' || es || '.12345}}, "bad"]' END AS feature_importance
        FROM (SELECT coalesce(source, 'none') AS s, count(*) AS n, sum((doc_id * 37) % 101) AS p, min(doc_id) AS first, max(doc_id) AS last,
        count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY 1)""",
    "champion": "SELECT * FROM registry WHERE is_champion ORDER BY promoted_at DESC NULLS LAST, version_id DESC LIMIT 1",
    "dead": f"""SELECT doc_id AS id, 'txn_' || doc_id AS transaction_id, CAST(doc_id % 4 AS INT) AS attempts, ['PENDING', 'RETRYING', 'FAILED', 'SUCCESS'][CAST((doc_id // 4) % 4 AS INT) + 1] AS status,
        {T0} + to_minutes(CAST((doc_id * 7919) % 100000 AS INT)) AS created_at, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 3 = 0 END AS delivered FROM documents""",
    "joined": "SELECT a.*, f.feedback_id, f.analyst_label, f.timestamp FROM alerts a JOIN feedback f USING (transaction_id) WHERE f.analyst_label IS NOT NULL",
    "labelled": "SELECT *, CASE WHEN analyst_label = 'Confirmed Fraud' THEN 1 ELSE 0 END AS label FROM joined WHERE analyst_label IN ('Confirmed Fraud', 'False Positive')",
    "latest": "SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY timestamp DESC, feedback_id DESC) = 1",
    "factors": """SELECT row_number() OVER (ORDER BY coalesce(score, 0) DESC, pos) AS rank, feature, score FROM (
        SELECT pos, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.feature' ELSE x->>'$[0]' END AS feature, TRY_CAST(CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.score' ELSE x->>'$[1]' END AS DOUBLE) AS score
        FROM (SELECT unnest(CASE WHEN json_valid(feature_importance) THEN CAST(feature_importance AS JSON[]) ELSE [] END) AS x, unnest(range(CASE WHEN json_valid(feature_importance) THEN CAST(json_array_length(feature_importance) AS BIGINT) ELSE 0 END)) AS pos FROM champion)
        WHERE json_type(x) = 'OBJECT' OR (json_type(x) = 'ARRAY' AND json_array_length(x) = 2)) WHERE feature IS NOT NULL""",
}
CTES["factors"] += " ORDER BY rank LIMIT 3"
DESCRIBE = "CASE feature WHEN 'avg_amount' THEN 'High value transfer (avg_amount)' WHEN 'v_count' THEN 'High velocity (v_count)' WHEN 'g_dist' THEN 'Multi-governorate travel (g_dist)' ELSE feature END"


def _windows(size_s: int, slide_s: int, source: str = "good") -> str:
    return f"""SELECT w AS window_start, w + {size_s} AS window_end, user_id, count(transaction_id) AS v_count, count(DISTINCT governorate) AS g_dist,
        avg(amount_tnd) AS avg_amount, CAST(sum(CASE WHEN payment_method = 'Flouci' THEN 1 ELSE 0 END) AS BIGINT) AS flouci_count
        FROM (SELECT *, unnest(generate_series(b - {size_s - slide_s}, b, {slide_s})) AS w FROM (SELECT *, CAST(floor(epoch(event_time) / {slide_s}) AS BIGINT) * {slide_s} AS b FROM {source})) GROUP BY w, user_id"""


CTES["daily"] = _windows(86400, 21600)
CTES["scored"] = """SELECT *, CASE WHEN v_count > 3 THEN 1.0::DOUBLE ELSE 0.0 END AS velocity_risk, CASE WHEN g_dist > 1 THEN 1.0::DOUBLE ELSE 0.0 END AS travel_risk,
    CASE WHEN avg_amount > 5000 THEN 1.0::DOUBLE ELSE 0.0 END AS high_value_risk, CASE WHEN avg_amount > 2000 AND flouci_count > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS d17_risk,
    CAST(CASE WHEN avg_amount BETWEEN 1400 AND 1500 THEN 1 ELSE 0 END AS INT) AS is_smurfing, CAST(CASE WHEN v_count > 5 THEN 1 ELSE 0 END AS INT) AS high_velocity_flag FROM daily"""
RISK = "round(0.3::DOUBLE*velocity_risk + 0.3::DOUBLE*travel_risk + 0.2::DOUBLE*high_value_risk + 0.2::DOUBLE*d17_risk, 4)"


def _t(c: str) -> str:
    return f"strftime(to_timestamp({c}) AT TIME ZONE 'UTC', {FMT}) AS {c}"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


ORDER = ["transactions", "flags", "good", "alerts", "feedback", "registry", "champion", "dead", "joined", "labelled", "latest", "factors", "daily", "scored"]


def _with(body: str, *names: str) -> str:
    need = [n for n in ORDER if n in names]
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in need) + " " + body


TX = ("transactions", "flags", "good")
DAY = (*TX, "daily", "scored")
AF = ("alerts", "feedback", "joined", "labelled")
REG = ("registry", "champion", "factors")
EVENT_COLS = f"transaction_id, strftime(event_time, {FMT}) AS event_time, user_id, round(amount_tnd, 4) AS amount_tnd, governorate, payment_method, branch_id, fraud_seed"
WIN_COLS = f"{_t('window_start')}, {_t('window_end')}, user_id, v_count, g_dist, round(avg_amount, 4) AS avg_amount, flouci_count"
KIND = "coalesce(alert_type, 'high_risk')"


def _performance(where: str) -> str:
    return _with(f"""SELECT tp, fp, tn, fn, round(efn, 3) AS estimated_fn, round(p, 3) AS precision, round(rr, 3) AS reviewed_recall, round(er, 3) AS estimated_recall, round({_ratio("2*p*er", "(p+er)")}, 3) AS f1 FROM (
        SELECT *, {_ratio("tp", "(tp+fp)")} AS p, CASE WHEN tn+fn > 0 THEN {_ratio("tp", "(tp+fn)")} ELSE 0.0 END AS rr, CASE WHEN tn+fn > 0 THEN {_ratio("tp", "(tp+efn)")} ELSE 0.0 END AS er FROM (
        SELECT *, fn / 0.01::DOUBLE AS efn FROM (SELECT count(*) FILTER (k = 'high_risk' AND l = 'Confirmed Fraud') AS tp, count(*) FILTER (k = 'high_risk' AND l = 'False Positive') AS fp,
        count(*) FILTER (k = 'random_sample' AND l = 'False Positive') AS tn, count(*) FILTER (k = 'random_sample' AND l = 'Confirmed Fraud') AS fn
        FROM (SELECT coalesce(a.alert_type, 'high_risk') AS k, f.analyst_label AS l FROM feedback f JOIN alerts a USING (transaction_id) WHERE {where}))))""", "alerts", "feedback")


SWEEP = f"""SELECT threshold, tp, fp, round(p, 3) AS precision, round(r, 3) AS recall, round({_ratio("2*p*r", "(p+r)")}, 3) AS f1 FROM (
    SELECT *, {_ratio("tp", "(tp+fp)")} AS p, {_ratio("tp", "n")} AS r FROM (SELECT t.threshold, count(*) FILTER (label = 1 AND ml_probability >= t.threshold) AS tp, count(*) FILTER (label = 0 AND ml_probability >= t.threshold) AS fp, count(*) FILTER (label = 1) AS n
    FROM labelled, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS threshold) t GROUP BY t.threshold))"""
STAT = "avg(amount_tnd) AS m, stddev_samp(amount_tnd) AS s"

FIELDS = """'ML Score: ' || printf('%.2f', ml_probability), 'Amount: ' || printf('%.2f', coalesce(amount_tnd, 0.0)) || ' TND', 'Governorate: ' || coalesce(governorate, 'UNKNOWN'), 'Payment Method: ' || payment_method,
    'Timestamp: ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S')"""
PROMPT = "concat_ws(chr(10), 'INVESTIGATION: Analyze suspicious activity for user ' || user_id || '.', 'Transaction ID: ' || transaction_id, " + FIELDS + """,
    'Regulatory Context: {context}', 'Write a suspicious activity report: summary, risk factors, rules concerned, next steps.')"""

SQL: dict[str, str] = {
    "ingest_parse_json": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "quality_flags": _with("SELECT transaction_id, negative_amount_flag, invalid_governorate_flag, null_id_flag FROM flags", *TX),
    "quality_gate_pass": _with(f"SELECT {EVENT_COLS} FROM good", *TX),
    "quality_gate_rejects": _with(f"SELECT {EVENT_COLS} FROM flags WHERE negative_amount_flag OR invalid_governorate_flag OR null_id_flag", *TX),
    "d17_rule": _with("SELECT transaction_id, CASE WHEN payment_method = 'Flouci' AND amount_tnd > 2000 THEN 0.2::DOUBLE ELSE 0.0 END AS d17_risk_boost FROM transactions", *TX),
    "sliding_features": _with(f"SELECT {WIN_COLS} FROM ({_windows(300, 60)})", *TX),
    "sliding_features_daily": _with(f"SELECT {WIN_COLS} FROM daily", *TX, "daily"),
    "risk_score": _with(f"SELECT {WIN_COLS}, velocity_risk, travel_risk, high_value_risk, d17_risk, {RISK} AS risk_score FROM scored", *DAY),
    "ml_features": _with(f"SELECT {_t('window_start')}, user_id, is_smurfing, high_velocity_flag, -1.0::DOUBLE AS ml_prediction, {RISK} AS ml_probability FROM scored", *DAY),
    "rule_label": _with(f"SELECT {_t('window_start')}, user_id, CAST(CASE WHEN v_count > 5 OR g_dist > 1 OR (is_smurfing = 1 AND v_count > 3) THEN 1 ELSE 0 END AS INT) AS label FROM scored", *DAY),
    "heuristic_label": _with("SELECT transaction_id, CAST(CASE WHEN ml_probability > 0.9 THEN 1 ELSE 0 END AS INT) AS label FROM alerts", "alerts"),
    "route_high_risk": _with("SELECT transaction_id, ml_probability FROM alerts WHERE ml_probability > 0.85", "alerts"),
    "route_random_sample": _with("SELECT transaction_id, ml_probability FROM alerts WHERE ml_probability < 0.1 AND substr(md5(transaction_id), 1, 4) < '4000'", "alerts"),
    "route_uncertainty": _with("SELECT transaction_id, ml_probability FROM alerts WHERE ml_probability BETWEEN 0.4 AND 0.6", "alerts"),
    "review_routes": _with("SELECT * FROM (SELECT transaction_id, CASE WHEN ml_probability > 0.85 THEN 'high_risk' WHEN ml_probability BETWEEN 0.4 AND 0.6 THEN 'uncertainty_sample' WHEN ml_probability < 0.1 AND substr(md5(transaction_id), 1, 4) < '4000' THEN 'random_sample' END AS alert_type FROM alerts) WHERE alert_type IS NOT NULL", "alerts"),
    "high_risk_topk": _with(f"SELECT transaction_id, user_id, ml_probability FROM alerts WHERE {KIND} = 'high_risk' AND ml_probability > 0.85 ORDER BY ml_probability DESC, transaction_id LIMIT 50", "alerts"),
    "review_queue": _with(f"SELECT transaction_id, {KIND} AS alert_type, strftime(created_at, {FMT}) AS created_at FROM alerts a ORDER BY a.created_at DESC, transaction_id LIMIT 100", "alerts"),
    "review_mask": _with(f"SELECT transaction_id, alert_type, ml_probability FROM alerts WHERE {KIND} <> 'high_risk' OR ml_probability >= 0.9", "alerts"),
    "alert_display": _with(f"SELECT transaction_id AS \"Transaction\", CASE {KIND} WHEN 'random_sample' THEN 'Random Sample' WHEN 'uncertainty_sample' THEN 'Uncertain' ELSE 'High Risk' END AS \"Type\", user_id AS \"User\", printf('%.2f', amount_tnd) AS \"Amount\", printf('%.3f', ml_probability) AS \"Probability\" FROM alerts", "alerts"),
    "risk_level": _with("SELECT transaction_id, ml_probability, CASE WHEN ml_probability > 0.9 THEN 'HIGH' WHEN ml_probability > 0.8 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM alerts", "alerts"),
    "list_branches": _with("SELECT DISTINCT branch_id FROM alerts WHERE branch_id IS NOT NULL AND branch_id <> '' ORDER BY branch_id", "alerts"),
    "alert_feedback_join": _with(f"SELECT transaction_id, ml_probability, alert_type, feedback_id, analyst_label, strftime(timestamp, {FMT}) AS timestamp FROM joined", *AF),
    "verified_label": _with("SELECT transaction_id, feedback_id, CAST(label AS INT) AS label, CAST(CASE WHEN amount_tnd BETWEEN 1400 AND 1500 THEN 1 ELSE 0 END AS INT) AS is_smurfing, CAST(0 AS INT) AS high_velocity_flag FROM labelled", *AF),
    "feedback_breakdown": _with("SELECT analyst_label, count(*) AS n FROM feedback GROUP BY 1", "feedback"),
    "feedback_breakdown_by_type": _with("SELECT coalesce(a.alert_type, 'unknown') AS alert_type, f.analyst_label, count(*) AS n FROM feedback f LEFT JOIN alerts a USING (transaction_id) WHERE f.analyst_label IS NOT NULL GROUP BY 1, 2", *AF),
    "system_stats": _with(f"""SELECT total_feedback, feedback_available, high_risk_alerts, random_samples, uncertainty_samples, queue_total, round({_ratio("tp", "(tp+fp)")}, 3) AS high_risk_precision, round({_ratio("rc", "(rc+rf)")}, 3) AS random_fraud_rate FROM
        (SELECT count(*) AS total_feedback, count(analyst_label) AS feedback_available FROM feedback),
        (SELECT count(*) FILTER ({KIND} = 'high_risk' AND ml_probability > 0.85) AS high_risk_alerts, count(*) FILTER ({KIND} = 'random_sample') AS random_samples, count(*) FILTER ({KIND} = 'uncertainty_sample') AS uncertainty_samples, count(*) AS queue_total FROM alerts),
        (SELECT count(*) FILTER ({KIND} = 'high_risk' AND analyst_label = 'Confirmed Fraud') AS tp, count(*) FILTER ({KIND} = 'high_risk' AND analyst_label = 'False Positive') AS fp, count(*) FILTER ({KIND} = 'random_sample' AND analyst_label = 'Confirmed Fraud') AS rc, count(*) FILTER ({KIND} = 'random_sample' AND analyst_label = 'False Positive') AS rf FROM joined)""", *AF),
    "model_performance": _performance("f.analyst_label IS NOT NULL"),
    "model_performance_branch": _performance("f.analyst_label IS NOT NULL AND f.branch_id = 'src1'"),
    "feedback_precision": _with(f"SELECT *, round({_ratio('confirmed', 'total')}, 3) AS precision FROM (SELECT count(*) FILTER (analyst_label = 'Confirmed Fraud') AS confirmed, count(*) FILTER (analyst_label = 'False Positive') AS false_positives, count(*) AS total FROM feedback)", "feedback"),
    "threshold_sweep": _with(SWEEP, *AF),
    "optimal_threshold": _with(f"SELECT threshold, f1 FROM ({SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1", *AF),
    "latest_feedback": _with(f"SELECT transaction_id, feedback_id, analyst_label, strftime(timestamp, {FMT}) AS timestamp FROM latest", "feedback", "latest"),
    "audit_trail": _with(f"SELECT 'ALERT' AS entity_type, transaction_id AS entity_id, 'CLASSIFY' AS action, 'unknown' AS user_id, strftime(timestamp, {FMT}) AS timestamp, feedback_id, lag(analyst_label) OVER (PARTITION BY transaction_id ORDER BY f.timestamp, feedback_id) AS previous_label, analyst_label AS new_label FROM feedback f", "feedback"),
    "feedback_branch_backfill": _with("SELECT f.transaction_id, f.feedback_id, coalesce(nullif(f.branch_id, ''), a.branch_id) AS branch_id FROM feedback f LEFT JOIN alerts a USING (transaction_id)", *AF),
    "alert_export": _with(f"SELECT a.transaction_id, user_id, amount_tnd, governorate, payment_method, a.branch_id, ml_probability, alert_type, l.analyst_label, strftime(l.timestamp, {FMT}) AS analyst_timestamp FROM alerts a LEFT JOIN latest l USING (transaction_id)", "alerts", "feedback", "latest"),
    "ctaf_export": _with(f"SELECT transaction_id, user_id, amount_tnd, governorate, branch_id, ml_probability, feedback_id, analyst_label, strftime(timestamp, {FMT}) AS analyst_timestamp, coalesce((SELECT string_agg({DESCRIBE}, '; ' ORDER BY rank) FROM factors), '') AS top_risk_factors FROM joined WHERE analyst_label = 'Confirmed Fraud' AND timestamp >= TIMESTAMP '2024-01-01 00:00:00'", *AF, *REG),
    "top_risk_factors": _with(f"SELECT CAST(rank AS INT) AS rank, feature, {DESCRIBE} AS description, round(score, 4) AS score FROM factors", *REG),
    "alert_insert_ignore": _with("SELECT transaction_id, CASE WHEN CAST(transaction_id AS BIGINT) % 2 = 0 THEN user_id ELSE 'second' END AS user_id FROM alerts WHERE CAST(transaction_id AS BIGINT) % 2 = 0 OR CAST(transaction_id AS BIGINT) % 3 <> 0", "alerts"),
    "dlq_retry_candidates": _with(f"SELECT id, transaction_id, attempts, status, strftime(created_at, {FMT}) AS created_at FROM dead WHERE status IN ('PENDING', 'RETRYING') AND attempts < 3", "dead"),
    "dlq_transition": _with("SELECT id, CAST(CASE WHEN tried THEN attempts + 1 ELSE attempts END AS INT) AS attempts, CASE WHEN NOT tried THEN status WHEN delivered THEN 'SUCCESS' WHEN attempts + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status FROM (SELECT *, status IN ('PENDING', 'RETRYING') AND attempts < 3 AND delivered IS NOT NULL AS tried FROM dead)", "dead"),
    "current_champion": _with("SELECT version_id, CAST(f1_score AS DOUBLE) AS f1_score, CAST(auc AS DOUBLE) AS auc FROM champion", "registry", "champion"),
    "registry_promotions": _with("SELECT version_id, version_id = (SELECT version_id FROM champion) AS is_champion FROM registry", "registry", "champion"),
    "promotion_decision": _with("SELECT r.version_id, CAST(r.f1_score AS DOUBLE) AS f1_score, CAST(c.f1_score AS DOUBLE) AS champion_f1, round(CAST(r.f1_score AS DOUBLE) - CAST(c.f1_score AS DOUBLE), 6) AS gain, round(CAST(r.f1_score AS DOUBLE) - CAST(c.f1_score AS DOUBLE), 6) >= 0.02 AS promote FROM registry r, champion c WHERE NOT r.is_champion", "registry", "champion"),
    "feedback_since_promotion": _with("SELECT transaction_id, feedback_id FROM feedback WHERE timestamp > (SELECT promoted_at FROM champion)", "feedback", "registry", "champion"),
    "retrain_decision": _with("SELECT count(*) AS feedback_count, CAST(100 AS INT) AS threshold, count(*) >= 100 AS retrain FROM feedback WHERE timestamp > (SELECT promoted_at FROM champion)", "feedback", "registry", "champion"),
    "column_statistics": _with("SELECT 'amount_tnd' AS column_name, round(avg(amount_tnd), 4) AS mean, round(stddev_samp(amount_tnd), 4) AS std, count(amount_tnd) AS n FROM transactions", *TX),
    "drift_recent_window": _with("SELECT transaction_id FROM transactions WHERE event_time >= TIMESTAMP '2024-01-29 00:00:00'", *TX),
    "drift_mean_std": _with(f"SELECT 'amount_tnd' AS column_name, round(mc, 4) AS mean_change, round(sc, 4) AS std_change, mc > 0.1 OR sc > 0.1 AS drifted FROM (SELECT abs(c.m - r.m) / abs(r.m) AS mc, abs(c.s - r.s) / abs(r.s) AS sc FROM (SELECT {STAT} FROM transactions WHERE event_time >= TIMESTAMP '2024-01-16') c, (SELECT {STAT} FROM transactions WHERE event_time < TIMESTAMP '2024-01-16') r)", *TX),
    "drift_ks_statistic": _with("SELECT round(max(abs(ca / n1 - cb / n2)), 6) AS ks_statistic, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM (SELECT amount_tnd AS v, CASE WHEN event_time < TIMESTAMP '2024-01-16' THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN event_time < TIMESTAMP '2024-01-16' THEN 0 ELSE 1.0::DOUBLE END AS b FROM transactions) WINDOW w AS (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", *TX),
    "distribution_comparison": f"SELECT period, round(avg(v), 4) AS mean, round(median(v), 4) AS median, count(*) AS n FROM (SELECT CASE WHEN t >= TIMESTAMP '2024-01-24 12:00:00' THEN 'current' WHEN t >= TIMESTAMP '2024-01-01 12:00:00' THEN 'baseline' END AS period, CAST(n_chars AS DOUBLE) AS v FROM (SELECT n_chars, {T0} + to_hours(CAST(doc_id AS INT)) AS t FROM documents)) WHERE period IS NOT NULL AND v IS NOT NULL GROUP BY 1",
    "latency_percentiles": "SELECT round(avg(value), 2) AS avg, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99, count(*) AS n FROM (SELECT value FROM events WHERE value IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1000)",
    "confusion_metrics": _with(f"SELECT tp, fp, tn, fn, round(p, 4) AS precision, round(r, 4) AS recall, round({_ratio('2*p*r', '(p+r)')}, 4) AS f1 FROM (SELECT *, {_ratio('tp', '(tp+fp)')} AS p, {_ratio('tp', '(tp+fn)')} AS r FROM (SELECT count(*) FILTER (ml_probability >= 0.5 AND label = 1) AS tp, count(*) FILTER (ml_probability >= 0.5 AND label = 0) AS fp, count(*) FILTER (ml_probability < 0.5 AND label = 0) AS tn, count(*) FILTER (ml_probability < 0.5 AND label = 1) AS fn FROM labelled))", *AF),
    "auc_rank": _with("SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM (SELECT label, CAST(rank() OVER (ORDER BY ml_probability) AS DOUBLE) + (count(*) OVER (PARTITION BY ml_probability) - 1) / 2.0 AS r, CAST(sum(label) OVER () AS DOUBLE) AS p, CAST(sum(1 - label) OVER () AS DOUBLE) AS n FROM labelled) GROUP BY p, n", *AF),
    "vector_topk": "SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 4) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), vec_id LIMIT 4",
    "sar_prompt": _with(f"SELECT transaction_id, {PROMPT.format(context='No specific regulatory context found.')} AS prompt FROM alerts", "alerts"),
    "sar_document": _with(f"SELECT 'SAR_' || replace(replace(transaction_id, ':', '_'), '-', '_') || '.txt' AS filename, concat_ws(chr(10), 'SUSPICIOUS ACTIVITY REPORT', 'Generated: 2024-01-02T00:00:00', 'Transaction ID: ' || transaction_id, 'User ID: ' || user_id, {FIELDS}, '', 'REPORT:', 'No report generated') AS document FROM alerts", "alerts"),
    "token_hash": _with("SELECT transaction_id, sha256(transaction_id) AS token_hash FROM alerts", "alerts"),
    "train_test_split": _with("SELECT transaction_id, CASE WHEN substr(md5('42:' || transaction_id), 1, 4) < 'cccc' THEN 'train' ELSE 'test' END AS split FROM alerts", "alerts"),
    "wallet_24h_limit": _with("SELECT transaction_id, round(s, 4) AS amount_24h FROM (SELECT transaction_id, sum(amount_tnd) OVER (PARTITION BY user_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS s FROM transactions) WHERE s > 1500", *TX),
    "stream_sliding_features": _with(f"SELECT {WIN_COLS} FROM ({_windows(300, 60)}) WHERE window_end <= (SELECT epoch(max(event_time)) - 600 FROM good)", *TX),
}

SQL["impossible_travel_60m"] = _with(f"SELECT {_t('window_start')}, user_id, g_dist FROM ({_windows(3600, 300, 'transactions')}) WHERE g_dist > 2", *TX)
SQL["system_overview"] = _with(
    f"SELECT l.avg AS latency_avg, l.p95 AS latency_p95, l.p99 AS latency_p99, p.*, t.threshold AS optimal_threshold FROM ({SQL['latency_percentiles']}) l, "
    f"(SELECT *, round({_ratio('confirmed', 'total')}, 3) AS precision FROM (SELECT count(*) FILTER (analyst_label = 'Confirmed Fraud') AS confirmed, count(*) FILTER (analyst_label = 'False Positive') AS false_positives, count(*) AS total FROM feedback)) p, "
    f"(SELECT threshold FROM ({SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1) t", *AF)
SQL["alert_payload"] = _with("SELECT transaction_id, user_id, coalesce(branch_id, 'unknown') AS branch_id, 'unknown' AS timestamp, 'unknown' AS sar_report, coalesce(amount_tnd, 0.0) AS amount_tnd, ml_probability, coalesce(alert_type, 'high_risk') AS alert_type FROM alerts", "alerts")
SQL["seed_corpus"] = "SELECT item_id AS id, text FROM benchmark"
SQL["append_feedback"] = _with("SELECT transaction_id, feedback_id, analyst_label, branch_id FROM feedback WHERE feedback_id < 1000000 UNION ALL SELECT transaction_id, feedback_id, analyst_label, coalesce(nullif(f.branch_id, ''), a.branch_id) FROM feedback f LEFT JOIN alerts a USING (transaction_id) WHERE feedback_id >= 1000000", "feedback", "alerts")
SQL["promotion_audit"] = _with(f"SELECT 'MODEL' AS entity_type, r.version_id AS entity_id, 'PROMOTE' AS action, 'system' AS user_id, strftime(r.promoted_at, {FMT}) AS timestamp, c.version_id AS previous_version FROM registry r LEFT JOIN champion c ON true WHERE NOT r.is_champion", "registry", "champion")
FAILURES = """SELECT *, CASE k WHEN 1 THEN '503' WHEN 2 THEN 'NO_RESPONSE' WHEN 3 THEN 'CONNECTION_ERROR' ELSE 'PROCESSING_ERROR' END AS error_code,
    CASE k WHEN 1 THEN '503 - detail ' || transaction_id WHEN 2 THEN 'No response object returned' ELSE 'detail ' || transaction_id END AS error_message
    FROM (SELECT *, CAST(transaction_id AS BIGINT) % 5 AS k FROM alerts) WHERE k <> 0"""
SQL["delivery_failures"] = _with(f"SELECT transaction_id, error_code, error_message, CAST(0 AS INT) AS attempts, 'PENDING' AS status FROM ({FAILURES})", "alerts")
SQL["retry_payload"] = _with(f"SELECT transaction_id, user_id, amount_tnd, governorate, payment_method, ml_probability, error_message AS sar_report FROM ({FAILURES})", "alerts")

#: Lookups by id, one branch, and the verdict of the drift test.
SQL["alert_export_one"] = f"SELECT * FROM ({SQL['alert_export']}) WHERE transaction_id = '7'"
SQL["explain_alert"] = _with(f"SELECT transaction_id, {KIND} AS alert_type, CAST(rank AS INT) AS rank, feature, {DESCRIBE} AS description, round(score, 4) AS score FROM alerts LEFT JOIN factors ON true WHERE transaction_id = '7'", "alerts", *REG)
SQL["feedback_breakdown_branch"] = _with("SELECT coalesce(a.alert_type, 'unknown') AS alert_type, f.analyst_label, count(*) AS n FROM feedback f LEFT JOIN alerts a USING (transaction_id) WHERE f.analyst_label IS NOT NULL AND f.branch_id = 'src1' GROUP BY 1, 2", *AF)
SQL["system_stats_branch"] = _with(f"""SELECT total_feedback, feedback_available, high_risk_alerts, random_samples, uncertainty_samples, queue_total, round({_ratio("tp", "(tp+fp)")}, 3) AS high_risk_precision, round({_ratio("rc", "(rc+rf)")}, 3) AS random_fraud_rate FROM
    (SELECT count(*) AS total_feedback, count(analyst_label) AS feedback_available FROM feedback WHERE branch_id = 'src1'),
    (SELECT count(*) FILTER ({KIND} = 'high_risk' AND ml_probability > 0.85) AS high_risk_alerts, count(*) FILTER ({KIND} = 'random_sample') AS random_samples, count(*) FILTER ({KIND} = 'uncertainty_sample') AS uncertainty_samples, count(*) AS queue_total FROM alerts WHERE branch_id = 'src1'),
    (SELECT count(*) FILTER ({KIND} = 'high_risk' AND f.analyst_label = 'Confirmed Fraud') AS tp, count(*) FILTER ({KIND} = 'high_risk' AND f.analyst_label = 'False Positive') AS fp, count(*) FILTER ({KIND} = 'random_sample' AND f.analyst_label = 'Confirmed Fraud') AS rc, count(*) FILTER ({KIND} = 'random_sample' AND f.analyst_label = 'False Positive') AS rf FROM feedback f JOIN alerts a USING (transaction_id) WHERE f.branch_id = 'src1')""", *AF)
SQL["alert_insert_ignore_all"] = _with("SELECT transaction_id, CASE WHEN CAST(transaction_id AS BIGINT) < 600 THEN user_id ELSE 'second' END AS user_id FROM alerts", "alerts")
SQL["promote"] = _with("SELECT version_id, false AS is_champion, CAST(f1_score AS DOUBLE) AS f1_score FROM registry UNION ALL SELECT 'v-new', true, f1_score FROM champion", "registry", "champion")
SQL["drift_ks_verdict"] = f"""WITH k AS ({SQL["drift_ks_statistic"]}),
l AS (SELECT n1, n2, (sqrt(n1 * n2 / (n1 + n2)::DOUBLE) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2)::DOUBLE)) * ks_statistic AS lam FROM k),
p AS (SELECT n1, n2, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(greatest((SELECT sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * i * i * lam * lam)) FROM range(1, 101) r(i)), 0.0), 1.0) END AS p FROM l)
SELECT round(p, 4) AS p_value, n1 > 10 AND n2 > 10 AND p < 0.05 AS drifted FROM p"""


def _u(k: int) -> str:
    return f"(CAST('0x' || substr(md5('42:{k}:' || event_id), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE)"


def _pick(values: tuple[str, ...], k: int) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(floor({_u(k)} * {len(values)}) AS INT) + 1]"


SQL["synth_transactions"] = f"""SELECT 'txn-' || substr(sha256('42:' || event_id), 1, 32) AS transaction_id, strftime(ts - CASE WHEN {_u(7)} < 0.1::DOUBLE THEN INTERVAL 12 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp,
    'USER_' || (CAST(floor({_u(2)} * 9000) AS BIGINT) + 1000) AS user_id, round(amount, 2) AS amount_tnd, {_pick(GOVERNORATES, 3)} AS governorate, {_pick(PAYMENT_METHODS, 4)} AS payment_method, {_pick(BRANCHES, 5)} AS branch_id,
    amount > 10000 OR {_u(6)} < 0.05::DOUBLE AS fraud_seed FROM (SELECT *, floor({_u(1)} * 1499000 + 1000) / 100 AS amount FROM events)"""
