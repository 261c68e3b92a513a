"""The streaming query: raw lines to silver features and review routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrel.config import DEFAULTS, GOVERNORATES, Settings
from sentrel.operators.features import sliding_features_stream
from sentrel.operators.quality import gate_pass
from sentrel.operators.routing import review_routes
from sentrel.operators.scoring import ml_features, risk_score, score
from sentrel.sources.readers import parse_json, with_event_time
from sentrel.sources.sinks import write_silver_batch


def silver(raw: DataFrame, s: Settings = DEFAULTS, model=None) -> DataFrame:
    """``raw``: a stream with a JSON text column ``value``. Rows without a readable
    time or id go. A window leaves once the watermark has passed its end."""
    events = with_event_time(gate_pass(parse_json(raw))).filter(F.col("event_time").isNotNull())
    return score(ml_features(risk_score(sliding_features_stream(events, s.window, s.slide, s.watermark, GOVERNORATES), s), s), model)


def alert_key() -> Column:
    return F.concat_ws("@", "user_id", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss"))


def start(silver_df: DataFrame, silver_path: str, alerts_path: str, checkpoint: str, s: Settings = DEFAULTS, trigger: dict | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes silver rows by day and alerts from one persisted micro-batch. A repeated
    batch overwrites its own folders, so restarts do not duplicate rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("transaction_id", alert_key()).persist()
        try:
            write_silver_batch(batch, silver_path, batch_id)
            review_routes(batch, s).write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
            if after:
                after(batch, batch_id)
        finally:
            batch.unpersist()

    writer = silver_df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
