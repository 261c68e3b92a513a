"""The running system: stored tables, and streams that feed them exactly once.

Two streams. ``ingest`` decodes each line once and deals it to events or rejects, so no
line vanishes. ``score`` takes windows of events, lets the champion of the moment score
them, and writes silver rows by day, new alerts, latencies; then it asks whether enough
labels have come in for a new model. Everything a micro-batch changes is marked with its
number in the table that changes, so a batch that runs again changes nothing twice.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrel.config import DEFAULTS, GOVERNORATES, Settings
from sentrel.operators import delivery, metrics, ml, quality, routing, scoring, store
from sentrel.operators.features import sliding_features_stream
from sentrel.schemas import ALERTS, AUDIT, FEEDBACK, LATENCY, LEASED, REGISTRY, T, TRANSACTION
from sentrel.sources import sinks
from sentrel.sources.readers import parse_json, with_event_time
from sentrel.sources.versions import Table
from sentrel.streaming.query import alert_key

log = logging.getLogger(__name__)
EVENT = T.StructType([*TRANSACTION, T.StructField("event_time", T.TimestampType()), T.StructField("d17_risk_boost", T.DoubleType())])


def reject_reason(df: DataFrame) -> Column:
    """Why a decoded line is no event: the first rule it breaks, NULL if none. ``json``:
    nothing could be read of it."""
    nothing = F.lit(True)
    for c in TRANSACTION.names:
        nothing = nothing & F.col(c).isNull()
    flags = quality.FLAGS
    return F.when(nothing, "json").when(F.col(flags[2]), "id").when(F.col("event_time").isNull(), "time").when(F.col(flags[0]), "amount").when(F.col(flags[1]), "governorate")


def decoded(raw: DataFrame) -> DataFrame:
    """Lines as events with ``reason``, NULL for those that pass, and ``raw_value``."""
    df = quality.quality_flags(with_event_time(parse_json(raw)))
    return quality.d17_rule(df.withColumn("reason", reject_reason(df)).drop(*quality.FLAGS))


@dataclass
class Service:
    """Tables below ``path``, which all executors share."""

    spark: SparkSession
    path: str
    settings: Settings = DEFAULTS
    trees: int = 100
    #: Loads a model from its path.
    load: Callable[[str], object] = ml.load
    now: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    _champion: tuple[str | None, object] = field(default=(None, None), init=False)

    def __post_init__(self) -> None:
        schemas = {"alerts": ALERTS, "feedback": FEEDBACK, "registry": REGISTRY, "audit": AUDIT, "dead_letters": LEASED, "latency": LATENCY}
        self.tables = {n: Table(self.spark, f"{self.path}/{n}", s) for n, s in schemas.items()}

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    # ---- lines to events

    def ingest(self, raw: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """``raw``: a stream with a text column ``value``."""
        q = decoded(raw).writeStream.foreachBatch(self.write_events).option("checkpointLocation", f"{self.path}/_checkpoints/ingest")
        return q.trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def write_events(self, batch: DataFrame, batch_id: int) -> None:
        """Every line of the batch lands in one of two tables; a batch that is there
        whole is not written again, so that the stream that reads events sees no file
        twice."""
        done, events, rejects = self._marks(batch_id), f"{self.path}/events/batch={batch_id}", f"{self.path}/rejects/batch={batch_id}"
        if all(done):
            return
        batch = batch.persist()
        try:
            if not done[1]:
                batch.filter("reason IS NOT NULL").select("raw_value", "reason").write.mode("overwrite").parquet(rejects)
            if not done[0]:
                batch.filter("reason IS NULL").select(*EVENT.names).write.mode("overwrite").parquet(events)
        finally:
            batch.unpersist()

    def _marks(self, batch_id: int) -> list[bool]:
        t = self["alerts"]
        return [t._fs.exists(t._hadoop(f"{self.path}/{n}/batch={batch_id}/_SUCCESS")) for n in ("events", "rejects")]

    def events(self) -> DataFrame:
        """The events as a stream."""
        return self.spark.readStream.schema(EVENT).parquet(f"{self.path}/events/batch=*")

    def show(self, raw: DataFrame, rows: int = 20, trigger: dict | None = None) -> StreamingQuery:
        """Prints the lines that pass, decoded, and those that do not, with the reason."""
        return sinks.console(decoded(raw), rows).trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    # ---- alerts and verdicts from outside

    def add_alerts(self, rows: DataFrame, source: str = "", batch: str = "") -> None:
        """Alerts whose id is not there yet; the first of an id that comes twice."""
        self["alerts"].append_new(lambda old: store.new_rows(old, rows), source, batch)

    def add_feedback(self, rows: DataFrame, source: str, batch: str) -> None:
        """Verdicts (transaction_id, analyst_label, timestamp; analyst_comment, branch_id,
        user_id and feedback_id if there are any) and one audit row for each, which tells
        the verdict before it. A missing branch is the alert's. The batch is a number or
        a name of its own within ``source``; run again, it adds what is still missing."""
        fb, audit = self["feedback"], self["audit"]
        new = rows
        for c in ("analyst_comment", "branch_id"):
            new = new if c in new.columns else new.withColumn(c, F.lit(None).cast("string"))
        if "feedback_id" not in new.columns:
            new = new.withColumn("feedback_id", F.xxhash64(F.lit(source), F.lit(batch), "transaction_id", "timestamp", "analyst_label", "analyst_comment"))
        fb.append_new(lambda _: store.feedback_branch_backfill(new, self["alerts"].read()), source, batch)
        at = fb.number_of(source, batch)
        if not at or audit.has(source, batch, audit.version()):
            return
        # the verdicts of this batch among the last ones before it
        mine = store.feedback_branch_backfill(new, self["alerts"].read()).select(*FEEDBACK.names, F.lit(True).alias("_new"))
        ids = mine.select("transaction_id").distinct()
        last = store.latest_feedback(fb.read(at - 1).join(ids, "transaction_id", "left_semi")).select(*FEEDBACK.names, F.lit(False).alias("_new"))
        who = rows.select(F.col("transaction_id").alias("_t"), F.col("user_id").alias("_who")).distinct().groupBy("_t").agg(F.max("_who").alias("_who")) if "user_id" in rows.columns else None
        out = store.audit_trail(mine.unionByName(last), keep=["_new"]).filter("_new").drop("_new")
        if who is not None:
            out = out.join(who, F.col("entity_id") == F.col("_t"), "left").withColumn("user_id", F.coalesce("_who", "user_id"))
        audit.append(out, source, batch)

    # ---- events to silver, alerts, latencies

    def score(self, events: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
        s = self.settings
        own = events is None  # lines with other places were rejected
        windows = sliding_features_stream(self.events() if own else events, s.window, s.slide, s.watermark, GOVERNORATES if own else ())
        rows = scoring.ml_features(scoring.risk_score(windows, s), s)
        q = rows.writeStream.outputMode("append").foreachBatch(self.process).option("checkpointLocation", f"{self.path}/_checkpoints/score")
        return q.trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def champion(self) -> tuple[str | None, object]:
        """Version and model of the champion now; loaded when it changes. Without one, or
        if it cannot be loaded, rules score (None)."""
        row = store.current_champion(self["registry"].read()).select("version_id", "model_path").first()
        version = row and row.version_id
        if version != self._champion[0]:
            try:
                self._champion = (version, self.load(row.model_path) if version else None)
            except Exception:
                log.exception("champion %s cannot be loaded, rules score", version)
                return None, None
        return self._champion

    def process(self, batch: DataFrame, batch_id: int) -> None:
        version, model = self.champion()
        rows = scoring.score(batch, model).withColumns({"transaction_id": alert_key(), "model_version": F.lit(version).cast("string")}).persist()
        try:
            sinks.write_silver_batch(rows, f"{self.path}/silver", batch_id)
            found = routing.review_routes(rows, self.settings).withColumns({"timestamp": F.col("window_end"), "created_at": F.col("window_end"), "amount_tnd": F.col("avg_amount")})
            self["alerts"].append_new(lambda old: store.new_rows(old, found.select("transaction_id", "user_id", "amount_tnd", "ml_probability", "alert_type", "created_at")), "score", str(batch_id))
            late = rows.select((F.unix_millis(F.lit(self.now())) - F.unix_millis("window_end")).alias("ms"))
            self["latency"].append(metrics.latency_sketch(late, "ms"), "score", str(batch_id))
        finally:
            rows.unpersist()
        self.retrain(batch_id)

    def latency(self) -> DataFrame:
        return metrics.sketch_percentiles(self["latency"].read())

    # ---- retraining

    def labelled(self) -> DataFrame:
        """Silver rows with the last verdict on each."""
        silver = self.spark.read.parquet(f"{self.path}/silver")
        last = store.latest_feedback(self["feedback"].read().filter("analyst_label IS NOT NULL"))
        return silver.join(last.select("transaction_id", "analyst_label"), "transaction_id").withColumn("label", F.when(F.col("analyst_label") == scoring.CONFIRMED, 1).otherwise(0))

    def retrain(self, batch_id: int) -> bool:
        """Trains a challenger once enough labels have come since the last promotion and
        since the last challenger; True if it became champion. Registry and audit are
        marked with the batch: run again, it does what is still missing and no more."""
        registry, audit, mark = self["registry"], self["audit"], str(batch_id)
        before = registry.version()
        if not registry.has("retrain", mark, before):
            labels = self["feedback"].read().filter("analyst_label IS NOT NULL")
            versions = registry.read()
            n = store.feedback_since_promotion(labels, versions).count()
            tried = versions.agg(F.max("training_samples_count")).first()[0]
            if n < max(1, self.settings.retrain_feedback) or tried is not None and tried >= labels.count():
                return False
            version = ml.version_id(batch_id)
            model_path = f"{self.path}/models/{version}"
            out = ml.champion_challenger(self.labelled(), n, False, self.champion()[1], self.settings, self.trees)
            if not out.trained:
                return False
            ml.save(out.model, model_path)
            new = self.spark.createDataFrame([(version, model_path, out.f1, out.auc, out.promoted, self.now() if out.promoted else None, labels.count(), ml.importance_json(out.model))], REGISTRY)
            add = (lambda reg: store.promote(reg, new)) if out.promoted else (lambda reg: reg.unionByName(new))
            registry.rewrite(add, "retrain", mark)
        at = registry.number_of("retrain", mark)
        new = registry.read(at).filter(F.col("version_id") == ml.version_id(batch_id)).filter("is_champion") if at else None
        if new is None or new.isEmpty():
            return False
        audit.append(store.promotion_audit(registry.read(at - 1), new), "retrain", mark)
        return True

    # ---- dead letters

    def retry(self, deliver: Callable[[DataFrame], DataFrame], owner: str, lease: timedelta = timedelta(minutes=5)) -> int:
        """One round: leases what may be sent, sends it, stores how it went. ``deliver``
        takes the leased rows and returns (id, delivered). The lease is committed before
        anything is sent, so two workers never have the same row; rows of a worker that
        is gone are free when its lease is over. Returns how many rows it had."""
        return retry_round(self["dead_letters"], deliver, owner, self.now(), lease, self.settings)

    def keep_retrying(self, deliver: Callable[[DataFrame], DataFrame], owner: str, every: str = "60 seconds", lease: timedelta = timedelta(minutes=5)) -> StreamingQuery:
        """A round at every tick of a clock stream, until it is stopped. Any number of
        workers may run side by side."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda *_: self.retry(deliver, owner, lease)).trigger(processingTime=every).start()

    def failed(self, sent: DataFrame, source: str = "", batch: str = "") -> None:
        """Stores the alerts of ``sent`` that did not arrive (see
        delivery.delivery_failures); ids come from the alert and the batch."""
        rows = delivery.delivery_failures(sent).withColumn("id", F.xxhash64(F.lit(source), F.lit(batch), "transaction_id", "error_code"))
        self["dead_letters"].append(rows.withColumn("created_at", F.lit(self.now())), source, batch)


def retry_round(dead: Table, deliver: Callable[[DataFrame], DataFrame], owner: str, now: datetime, lease: timedelta, s: Settings = DEFAULTS) -> int:
    claimed = dead.rewrite(lambda t: store.dlq_claim(t, owner, now, now + lease, s))
    mine = dead.read(claimed.number).filter((F.col("lease_owner") == owner) & (F.col("status") == "RETRYING") & (F.col("last_attempt") == F.lit(now)))
    n = mine.count()
    if n:
        # written before it is used: what was sent is not sent again if a writer has to start over
        path = f"{dead.path}/outcomes-{claimed.number:012d}-{uuid.uuid4().hex}"
        deliver(mine).select("id", "delivered").write.parquet(path)
        outcomes = dead.spark.read.parquet(path)
        dead.rewrite(lambda t: store.dlq_settle(t, outcomes, owner, s))
    return n
