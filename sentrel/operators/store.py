"""Table maintenance as pure functions: insert-if-absent, latest rows, audit,
registry and dead letters. Callers write the result as a new table version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from sentrel.config import DEFAULTS, Settings


def new_rows(existing: DataFrame, incoming: DataFrame, order: str = "created_at", key: str = "transaction_id") -> DataFrame:
    """Of ``incoming`` the first row of each non-null key that ``existing`` lacks: the
    least struct of a key, so that many rows of one key are reduced before the shuffle."""
    rest = [c for c in incoming.columns if c not in (key, order)]
    best = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    first = best.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in incoming.columns])
    return first.join(existing.select(key), key, "left_anti").select(incoming.columns)


def insert_ignore(existing: DataFrame, incoming: DataFrame, order: str = "created_at", key: str = "transaction_id") -> DataFrame:
    """``existing`` and of ``incoming`` the first row of each new, non-null key."""
    return existing.unionByName(new_rows(existing, incoming, order, key), allowMissingColumns=True)


def latest_feedback(fb: DataFrame) -> DataFrame:
    """max_by instead of a window: partial aggregation keeps hot keys small."""
    rest = [c for c in fb.columns if c != "transaction_id"]
    best = fb.groupBy("transaction_id").agg(F.max(F.struct("timestamp", "feedback_id", *[c for c in rest if c not in ("timestamp", "feedback_id")])).alias("r"))
    return best.select("transaction_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def feedback_branch_backfill(fb: DataFrame, al: DataFrame) -> DataFrame:
    """Feedback without a branch takes its alert's; '' counts as none."""
    a = al.select("transaction_id", F.col("branch_id").alias("_alert_branch"))
    return fb.join(a, "transaction_id", "left").withColumn("branch_id", F.coalesce(F.nullif(F.col("branch_id"), F.lit("")), F.col("_alert_branch"))).drop("_alert_branch")


def append_feedback(fb: DataFrame, new: DataFrame, al: DataFrame) -> DataFrame:
    """``fb`` and all rows of ``new``, whose missing branches come from their alerts."""
    return fb.unionByName(feedback_branch_backfill(new, al), allowMissingColumns=True)


def with_previous(df: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Adds ``name``: ``columns`` of the row before, in ``order`` (a time first) within
    ``key``. One key may hold a third of all rows, so keys are split by day; the first
    row of a day takes the last one of the key's day before, of one row a day."""
    day = F.to_date(order[0])
    inside = W.partitionBy(key, "_day").orderBy(*order)
    rows = df.withColumn("_day", day).withColumns({name: F.lag(F.struct(*columns)).over(inside), "_n": F.row_number().over(inside)})
    last = df.groupBy(F.col(key).alias("_k"), day.alias("_d")).agg(F.max(F.struct(*order, F.struct(*columns).alias("_r"))).alias("_m"))
    last = last.select("_k", "_d", F.lag("_m._r").over(W.partitionBy("_k").orderBy("_d")).alias("_earlier")).filter("_earlier IS NOT NULL")
    j = rows.join(last, F.col(key).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d")) & (F.col("_n") == 1), "left")
    return j.withColumn(name, F.coalesce(F.col(name), F.col("_earlier"))).drop("_day", "_n", "_k", "_d", "_earlier")


def audit_trail(fb: DataFrame, user_id: str = "unknown", keep: list[str] | None = None) -> DataFrame:
    """One row per review: the label before and after, also as JSON states. ``keep``:
    columns that stay beside them."""
    fb = fb.withColumns({c: F.lit(None).cast("string") for c in ("analyst_comment", "branch_id") if c not in fb.columns})
    out = with_previous(fb, "transaction_id", ["timestamp", "feedback_id"], ["analyst_label", "analyst_comment"], "_before")
    return out.select(
        F.lit("ALERT").alias("entity_type"), F.col("transaction_id").alias("entity_id"), F.lit("CLASSIFY").alias("action"), F.lit(user_id).alias("user_id"), "timestamp", "feedback_id",
        F.col("_before.analyst_label").alias("previous_label"), F.col("analyst_label").alias("new_label"),
        F.to_json("_before", {"ignoreNullFields": "false"}).alias("previous_state"),
        F.to_json(F.struct("analyst_label", "analyst_comment", "branch_id"), {"ignoreNullFields": "false"}).alias("new_state"), *(keep or []),
    )


def promotion_audit(reg: DataFrame, new: DataFrame, user_id: str = "system") -> DataFrame:
    """One audit row per promoted version of ``new``: the champion before it as JSON
    (NULL if there was none) and the new one's path and scores."""
    champ = current_champion(reg).agg(F.first(F.struct("*")).alias("_c"))
    state = F.to_json(F.struct(*[F.col(c) for c in ("version_id", "model_path", "f1_score", "auc") if c in new.columns]), {"ignoreNullFields": "false"})
    return new.crossJoin(F.broadcast(champ)).select(
        F.lit("MODEL").alias("entity_type"), F.col("version_id").alias("entity_id"), F.lit("PROMOTE").alias("action"), F.lit(user_id).alias("user_id"), F.col("promoted_at").alias("timestamp"),
        F.col("_c.version_id").alias("previous_version"), F.to_json("_c", {"ignoreNullFields": "false"}).alias("previous_state"), state.alias("new_state"),
    )


def current_champion(reg: DataFrame) -> DataFrame:
    return reg.filter("is_champion").orderBy(F.col("promoted_at").desc_nulls_last(), F.col("version_id").desc()).limit(1)


def registry_promotions(reg: DataFrame) -> DataFrame:
    """Only the most recently promoted champion keeps the flag."""
    best = reg.filter("is_champion").agg(F.max_by("version_id", F.struct("promoted_at", "version_id")).alias("_best"))
    return reg.crossJoin(F.broadcast(best)).withColumn("is_champion", F.coalesce(F.col("version_id") == F.col("_best"), F.lit(False))).drop("_best")


def promote(reg: DataFrame, new: DataFrame) -> DataFrame:
    """Demote all, then add the new champion."""
    return reg.withColumn("is_champion", F.lit(False)).unionByName(new.withColumn("is_champion", F.lit(True)), allowMissingColumns=True)


def promotion_decision(reg: DataFrame, challengers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Promote where there is no champion score, or the F1 gain is large enough."""
    champ = current_champion(reg).agg(F.first("f1_score").alias("champion_f1"))
    gain = F.round(F.col("f1_score") - F.col("champion_f1"), 6)
    return challengers.crossJoin(F.broadcast(champ)).select("version_id", "f1_score", "champion_f1", gain.alias("gain"), F.coalesce(gain >= s.promotion_gain, F.lit(True)).alias("promote"))


def feedback_since_promotion(fb: DataFrame, reg: DataFrame) -> DataFrame:
    champ = current_champion(reg).agg(F.first("promoted_at").alias("_since"))
    return fb.crossJoin(F.broadcast(champ)).filter(F.col("_since").isNull() | (F.col("timestamp") > F.col("_since"))).drop("_since")


def retrain_decision(fb: DataFrame, reg: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    n = feedback_since_promotion(fb, reg).agg(F.count("*").alias("feedback_count"))
    return n.select("feedback_count", F.lit(s.retrain_feedback).alias("threshold"), (F.col("feedback_count") >= s.retrain_feedback).alias("retrain"))


def dlq_candidates(dead: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Oldest first when written as one file; the order is not part of the rows."""
    return dead.filter(F.col("status").isin("PENDING", "RETRYING") & (F.col("attempts") < s.dlq_max_attempts)).orderBy("created_at", "id")


def dlq_step(dead: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One retry round. ``delivered`` tells how each attempt went (NULL: not sent)."""
    tried = F.col("status").isin("PENDING", "RETRYING") & (F.col("attempts") < s.dlq_max_attempts) & F.col("delivered").isNotNull()
    n = F.col("attempts") + 1
    status = F.when(~tried, F.col("status")).when(F.col("delivered"), "SUCCESS").when(n >= s.dlq_max_attempts, "FAILED").otherwise("PENDING")
    return dead.withColumns({"status": F.when(F.coalesce(tried, F.lit(False)), status).otherwise(F.col("status")), "attempts": F.when(F.coalesce(tried, F.lit(False)), n).otherwise(F.col("attempts"))})



def dlq_claim(dead: DataFrame, owner: str, now: datetime, until: datetime, s: Settings = DEFAULTS) -> DataFrame:
    """All rows; those that may be sent are leased to ``owner``: PENDING ones, and
    RETRYING ones whose lease is over (their worker is gone). A row whose last attempt
    was lost like that has failed."""
    at = F.lit(now)
    free = (F.col("status") == "PENDING") | ((F.col("status") == "RETRYING") & (F.col("lease_until").isNull() | (F.col("lease_until") < at)))
    free = F.coalesce(free, F.lit(False))
    n = F.coalesce("attempts", F.lit(0))
    take, lost = free & (n < s.dlq_max_attempts), free & (n >= s.dlq_max_attempts) & (F.col("status") == "RETRYING")
    return dead.select("*", take.alias("_take"), lost.alias("_lost")).withColumns({
        "status": F.when(F.col("_take"), "RETRYING").when(F.col("_lost"), "FAILED").otherwise(F.col("status")), "attempts": F.when(F.col("_take"), n + 1).otherwise(n),
        "last_attempt": F.when(F.col("_take"), at).otherwise(F.col("last_attempt")), "lease_owner": F.when(F.col("_take"), owner).when(~F.col("_lost"), F.col("lease_owner")),
        "lease_until": F.when(F.col("_take"), F.lit(until)).when(~F.col("_lost"), F.col("lease_until")),
    }).drop("_take", "_lost")


def dlq_settle(dead: DataFrame, outcomes: DataFrame, owner: str, s: Settings = DEFAULTS) -> DataFrame:
    """All rows; those leased to ``owner`` take their outcome (id, delivered). A row that
    someone else has leased since, or that has no outcome, stays as it is."""
    o = outcomes.filter("delivered IS NOT NULL").groupBy("id").agg(F.max("delivered").alias("_ok"))
    mine = F.col("_ok").isNotNull() & F.coalesce((F.col("lease_owner") == owner) & (F.col("status") == "RETRYING"), F.lit(False))
    status = F.when(F.col("_ok"), "SUCCESS").when(F.col("attempts") >= s.dlq_max_attempts, "FAILED").otherwise("PENDING")
    return dead.join(o, "id", "left").withColumn("_mine", mine).withColumns({
        "status": F.when(F.col("_mine"), status).otherwise(F.col("status")), "lease_owner": F.when(~F.col("_mine"), F.col("lease_owner")), "lease_until": F.when(~F.col("_mine"), F.col("lease_until")),
    }).drop("_ok", "_mine")
