"""Data quality gate. NULL amounts and NULL governorates pass; NULL ids do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentrel.config import DEFAULTS, GOVERNORATES, Settings

FLAGS = ("negative_amount_flag", "invalid_governorate_flag", "null_id_flag")


def _failed() -> Column:
    a, b, c = (F.col(x) for x in FLAGS)
    return a | b | c


def quality_flags(df: DataFrame) -> DataFrame:
    """Adds one non-null boolean per rule."""
    return df.withColumns({
        "negative_amount_flag": F.coalesce(F.col("amount_tnd") < 0, F.lit(False)),
        "invalid_governorate_flag": F.coalesce(~F.col("governorate").isin(*GOVERNORATES), F.lit(False)),
        "null_id_flag": F.col("transaction_id").isNull(),
    })


def gate_pass(df: DataFrame) -> DataFrame:
    return quality_flags(df).filter(~_failed())


def gate_rejects(df: DataFrame) -> DataFrame:
    return quality_flags(df).filter(_failed())


def d17_rule(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    hit = (F.col("payment_method") == "Flouci") & (F.col("amount_tnd") > s.d17_amount)
    return df.withColumn("d17_risk_boost", F.when(hit, F.lit(s.d17_boost)).otherwise(F.lit(0.0)))
