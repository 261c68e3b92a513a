"""Drift of numeric columns between two samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sentrel.config import DEFAULTS, Settings
from sentrel.operators.metrics import exact_quantiles, running


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType))]


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, mean, std, n), all columns in one aggregate."""
    cols = columns or numeric_columns(df)
    agg = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"), F.count(c).alias(f"{c}_n"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_m").cast("double").alias("mean"), F.col(f"{c}_s").cast("double").alias("std"), F.col(f"{c}_n").alias("n")) for c in cols])
    return agg.select(F.inline(rows))


def recent_window(df: DataFrame, as_of: datetime | None = None, hours: int | None = None, s: Settings = DEFAULTS, column: str = "event_time") -> DataFrame:
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    return df.filter(F.col(column) >= now - F.expr(f"INTERVAL {int(hours or s.drift_window_hours)} HOURS"))


def drift_mean_std(current: DataFrame, reference: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Of two column_statistics: relative change, absolute where the reference is 0;
    a NULL statistic (one row only) counts as no change."""
    def change(c: str) -> Column:
        ref, diff = F.col(f"ref_{c}"), F.abs(F.col(c) - F.col(f"ref_{c}"))
        return F.coalesce(F.when(ref == 0, diff).otherwise(diff / F.abs(F.nullif(ref, F.lit(0.0)))), F.lit(0.0))

    r = reference.select("column_name", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"))
    j = current.join(r, "column_name").withColumns({"mean_change": change("mean"), "std_change": change("std")})
    return j.select("column_name", F.round("mean_change", 4).alias("mean_change"), F.round("std_change", 4).alias("std_change"), ((F.col("mean_change") > s.drift_threshold) | (F.col("std_change") > s.drift_threshold)).alias("drifted"))


def save_reference(df: DataFrame, path: str, version: str, columns: list[str] | None = None) -> None:
    """Adds the statistics of ``df`` to the reference table at ``path`` as ``version``
    (written in a folder of its own, so saving it again replaces it)."""
    column_statistics(df, columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def load_reference(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Statistics of ``version``, by default the last in order of name."""
    t = spark.read.schema("column_name string, mean double, std double, n long, version string").parquet(path)
    if version is not None:
        return t.filter(F.col("version") == version).drop("version")
    last = t.agg(F.max("version").alias("_v"))
    return t.join(F.broadcast(last), F.col("version") == F.col("_v")).drop("version", "_v")


def ks_statistic(a: DataFrame, b: DataFrame, column: str, s: Settings = DEFAULTS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: D, sizes, the asymptotic p-value, the verdict."""
    u = a.select(F.col(column).alias("v"), F.lit(1).alias("i"), F.lit(0).alias("j")).unionByName(b.select(F.col(column).alias("v"), F.lit(0).alias("i"), F.lit(1).alias("j")))
    by = u.filter(F.col("v").isNotNull()).groupBy("v").agg(F.sum("i").alias("na"), F.sum("j").alias("nb"))
    c = running(by, "v", ["na", "nb"])
    sizes = by.agg(F.sum("na").alias("n1"), F.sum("nb").alias("n2"))
    d = c.crossJoin(F.broadcast(sizes)).agg(F.max(F.abs(F.col("cum_na") / F.nullif(F.col("n1"), F.lit(0)) - F.col("cum_nb") / F.nullif(F.col("n2"), F.lit(0)))).alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    enough = (F.col("n1") > 10) & (F.col("n2") > 10)
    return d.withColumn("p", p).select(F.round("d", 6).alias("ks_statistic"), "n1", "n2", F.col("p").alias("p_value"), (enough & (F.col("p") < s.ks_alpha)).alias("drifted"))


def distribution_comparison(df: DataFrame, column: str, as_of: datetime, time: str = "created_at") -> DataFrame:
    """Mean and exact median of the last 7 days against the 23 days before."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    t, now = F.col(time), F.lit(as_of)
    period = F.when(t >= now - F.expr("INTERVAL 7 DAYS"), "current").when(t >= now - F.expr("INTERVAL 30 DAYS"), "baseline")
    rows = df.select(period.alias("period"), F.col(column).alias("v")).filter(F.col("period").isNotNull() & F.col("v").isNotNull())
    median = exact_quantiles(rows, "v", "period", ["current", "baseline"]).select(F.col("period").alias("_p"), "quantile")
    means = rows.groupBy("period").agg(F.round(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))
    return means.join(F.broadcast(median), F.col("period") == F.col("_p")).select("period", "mean", F.round("quantile", 4).alias("median"), "n")
