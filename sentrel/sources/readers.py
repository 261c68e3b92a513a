"""Batch and streaming sources, JSON decoding, rejects, synthetic transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sentrel.config import BRANCHES, GOVERNORATES, PAYMENT_METHODS
from sentrel.schemas import TRANSACTION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Needs Spark's Kafka connector on the class path; value is a string column."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def text_source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Folder of JSON-lines files as a stream of raw lines."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def rate_source(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Endless synthetic transactions, encoded as JSON lines."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(*synthetic_columns(F.col("value"), F.col("timestamp"))).select(encode_json())


def parse_json(raw: DataFrame, schema: T.StructType = TRANSACTION, column: str = "value") -> DataFrame:
    """Decode ``column``; malformed input gives NULL fields. The raw text stays in ``raw_value``."""
    parsed = raw.select(F.col(column).cast("string").alias("raw_value"), F.from_json(F.col(column).cast("string"), schema).alias("d"))
    return parsed.select("d.*", "raw_value")


def with_event_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """``event_time`` from ISO text; unreadable text gives NULL instead of an error."""
    return df.withColumn("event_time", F.try_to_timestamp(F.col(column)))


def encode_json(columns: tuple[str, ...] = tuple(TRANSACTION.names)) -> Column:
    return F.to_json(F.struct(*columns)).alias("value")


def synthetic_columns(row: Column, now: Column, seed: int = 42) -> list[Column]:
    """The eight transaction fields from a row number, by MD5 sums: reruns agree whatever
    the partitioning or engine. A tenth of the events is stamped 12 minutes late."""

    def u(k: int) -> Column:  # uniform in [0, 1): 40 bits of a sum
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), row.cast("string"))), 1, 10), 16, 10).cast("bigint") / F.lit(float(1 << 40))

    def pick(values: tuple[str, ...], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(u(k) * len(values)) + 1).cast("int"))

    amount = F.floor(u(1) * 1_499_000 + 1000) / 100
    late = F.when(u(7) < 0.1, F.expr("INTERVAL 12 MINUTES")).otherwise(F.expr("INTERVAL 0 MINUTES"))
    return [
        F.concat(F.lit("txn-"), F.sha2(F.concat_ws(":", F.lit(str(seed)), row.cast("string")), 256).substr(1, 32)).alias("transaction_id"),
        F.date_format(now - late, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
        F.concat(F.lit("USER_"), (F.floor(u(2) * 9000) + 1000).cast("string")).alias("user_id"),
        amount.alias("amount_tnd"),
        pick(GOVERNORATES, 3).alias("governorate"),
        pick(PAYMENT_METHODS, 4).alias("payment_method"),
        pick(BRANCHES, 5).alias("branch_id"),
        ((amount > 10000) | (u(6) < 0.05)).alias("fraud_seed"),
    ]


def synthetic_from(df: DataFrame, row: str, now: str, seed: int = 42) -> DataFrame:
    """One synthetic transaction for each row of ``df``, from its number and time."""
    return df.select(*synthetic_columns(F.col(row), F.col(now), seed))


def synthetic_transactions(spark: SparkSession, n: int, start: str = "2024-01-01 00:00:00", seed: int = 42) -> DataFrame:
    """``n`` events, one a second from ``start``."""
    now = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("id"))
    return synthetic_from(spark.range(n).withColumn("now", now), "id", "now", seed)


def mock_training_set(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Window features with a rule label, for bootstrapping a first model."""
    def u(k: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    rows = spark.range(n).select(
        (F.floor(u(1) * 10) + 1).alias("v_count"), (F.floor(u(2) * 3) + 1).alias("g_dist"), (u(3) * 9900 + 100).alias("avg_amount")
    )
    smurf = F.col("avg_amount").between(1400, 1500)
    return rows.select(
        "*",
        smurf.cast("int").alias("is_smurfing"),
        (F.col("v_count") > 5).cast("int").alias("high_velocity_flag"),
        ((F.col("v_count") > 5) | (F.col("g_dist") > 1) | (smurf & (F.col("v_count") > 3))).cast("int").alias("label"),
    )
