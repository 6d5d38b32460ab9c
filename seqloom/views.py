"""The `events` table as a structured log, and other tables in the roles of logs and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured rows: an entity is a user on a day; large errors are anomalous. With template and params columns."""
    ts = F.col("ts").cast("timestamp")
    cents = F.floor(F.col("value") * 100).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("_cents", cents)
    return rows.select(
        F.floor(F.unix_micros(ts) / F.lit(1000)).cast("long").alias("timestamp_unix_ms"),
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format(ts, "yyyy-MM-dd")).alias("entity_id"),
        F.concat_ws(" ", "event_type", F.col("_cents").cast("string"), "props").alias("untemplated_message_text"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 20), 1).otherwise(0).cast("long").alias("anomalous"),
        F.col("event_id").alias("line_order"),
        F.col("event_type").alias("template"),
        F.array(F.col("_cents").cast("string"), F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.regexp_extract("props", r"(\d+)", 1))).alias("params"),
    )


def no_labels(rows: DataFrame) -> DataFrame:
    """An empty label table."""
    return rows.where(F.lit(False)).select("entity_id", F.col("anomalous").alias("label"))
