"""Log lines as a stream: parsed as they come, and counted in windows of time with late lines allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.parsers import Parser
from seqloom.operators.labels import is_anomalous


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files in a folder, line by line."""
    return spark.readStream.text(path)


def parsed_stream(lines: DataFrame, parser: Parser) -> DataFrame:
    """Structured rows without line numbers, which a stream of several files doesn't have."""
    return lines.select(parser.expression(F.col("value")).alias("p")).where("p IS NOT NULL").select("p.*")


def windowed_counts(rows: DataFrame, span: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and anomalous events per window; state of windows that end `late` before the newest line is dropped."""
    timed = rows.where("timestamp_unix_ms IS NOT NULL").withColumn("ts", F.timestamp_millis("timestamp_unix_ms")).withWatermark("ts", late)
    window = F.window("ts", span, step) if step else F.window("ts", span)
    counts = timed.groupBy(window.alias("w")).agg(F.count("*").alias("events"), F.count_if(is_anomalous(F.col("anomalous"))).alias("anomalous"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "anomalous")
