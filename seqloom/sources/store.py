"""Structured rows as Parquet, dealt into entity buckets; and labels from CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.labels import has_inline_labels, mapped_labels
from seqloom.schemas import STORED, STRUCTURED


@dataclass(frozen=True)
class StoreConfig:
    """buckets: entity buckets; rows_per_file and rows_per_group: rows of a file and of a row group within it at most; partitions: tasks that write, null for the session's number.
    Rows come to a task's writer in the order of buckets, so it has one file open at a time."""

    buckets: int = 32
    rows_per_file: int = 5_000_000
    rows_per_group: int = 256_000
    partitions: int | None = None

    def __post_init__(self):
        for name in ("buckets", "rows_per_file", "rows_per_group"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.partitions is not None and self.partitions <= 0:
            raise ValueError("partitions must be positive")

    def options(self) -> dict[str, str]:
        """Options of the Parquet writer. It looks at a group's size every so many rows, so groups end at that number exactly."""
        rows = str(self.rows_per_group)
        return {"maxRecordsPerFile": str(self.rows_per_file), "parquet.block.row.count.limit": rows, "parquet.page.row.count.limit": str(min(self.rows_per_group, 20_000))}


def bucket(entity: Column, buckets: int) -> Column:
    """Physical only: no result depends on it. Null for a null entity."""
    return F.when(entity.isNotNull(), F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int"))


@dataclass(frozen=True)
class StructuredStore:
    path: str
    config: StoreConfig = StoreConfig()

    def write(self, rows: DataFrame) -> bool:
        """Replaces what is there; an error where no row was parsed. Returns whether there are inline labels.

        Rows of a bucket are spread over several tasks by line, so that one entity may hold most rows.
        """
        if rows.isEmpty():
            raise ValueError("no line could be parsed")
        marked = rows.withColumn("entity_bucket", bucket(F.col("entity_id"), self.config.buckets))
        spread = F.floor(F.col("line_order") / F.lit(self.config.rows_per_file))
        keys = (F.col("entity_bucket"), spread)
        dealt = marked.repartition(*keys) if self.config.partitions is None else marked.repartition(self.config.partitions, *keys)
        # in this order a task has one bucket's file open at a time
        dealt.sortWithinPartitions("entity_bucket", "line_order").write.mode("overwrite").options(**self.config.options()).partitionBy("entity_bucket").parquet(self.path)
        return has_inline_labels(self.read(rows.sparkSession))

    def read(self, spark: SparkSession, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """Rows with the defaults of missing values; the filter and the columns reach the scan."""
        rows = spark.read.schema(STORED).parquet(self.path)
        if where is not None:
            rows = rows.where(where)
        rows = rows.withColumns({"line_order": F.coalesce("line_order", F.lit(0).cast("long")), "untemplated_message_text": F.coalesce("untemplated_message_text", F.lit(""))})
        return rows.select(*(dict.fromkeys(columns) if columns else STRUCTURED.fieldNames()))

    def count_rows(self, spark: SparkSession) -> int:
        return spark.read.schema(STORED).parquet(self.path).count()

    def timestamp_bounds(self, spark: SparkSession) -> tuple[int | None, int | None]:
        row = timestamp_bounds(self.read(spark)).first()
        return row["min_ts"], row["max_ts"]


def first_row_example(rows: DataFrame) -> DataFrame:
    """line_order and text of the first line."""
    return rows.select("line_order", "untemplated_message_text").orderBy("line_order").limit(1)


def timestamp_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("timestamp_unix_ms").alias("min_ts"), F.max("timestamp_unix_ms").alias("max_ts"))


def csv_labels(spark: SparkSession, path: str, entity: str = "entity_id", label: str = "anomalous", **words) -> DataFrame:
    """entity_id and label of a CSV file with a header."""
    rows = spark.read.option("header", True).csv(path)
    if missing := {entity, label} - set(rows.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return mapped_labels(rows.withColumn("_row", F.monotonically_increasing_id()), entity, label, "_row", **words)
