"""Anomaly labels: inline in the rows, or from a table of entities.

0 and null are normal or unknown, any other number is anomalous. Whether a log has inline labels is asked
of the value 1 alone, so a log whose only labels are 2 counts as unlabelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_anomalous(label: Column) -> Column:
    return F.coalesce(label, F.lit(0)) != 0


def has_inline_labels(rows: DataFrame) -> bool:
    return rows.agg(F.coalesce(F.bool_or(F.col("anomalous") == 1), F.lit(False))).first()[0]


def inline_line_labels(rows: DataFrame) -> DataFrame:
    """line_order and label of anomalous rows."""
    return rows.where(is_anomalous(F.col("anomalous"))).select("line_order", F.col("anomalous").alias("label"))


def with_line_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `anomalous` from a table of labels (line_order, label) where it has their line; the table may be large: Spark chooses the join."""
    found = labels.groupBy("line_order").agg(F.max("label").alias("_label"))
    return rows.join(found, "line_order", "left").withColumn("anomalous", F.coalesce(F.col("_label").cast("long"), "anomalous")).select(*rows.columns)


def inline_group_labels(rows: DataFrame) -> DataFrame:
    """entity_id and the label of its first anomalous row."""
    marked = rows.where(is_anomalous(F.col("anomalous")) & F.col("entity_id").isNotNull())
    return marked.groupBy("entity_id").agg(F.min_by("anomalous", "line_order").alias("label"))


def mapped_labels(rows: DataFrame, entity: str, label: str, order: str, normal: tuple[str, ...] = ("0", "normal"), anomalous: tuple[str, ...] = ("1", "anomaly", "anomalous")) -> DataFrame:
    """Labels from text: trimmed, in lower case, by the given words or else as a whole number; other rows are skipped and an entity's last row holds."""
    text = F.lower(F.trim(F.col(label).cast("string")))
    number = F.expr("try_cast(_text AS BIGINT)")
    value = F.when(F.col("_text").isin(*normal), F.lit(0).cast("long")).when(F.col("_text").isin(*anomalous), F.lit(1).cast("long")).otherwise(number)
    found = rows.select(F.trim(F.col(entity).cast("string")).alias("entity_id"), text.alias("_text"), F.col(order).alias("_order")).withColumn("label", value)
    return found.where("label IS NOT NULL AND entity_id IS NOT NULL").groupBy("entity_id").agg(F.max_by("label", "_order").alias("label"))


def count_entities_by_label(rows: DataFrame, group_labels: DataFrame) -> DataFrame:
    """normal_entities and total_entities over entities that aren't null."""
    entities = rows.where("entity_id IS NOT NULL").select("entity_id").distinct().join(group_labels, "entity_id", "left")
    return entities.agg(F.count_if(~is_anomalous(F.col("label"))).alias("normal_entities"), F.count("*").alias("total_entities"))
