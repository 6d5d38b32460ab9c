"""Columns of structured log rows and of what is made of them."""

from __future__ import annotations

from pyspark.sql import types as T

#: A parsed log line. line_order is the physical line's number from 0; lines that don't parse leave gaps.
STRUCTURED = T.StructType(
    [
        T.StructField("timestamp_unix_ms", T.LongType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("untemplated_message_text", T.StringType(), False),
        T.StructField("anomalous", T.LongType()),
        T.StructField("line_order", T.LongType(), False),
    ]
)
#: At rest: entities are dealt into buckets.
STORED = T.StructType([*STRUCTURED.fields, T.StructField("entity_bucket", T.IntegerType())])

TRAIN, IGNORED, TEST = "train", "ignored", "test"
EVENT = "struct<template:string,params:array<string>,dt_prev_ms:bigint>"
