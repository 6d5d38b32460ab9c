"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.storage import shared_dir

#: White space as tokenizer patterns have it, for a character class; Python's own also has U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents table, a null text as the empty one."""
    return table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame, free: bool = True) -> DataFrame:
    """df computed once and written to the shared folder, so that a lost executor loses none of it.

    With `free`, shuffle files of the jobs so far are removed if nothing refers to them any more.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    del df
    if free:
        gc.collect()
        sc._jvm.System.gc()
    return out


#: What operators remember in this Python worker from task to task: the operator's module and a function that forgets it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remember(module: str, forget: Callable[[], None]) -> None:
    """From now on tasks of other modules call `forget` before they begin."""
    _REMEMBERED[module] = forget


def forget_others(module: str) -> None:
    """Frees what other operators remember here. Spark hands a worker from stage to stage, and a stage of several Python steps leaves more workers than cores, so all of them would hold it for good."""
    for other in [m for m in _REMEMBERED if m != module]:
        _REMEMBERED.pop(other)()


def in_batches(df: DataFrame, run, schema, rows: int = 1000) -> DataFrame:
    """df.mapInArrow(run, schema) on batches of `rows` rows at most. Texts are long: the default of 10,000 rows a batch is held several times over, in the JVM and in Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    module = run.__module__

    def task(batches):
        forget_others(module)
        yield from run(batches)

    return df.mapInArrow(task, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """A dict that makes missing values and forgets all of them when it holds too many."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(dict):
    """A Memo of at most `limit` values that forgets those that weren't asked for lately: half of them are new, the others are of the half before and move over when they are asked for."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.before = make, max(1, limit // 2), {}

    def __missing__(self, key):
        if (value := self.before.pop(key, None)) is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value
