"""From a raw log to templated, labelled rows.

`DatasetSpec` says what to build; each step returns a changed copy. `build` parses the log once into the
Parquet store and keeps it: a fingerprint of the log's content and of the parser's code stands beside the rows, and rows
are parsed again only if that differs or the output isn't complete.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import logging
import shutil
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.parsers import Parser, parser
from seqloom.operators.labels import has_inline_labels, inline_group_labels
from seqloom.operators.sequences import EntitySequences, FixedWindows, TimeWindows
from seqloom.operators.templates import DrainParser, TemplateParser
from seqloom.sources.raw import RemoteZip, Source, numbered_lines
from seqloom.sources.store import StructuredStore, csv_labels, first_row_example


logger = logging.getLogger(__name__)
#: Lines of a block of the digest's tree, and blocks of a group.
BLOCK = 100_000


class LabelReader(Protocol):
    """What a dataset takes to label its entities."""

    def load(self, spark: SparkSession, root: Path) -> DataFrame:
        """entity_id and label; root is the folder of the raw log."""


@dataclass(frozen=True)
class CsvLabels:
    """A label table beside the log; words that mean normal and anomalous, other labels are numbers."""

    path: str
    entity: str = "entity_id"
    label: str = "anomalous"
    normal: tuple[str, ...] = ("0", "normal")
    anomalous: tuple[str, ...] = ("1", "anomaly", "anomalous")

    def load(self, spark: SparkSession, root: Path) -> DataFrame:
        return csv_labels(spark, str(root / self.path), self.entity, self.label, normal=tuple(x.casefold() for x in self.normal), anomalous=tuple(x.casefold() for x in self.anomalous))


@dataclass(frozen=True)
class Templated:
    """Structured rows with template and params, and the labels of entities."""

    rows: DataFrame
    group_labels: DataFrame

    def group_by_entity(self, **options) -> EntitySequences:
        return EntitySequences(self.rows, self.group_labels, **options)

    def group_by_fixed_window(self, size: int, step: int | None = None, **options) -> FixedWindows:
        return FixedWindows(self.rows, self.group_labels, size=size, step=step, **options)

    def group_by_time_window(self, span_ms: int, step_ms: int | None = None, **options) -> TimeWindows:
        return TimeWindows(self.rows, self.group_labels, span=span_ms, step=step_ms, **options)


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    source: Source | None = None
    parser: Parser | None = None
    labels: LabelReader | None = None
    templates: TemplateParser = field(default_factory=DrainParser)
    cache: str = "cache"

    def from_source(self, source: Source) -> DatasetSpec:
        return replace(self, source=source)

    def parse_with(self, own: Parser | str) -> DatasetSpec:
        return replace(self, parser=parser(own) if isinstance(own, str) else own)

    def label_with(self, labels: LabelReader) -> DatasetSpec:
        return replace(self, labels=labels)

    def template_with(self, templates: TemplateParser) -> DatasetSpec:
        return replace(self, templates=templates)

    def with_cache(self, path: str) -> DatasetSpec:
        return replace(self, cache=path)

    @property
    def root(self) -> Path:
        return Path(self.cache) / self.name

    def clear_cache(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)

    def fingerprint(self, spark: SparkSession, log: Path) -> str:
        """What the rows are made of: the log's content and the parser's code. A file's name and times don't matter."""
        return stable_hash({"log": content_digest(spark, str(log)), "parser": self.parser.name, "code": self.parser.code})

    def build(self, spark: SparkSession) -> Templated:
        """An error where there is no source or parser, or where neither inline labels nor a label table exist."""
        if self.source is None or self.parser is None:
            raise ValueError(f"dataset {self.name!r} needs a source and a parser")
        self.root.mkdir(parents=True, exist_ok=True)
        with locked(self.root / ".lock"):
            raw = self.source.materialise(self.root / "raw")
            log = self.source.raw_logs_path(self.name, raw)
            store, mark, wanted = StructuredStore(str(self.root / "rows")), self.root / "rows.sha256", self.fingerprint(spark, log)
            if not (mark.exists() and mark.read_text() == wanted and (self.root / "rows" / "_SUCCESS").exists()):
                mark.unlink(missing_ok=True)
                store.write(self.parser.parse(numbered_lines(spark, str(log))))
                mark.write_text(wanted)
        rows = store.read(spark)
        example = first_row_example(rows).first()
        logger.info("dataset %s begins with line %s: %r", self.name, example["line_order"], example["untemplated_message_text"])
        # inline labels, where there are any, come before a label table
        if has_inline_labels(rows):
            labels = inline_group_labels(rows)
        elif self.labels is not None:
            labels = self.labels.load(spark, raw)
        else:
            raise ValueError(f"dataset {self.name!r} has no inline labels and no label table")
        return Templated(self.templates.fit(rows).transform(rows), labels)


@contextmanager
def locked(path: Path):
    """One build of a dataset at a time."""
    with path.open("w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def content_digest(spark: SparkSession, path: str, block: int = BLOCK) -> str:
    """A digest of a text file's lines and their order, as a tree: tasks read ranges of bytes and hash the lines of each block with their numbers, the blocks' hashes are hashed by their groups, and the driver hashes what is left, a row for each group of groups."""
    lines = numbered_lines(spark, path)
    tree = lines.groupBy(F.floor(F.col("line_order") / block).alias("at")).agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "line_order", "value")).alias(f"h{k}") for k in (1, 2)))
    tree = tree.groupBy(F.floor(F.col("at") / block).alias("at")).agg(F.sum("n").alias("n"), *(F.bit_xor(F.xxhash64("at", "n", f"h{k}")).alias(f"h{k}") for k in (1, 2)))
    top = [tuple(r) for r in tree.orderBy("at").collect()]  # one row for block * block lines
    return stable_hash(top)


def stable_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


#: Public log collections; addresses and checksums are fixed values.
PRESETS = {
    "bgl": DatasetSpec("BGL", RemoteZip("https://zenodo.org/records/8196385/files/BGL.zip", "4452953c470f2d95fcb32d5f6e733f7a", "BGL.log"), parser("bgl")),
    "hdfs_v1": DatasetSpec(
        "HDFS_V1",
        RemoteZip("https://zenodo.org/records/8196385/files/HDFS_v1.zip", "76a24b4d9a6164d543fb275f89773260", "HDFS.log"),
        parser("hdfs_v1"),
        CsvLabels("preprocessed/anomaly_label.csv", "BlockId", "Label", ("Normal",), ("Anomaly",)),
    ),
}


def preset(name: str) -> DatasetSpec:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; known: {', '.join(sorted(PRESETS))}")
    return PRESETS[name]
