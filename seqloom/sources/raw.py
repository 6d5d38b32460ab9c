"""Raw log files: local folders, zip archives, archives on the web; and their lines with numbers."""

from __future__ import annotations

import hashlib
import shutil
import time
import urllib.request
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds before the second, third and fourth try of a download.
RETRY_AFTER = (2, 5, 15)


class Source(Protocol):
    def materialise(self, dst: Path) -> Path: ...

    def raw_logs_path(self, dataset_name: str, root: Path) -> Path: ...


def log_path(relative: str | None, dataset_name: str, root: Path) -> Path:
    """The one log file below root: <dataset>.log, or a relative path that stays below it."""
    name = relative or f"{dataset_name}.log"
    path = (root / name).resolve()
    if Path(name).is_absolute() or not path.is_relative_to(root.resolve()):
        raise ValueError(f"the log's path must be relative and stay below the source: {name}")
    if not path.exists():
        raise FileNotFoundError(path)
    if path.is_dir():
        raise IsADirectoryError(path)
    return path


def verify_md5(path: Path, expected: str) -> None:
    digest = hashlib.md5()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    if digest.hexdigest() != expected.lower():
        raise ValueError(f"MD5 of {path} is {digest.hexdigest()}, not {expected}")


def extract_zip(path: Path, dst: Path) -> None:
    """All members, after their checksums were found right and none leaves dst."""
    with zipfile.ZipFile(path) as z:
        if (bad := z.testzip()) is not None:
            raise zipfile.BadZipFile(f"{path}: checksum of {bad} is wrong")
        for name in z.namelist():
            if not (dst / name).resolve().is_relative_to(dst.resolve()):
                raise ValueError(f"{path}: {name} would be written outside {dst}")
        dst.mkdir(parents=True, exist_ok=True)
        z.extractall(dst)


@dataclass(frozen=True)
class LocalDir:
    path: Path
    raw_logs_relpath: str | None = None

    def materialise(self, dst: Path) -> Path:
        root = Path(self.path)
        if not root.exists():
            raise FileNotFoundError(root)
        if not root.is_dir():
            raise NotADirectoryError(root)
        return root

    def raw_logs_path(self, dataset_name: str, root: Path) -> Path:
        return log_path(self.raw_logs_relpath, dataset_name, root)


@dataclass(frozen=True)
class LocalZip:
    path: Path
    raw_logs_relpath: str | None = None
    md5: str | None = None

    def materialise(self, dst: Path) -> Path:
        if dst.exists() and any(dst.iterdir()):
            return dst
        if not Path(self.path).exists():
            raise FileNotFoundError(self.path)
        if self.md5:
            verify_md5(Path(self.path), self.md5)
        extract_zip(Path(self.path), dst)
        return dst

    def raw_logs_path(self, dataset_name: str, root: Path) -> Path:
        return log_path(self.raw_logs_relpath, dataset_name, root)


def fetch(url: str, to: Path) -> None:
    with urllib.request.urlopen(url, timeout=60) as answer, to.open("wb") as f:  # noqa: S310
        shutil.copyfileobj(answer, f)


@dataclass(frozen=True)
class RemoteZip:
    """An archive on the web, fetched again after 2, 5 and 15 seconds when that fails."""

    url: str
    md5: str | None = None
    raw_logs_relpath: str | None = None
    fetcher: Callable[[str, Path], None] = fetch
    wait: Callable[[float], None] = time.sleep

    def __post_init__(self):
        if urlparse(self.url).scheme not in ("http", "https"):
            raise ValueError(f"only http and https: {self.url}")

    def materialise(self, dst: Path) -> Path:
        if dst.exists():
            return dst
        archive = dst.with_name(dst.name + ".zip")
        archive.parent.mkdir(parents=True, exist_ok=True)
        for delay in (*RETRY_AFTER, None):
            try:
                self.fetcher(self.url, archive)
                break
            except OSError:
                if delay is None:
                    raise
                self.wait(delay)
        try:
            if self.md5:
                verify_md5(archive, self.md5)
            extract_zip(archive, dst)
        finally:
            archive.unlink(missing_ok=True)
        return dst

    def raw_logs_path(self, dataset_name: str, root: Path) -> Path:
        return log_path(self.raw_logs_relpath, dataset_name, root)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_order (from 0, without gaps) and value of the lines of one file, in any number of tasks.

    Partitions of one file stand in its order; their sizes, one row each, give the first number of each. A folder or pattern of
    several files has no such order: an error (see numbered_files).
    """
    if len(files := spark.read.text(path).inputFiles()) != 1:
        raise ValueError(f"{path}: lines are numbered in one file, not in {len(files)}")
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    # the lower 33 bits of the id are the row's place in its partition
    lines = lines.withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
    sizes = lines.groupBy("_p").agg((F.max("_at") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as the scan has partitions
    offsets = F.broadcast(sizes.select("_p", before.alias("_first")))
    text = F.regexp_replace("value", r"[\r\n]+$", "")
    return lines.join(offsets, "_p").select((F.col("_first") + F.col("_at")).alias("line_order"), text.alias("value"))


def numbered_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of several files one after another, in the order given."""
    out, first = None, 0
    for path in paths:
        own = numbered_lines(spark, path)
        size = own.count()
        own = own.withColumn("line_order", F.col("line_order") + first)
        out, first = own if out is None else out.unionByName(own), first + size
    if out is None:
        raise ValueError("no files")
    return out
