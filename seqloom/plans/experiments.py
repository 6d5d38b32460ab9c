"""Experiments from TOML files: a dataset, a way of grouping, a detector, and axes of settings to go through.

A sweep names a dataset file and a model file; each axis has a dotted path (sweep.model, dataset.sequence.x,
model.x) and values. Runs are the product of the axes. Results go to a folder named by a hash of the whole
resolved configuration, so a run that is there already is left alone.

    python -m seqloom.plans.experiments sweep.toml --configs configs --results results [--workers 4] [--force] [--write-predictions]
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import platform
import re
import tomllib
from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy
from dataclasses import dataclass
from itertools import product
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.functions.parsers import parser
from seqloom.operators.detectors import detector
from seqloom.operators.metrics import label_histograms, run_metrics
from seqloom.operators.sequences import SequenceBuilder, entity_ids, split_summary, validate_fractions
from seqloom.operators.templates import template_parser
from seqloom.plans.dataset import CsvLabels, DatasetSpec, Templated, preset, stable_hash
from seqloom.schemas import IGNORED, TEST, TRAIN
from seqloom.session import session
from seqloom.sources.raw import LocalDir, LocalZip, RemoteZip

log = logging.getLogger(__name__)
SPLITS = (TRAIN, IGNORED, TEST)
GROUPINGS = {"entity": set(), "fixed": {"window_size"}, "time": {"time_span_ms"}}


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


@dataclass(frozen=True)
class Run:
    name: str
    dataset: dict
    model: dict
    labels: dict

    @property
    def config(self) -> dict:
        return {"name": self.name, "dataset": self.dataset, "model": self.model, "axes": self.labels}

    @property
    def fingerprint(self) -> str:
        return stable_hash(self.config)


def read_toml(path: Path) -> dict:
    with path.open("rb") as f:
        return tomllib.load(f)


def load_named(folder: Path, name: str) -> dict:
    path = folder / f"{name}.toml"
    if not path.exists():
        raise FileNotFoundError(f"{path}: no configuration of that name")
    return read_toml(path)


def override(config: dict, path: list[str], value) -> None:
    for key in path[:-1]:
        config = config.setdefault(key, {})
    config[path[-1]] = value


def validated(dataset: dict) -> dict:
    s = dataset.get("sequence", {})
    grouping = s.get("grouping", "entity")
    if grouping not in GROUPINGS:
        raise ValueError(f"unknown grouping {grouping!r}")
    if missing := GROUPINGS[grouping] - s.keys():
        raise ValueError(f"grouping {grouping!r} needs {', '.join(sorted(missing))}")
    if s.get("train_on_normal_entities_only") and grouping != "entity":
        raise ValueError("only entities can be trained on normal ones alone")
    validate_fractions(s.get("train_fraction", 0.2), s.get("test_fraction", 0.8))
    return dataset


def expand(sweep_path: Path, datasets: Path, models: Path) -> list[Run]:
    """All runs of a sweep."""
    sweep = read_toml(sweep_path)
    axes = sweep.get("axes", [])
    runs = []
    for values in product(*(a["values"] for a in axes)):
        names, changes = {"dataset": sweep["dataset"], "model": sweep["model"]}, []
        for path, value in [*sweep.get("overrides", {}).items(), *((a["path"], v) for a, v in zip(axes, values))]:
            root, *rest = path.split(".")
            if root == "sweep" and rest and rest[0] in names:
                names[rest[0]] = value
            elif root in names and rest:
                changes.append((root, rest, value))
            else:
                raise ValueError(f"no setting of that path: {path}")
        config = {"dataset": deepcopy(load_named(datasets, names["dataset"])), "model": deepcopy(load_named(models, names["model"]))}
        for root, rest, value in changes:
            override(config[root], rest, value)
        labels = {a["path"]: v for a, v in zip(axes, values)}
        name = "-".join([slug(sweep["name"]), *(slug(f"{k.split('.')[-1]}-{v}") for k, v in labels.items())])
        runs.append(Run(name, validated(config["dataset"]), config["model"], labels))
    return runs


SOURCES = {"local_dir": LocalDir, "local_zip": LocalZip, "remote_zip": RemoteZip}


def dataset_spec(config: dict, base: Path, cache: str) -> DatasetSpec:
    if "preset" in config:
        spec = preset(config["preset"])
    else:
        own = dict(config["source"])
        kind = own.pop("type")
        if "path" in own:
            own["path"] = base / own["path"]
        spec = DatasetSpec(config["dataset_name"], SOURCES[kind](**own), parser(config["structured_parser"]))
    if "template_parser" in config:
        spec = spec.template_with(template_parser(config["template_parser"]))
    if "label_reader" in config:
        own = dict(config["label_reader"])
        own.pop("type", None)
        spec = spec.label_with(CsvLabels(own["relative_path"], own.get("entity_column", "entity_id"), own.get("label_column", "anomalous"), *(tuple([own[k]]) for k in ("normal_value", "anomalous_value") if k in own)))
    return spec.with_cache(cache)


def builder_of(templated: Templated, s: dict) -> SequenceBuilder:
    fractions = {"train_fraction": s.get("train_fraction", 0.2), "test_fraction": s.get("test_fraction", 0.8)}
    grouping = s.get("grouping", "entity")
    if grouping == "fixed":
        return templated.group_by_fixed_window(s["window_size"], s.get("step"), **fractions)
    if grouping == "time":
        return templated.group_by_time_window(s["time_span_ms"], s.get("step"), **fractions)
    return templated.group_by_entity(train_on_normal_entities_only=s.get("train_on_normal_entities_only", False), **fractions)


def write_json(path: Path, value) -> None:
    path.write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def run_one(spark: SparkSession, run: Run, base: Path, results: Path, *, force: bool = False, write_predictions: bool = False) -> Path:
    """Runs an experiment and writes config, manifest, metrics and environment; returns its folder."""
    folder = results / f"{run.name}-{run.fingerprint[:12]}"
    if (folder / "metrics.json").exists() and not force:
        return folder
    own = detector(run.model)
    folder.mkdir(parents=True, exist_ok=True)
    log.info("%s: building sequences", run.name)
    templated = dataset_spec(run.dataset, base, str(results / "cache")).build(spark)
    builder = builder_of(templated, run.dataset.get("sequence", {}))
    built = builder.build()
    log.info("%s: fitting %s", run.name, run.model["detector"])
    fitted = own.fit(built)
    predictions = fitted.predict(built)
    metrics = run_metrics(predictions).first().asDict() | fitted.metrics(built)
    labels = [r.asDict() for r in label_histograms(built.sequences).orderBy("split_label", "label").collect()]
    write_json(folder / "config.json", run.config)
    write_json(folder / "dataset_manifest.json", {"fingerprint": run.fingerprint, "split": split_summary(built, builder).first().asDict(), "labels": labels})
    counts = {split: sum(x["n"] for x in labels if x["split_label"] == split) for split in SPLITS}
    write_json(folder / "model_manifest.json", {"detector": run.model["detector"], "sequences": counts, "labels": labels, "model": fitted.manifest()})
    write_json(folder / "environment.json", {"python": platform.python_version(), "spark": pyspark.__version__, "machine": platform.platform()})
    if write_predictions:
        rows = predictions.where(F.col("split_label") == TEST).join(entity_ids(built.members), "window_id", "left")
        rows = rows.withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>"))).withColumn("events", F.col("event_count"))
        # in order within files and from file to file
        rows.repartitionByRange("window_id").sortWithinPartitions("window_id").write.mode("overwrite").json(str(folder / "predictions"))
    log.info("%s: done", run.name)
    # last, as its presence says that the run is complete
    write_json(folder / "metrics.json", metrics)
    return folder


def workers(wanted: int | str, runs: int) -> int:
    """How many runs are under way at a time; "auto": all, up to the machine's cores."""
    if wanted == "auto":
        return max(1, min(runs, os.cpu_count() or 1))
    if not isinstance(wanted, int) or wanted < 1:
        raise ValueError(f"max_workers must be a positive number or 'auto': {wanted!r}")
    return min(wanted, max(1, runs))


def run_sweep(spark: SparkSession, sweep: Path, configs: Path, results: Path, *, max_workers: int | str | None = None, **options) -> list[Path]:
    """All runs of a sweep, `max_workers` (else the sweep's own, else one) at a time in one session: Spark spreads the jobs of each over the cluster."""
    runs = expand(sweep, configs / "datasets", configs / "models")
    if not runs:
        raise ValueError(f"{sweep}: no runs")
    own = read_toml(sweep).get("max_workers", 1) if max_workers is None else max_workers
    with ThreadPoolExecutor(workers(own, len(runs))) as pool:
        return list(pool.map(lambda r: run_one(spark, r, sweep.parent, results, **options), runs))


def main(arguments: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="seqloom.plans.experiments", description="Runs the experiments of a sweep.")
    options.add_argument("sweep", type=Path)
    options.add_argument("--configs", type=Path, help="folder of datasets/ and models/ (default: that of the sweep)")
    options.add_argument("--results", type=Path, default=Path("results"))
    options.add_argument("--workers", type=lambda x: x if x == "auto" else int(x))
    options.add_argument("--force", action="store_true", help="run again what is there")
    options.add_argument("--write-predictions", action="store_true")
    given = options.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    for folder in run_sweep(session("experiments"), given.sweep, given.configs or given.sweep.parent, given.results, max_workers=given.workers, force=given.force, write_predictions=given.write_predictions):
        print(folder)


if __name__ == "__main__":
    main()
