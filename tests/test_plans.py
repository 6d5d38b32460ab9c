"""Datasets from raw logs and experiments from TOML."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqloom.operators.templates import IdentityParser
from seqloom.plans.dataset import CsvLabels, DatasetSpec, preset
from seqloom.plans.experiments import expand, run_sweep
from seqloom.sources.raw import LocalDir


def bgl_line(i, entity, bad):
    return f"{'APPREAD' if bad else '-'} {1117838570 + i} 2005.06.03 {entity} 2005-06-03-15.42.{50 + i}.363779 {entity} RAS KERNEL INFO event kind {'bad' if bad else 'fine'} {i}"


@pytest.fixture
def logs(tmp_path):
    lines = [bgl_line(i, f"R0{i % 3}", i in (3, 4)) for i in range(8)]
    (tmp_path / "tiny.log").write_text("\n".join(lines) + "\nnot a log line\n")
    return tmp_path


def test_build_and_reuse(spark, logs):
    spec = DatasetSpec("tiny").from_source(LocalDir(logs)).parse_with("bgl").template_with(IdentityParser()).with_cache(str(logs / "cache"))
    rows = spec.build(spark).rows
    assert [r["anomalous"] for r in rows.orderBy("line_order").collect()] == [0, 0, 0, 1, 1, 0, 0, 0]
    mark = logs / "cache" / "tiny" / "rows.sha256"
    before = mark.stat().st_mtime_ns
    spec.build(spark)
    assert mark.stat().st_mtime_ns == before
    (logs / "tiny.log").write_text(bgl_line(0, "R00", True) + "\n")
    assert spec.build(spark).rows.count() == 1
    spec.clear_cache()
    assert not (logs / "cache" / "tiny").exists()
    with pytest.raises(ValueError):
        DatasetSpec("tiny").build(spark)


def test_labels_from_a_table(spark, tmp_path):
    (tmp_path / "h.log").write_text("081109 203518 1 INFO a: x blk_1\n081109 203519 1 INFO a: x blk_2\n")
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\n")
    spec = DatasetSpec("h").from_source(LocalDir(tmp_path)).parse_with("hdfs_v1").with_cache(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        spec.build(spark)
    built = spec.label_with(CsvLabels("l.csv", "BlockId", "Label", ("Normal",), ("Anomaly",))).build(spark).group_by_entity().with_split_fractions(0.5, 0.5).build()
    assert [(r["label"], r["split_label"]) for r in built.sequences.orderBy("window_id").collect()] == [(0, "train"), (1, "test")]
    with pytest.raises(KeyError):
        preset("nope")


def test_sweep(spark, logs):
    for name, text in {
        "datasets/tiny": 'dataset_name = "tiny"\nstructured_parser = "bgl"\ntemplate_parser = "identity"\n[source]\ntype = "local_dir"\npath = "."\n[sequence]\ngrouping = "fixed"\nwindow_size = 3\nstep = 2\ntrain_fraction = 0.34\ntest_fraction = 0.25\n',
        "models/tf": 'detector = "template_frequency"\nscore_threshold = 0.3\n',
        "models/key": 'detector = "next_event"\nhistory_size = 1\nmixed_entities = true\n',
    }.items():
        (logs / name).parent.mkdir(exist_ok=True)
        (logs / f"{name}.toml").write_text(text)
    sweep = logs / "sweep.toml"
    sweep.write_text('name = "Tiny run"\ndataset = "tiny"\nmodel = "tf"\n[[axes]]\npath = "sweep.model"\nvalues = ["tf", "key"]\n[[axes]]\npath = "dataset.sequence.train_fraction"\nvalues = [0.34, 0.5]\n')
    runs = expand(sweep, logs / "datasets", logs / "models")
    assert len(runs) == 4 and runs[0].name == "tiny-run-model-tf-train-fraction-0-34"
    folders = run_sweep(spark, sweep, logs, logs / "results", write_predictions=True)
    metrics = json.loads((folders[0] / "metrics.json").read_text())
    assert sum(metrics[k] for k in ("tp", "tn", "fp", "fn")) == 1
    model = json.loads((folders[0] / "model_manifest.json").read_text())
    assert model["detector"] == "template_frequency" and model["model"]["threshold"] == 0.3 and model["sequences"]["test"] == 1
    key = json.loads((folders[2] / "metrics.json").read_text())
    assert key["next_event"]["events"] >= key["next_event"]["eligible"] and "parameter_templates" in json.loads((folders[2] / "model_manifest.json").read_text())["model"]
    labels = json.loads((folders[0] / "dataset_manifest.json").read_text())["labels"]
    assert sorted((x["split_label"], x["n"]) for x in labels) in ([("ignored", 1), ("test", 1), ("train", 1), ("train", 1)], [("ignored", 1), ("test", 1), ("train", 2)])
    stamp = (folders[0] / "metrics.json").stat().st_mtime_ns
    assert run_sweep(spark, sweep, logs, logs / "results") == folders and (folders[0] / "metrics.json").stat().st_mtime_ns == stamp
    bad = logs / "bad.toml"
    bad.write_text('name = "b"\ndataset = "tiny"\nmodel = "tf"\n[[axes]]\npath = "dataset.sequence.grouping"\nvalues = ["spiral"]\n')
    with pytest.raises(ValueError):
        expand(bad, logs / "datasets", logs / "models")


def test_command_line_and_own_detectors(spark, logs, capsys):
    from seqloom.operators import detectors
    from seqloom.plans import experiments

    class Fixed:
        def fit(self, built):
            return self

        def predict(self, built):
            return built.sequences.withColumn("score", F.lit(1.0)).withColumn("predicted_label", F.lit(1))

        def manifest(self):
            return {"kind": "fixed"}

        def metrics(self, built):
            return {"own": 1}

    detectors.register("fixed", lambda settings: Fixed())
    try:
        with pytest.raises(ValueError):
            detectors.register("fixed", lambda settings: Fixed())
        for name, text in {
            "datasets/tiny": 'dataset_name = "tiny"\nstructured_parser = "bgl"\ntemplate_parser = "identity"\n[source]\ntype = "local_dir"\npath = "."\n[sequence]\ngrouping = "fixed"\nwindow_size = 3\n',
            "models/own": 'detector = "fixed"\n',
            "models/key": 'detector = "next_event"\n',
        }.items():
            (logs / name).parent.mkdir(exist_ok=True)
            (logs / f"{name}.toml").write_text(text)
        sweep = logs / "sweep.toml"
        sweep.write_text('name = "own"\ndataset = "tiny"\nmodel = "own"\nmax_workers = "auto"\n[[axes]]\npath = "dataset.sequence.train_fraction"\nvalues = [0.1, 0.2]\n')
        experiments.main([str(sweep), "--results", str(logs / "results")])
        folders = [Path(x) for x in capsys.readouterr().out.split()]
        assert len(folders) == 2 and all(json.loads((f / "metrics.json").read_text())["own"] == 1 for f in folders)
        # sequences of several entities
        sweep.write_text('name = "key"\ndataset = "tiny"\nmodel = "key"\n')
        with pytest.raises(ValueError, match="one entity"):
            experiments.run_sweep(spark, sweep, logs, logs / "results")
    finally:
        del detectors.DETECTORS["fixed"]
    assert experiments.workers("auto", 1) == 1 and experiments.workers(3, 2) == 2
    with pytest.raises(ValueError):
        experiments.workers("many", 2)


def test_changed_parser_of_one_name(spark, logs):
    from seqloom.functions.parsers import python_parser

    spec = DatasetSpec("own").from_source(LocalDir(logs)).template_with(IdentityParser()).with_cache(str(logs / "cache"))
    (logs / "own.log").write_text("a\nb\n")
    first = spec.parse_with(python_parser("mine", lambda line: (1, "e", line, 1))).build(spark).rows
    assert {r["untemplated_message_text"] for r in first.collect()} == {"a", "b"}
    second = spec.parse_with(python_parser("mine", lambda line: (1, "e", line + "!", 1))).build(spark).rows
    assert {r["untemplated_message_text"] for r in second.collect()} == {"a!", "b!"}
