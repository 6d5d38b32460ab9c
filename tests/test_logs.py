"""Parsers, masks, phrases, templates, sources, the store and labels."""

import re
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from seqloom.functions.parsers import parser, python_parser
from seqloom.functions.text import masked, numeric, phrases, tokens
from seqloom.operators import labels as L
from seqloom.operators.templates import DrainParser, IdentityParser, template_parser
from seqloom.sources.raw import LocalDir, LocalZip, RemoteZip, log_path, numbered_files, numbered_lines, verify_md5
from seqloom.sources.store import StoreConfig, StructuredStore, csv_labels


def parse(spark, name, lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "line_order long, value string")
    return parser(name).parse(frame).orderBy("line_order").collect()


def test_hdfs(spark):
    rows = parse(spark, "hdfs_v1", ["081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1608999687919862906 src: /10.250.19.102:54106", "081109 203518 143 INFO dfs.FSNamesystem:  nothing here ", "junk", "", "081399 203518 143 WARN a: b", "700101 000000 1 INFO c: "])
    assert [r["line_order"] for r in rows] == [0, 1, 4, 5]
    assert rows[0]["timestamp_unix_ms"] == int(datetime(2008, 11, 9, 20, 35, 18, tzinfo=UTC).timestamp() * 1000)
    assert [r["entity_id"] for r in rows] == ["blk_-1608999687919862906", "dfs.FSNamesystem", "a", "c"]
    assert rows[1]["untemplated_message_text"] == "INFO dfs.FSNamesystem: nothing here"
    assert rows[2]["timestamp_unix_ms"] is None and rows[2]["anomalous"] is None
    assert rows[3]["timestamp_unix_ms"] == 0


def test_bgl(spark):
    head = "1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 "
    rows = parse(spark, "bgl", ["- " + head + "RAS KERNEL INFO cache parity", "APPREAD " + head + "RAS APP FATAL read failed", "- 1117838570 2005.06.03 X 2005-99-03-15.42.50.363779 X RAS KERNEL INFO", "- 1117838570 2005.06.03 X 2005-06-03-15.42.50.1234567 X RAS KERNEL INFO", head + "RAS KERNEL", "1117838570 2005.06.03 X 2005-06-03-15.42.50.363779 X RAS KERNEL INFO"])
    assert [(r["line_order"], r["anomalous"]) for r in rows] == [(0, 0), (1, 1), (2, 0), (3, 0), (5, 1)]
    assert rows[0]["timestamp_unix_ms"] == 1117813370363
    assert rows[2]["timestamp_unix_ms"] == rows[3]["timestamp_unix_ms"] == 1117838570000
    assert rows[0]["untemplated_message_text"] == "RAS KERNEL INFO cache parity"


def test_own_parser_and_unknown_names(spark):
    own = python_parser("own", lambda line: (1, "e", line.upper(), None) if line else None)
    frame = spark.createDataFrame([(0, "a"), (1, "")], "line_order long, value string")
    assert [tuple(r) for r in own.parse(frame).collect()] == [(1, "e", "A", None, 0)]
    with pytest.raises(KeyError):
        parser("nope")
    with pytest.raises(KeyError):
        template_parser("nope")


def test_phrases(spark):
    rows = spark.createDataFrame([("Node failed block 42",), ("Disk warning",), ("Node_A-42/failure",), ("",), (" -- ",)], "t string")
    out = [r[0] for r in rows.select(phrases(F.col("t"))).collect()]
    assert out[0] == ["node failed block 42", "node", "failed", "block", "42", "node failed", "failed block", "block 42"]
    assert len(out[0]) + len(out[1]) == 12 and out[1].count("disk warning") == 2
    assert out[3] == [] and out[4] == ["--"]
    assert rows.select(tokens(F.col("t"))).collect()[2][0] == ["node", "a", "42", "failure"]


def test_masks_and_numbers(spark):
    text = ["took 12 ms", "10.0.0.1:80 -7 0xFF", "x12 1a2", 'executed cmd "ls -l" 3', "٣ x", "aa:bb:cc:dd up"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(masked(F.col("t"))).collect()]
    assert out == ["took <:NUM:> ms", "<:IP:>:<:NUM:> <:NUM:> <:HEX:>", "x12 1a2", "executed cmd <:CMD:> <:NUM:>", "<:NUM:> x", "<:MAC:> up"]
    values = ["1", " 2.5 ", "1e3", "nan", "inf", "1d", "x", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(numeric(F.col("t"))).collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, None, None, None, None]


def test_drain_and_identity(spark, tmp_path):
    messages = ["connect to 10.0.0.1 port 80", "connect to 10.0.0.2 port 443", "connect from host_a done", "connect from host_b done", "bye"]
    rows = spark.createDataFrame(list(enumerate(messages)), "line_order long, untemplated_message_text string")
    model = DrainParser().fit(rows)
    out = {r["line_order"]: r for r in model.transform(rows).collect()}
    assert out[0]["template"] == out[1]["template"] == "connect to <:IP:> port <:NUM:>"
    assert out[2]["template"] == out[3]["template"] == "connect from host <:*:> done" and out[3]["params"] == ["b"]
    unseen = spark.createDataFrame([(9, "never seen before at all")], "line_order long, untemplated_message_text string")
    assert model.transform(unseen).first()["template"] is None
    model.save(str(tmp_path / "m"))
    same = IdentityParser().fit(rows).transform(rows)
    assert same.where("template <> untemplated_message_text OR size(params) > 0").isEmpty()


def test_numbered_lines(spark, tmp_path):
    one, two = tmp_path / "one.log", tmp_path / "two.log"
    one.write_bytes("".join(f"line {i}\n" for i in range(5000)).encode() + b"bad \xff byte\n")
    two.write_text("x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    rows = numbered_lines(spark, str(one)).orderBy("line_order").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line_order"] for r in rows] == list(range(5001))
    assert all(r["value"] == f"line {r['line_order']}" for r in rows[:5000])
    both = numbered_files(spark, [str(two), str(one)]).orderBy("line_order").limit(3).collect()
    assert [r["value"] for r in both] == ["x", "y", "line 0"]


def test_store(spark, tmp_path):
    rows = [(100, "node-a", "first", 0, 0), (None, None, "", None, 1), (120, "node-b", "b", 2, 2)]
    frame = spark.createDataFrame(rows, "timestamp_unix_ms long, entity_id string, untemplated_message_text string, anomalous long, line_order long")
    store = StructuredStore(str(tmp_path / "s"), StoreConfig(4, 2))
    # a label of 2 is anomalous, but doesn't count as a sign of inline labels
    assert store.write(frame) is False
    assert store.count_rows(spark) == 3 and store.timestamp_bounds(spark) == (100, 120)
    assert sorted(map(tuple, store.read(spark).collect()), key=lambda r: r[4]) == rows
    assert [r[0] for r in store.read(spark, ["line_order", "line_order"], F.col("entity_id") == "node-a").collect()] == [0]
    with pytest.raises(ValueError):
        store.write(frame.limit(0))


def test_labels(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("BlockId,Label\n a ,Normal\nb, ANOMALY \nc,nope\nd,2\na,Anomaly\n")
    got = {r["entity_id"]: r["label"] for r in csv_labels(spark, str(path), "BlockId", "Label").collect()}
    assert got == {"a": 1, "b": 1, "d": 2}
    with pytest.raises(ValueError):
        csv_labels(spark, str(path))
    rows = spark.createDataFrame([(0, 100, "node-b", "b0", 0), (1, 120, "node-a", "a1", 0), (2, 140, "node-a", "a2", 1), (3, 150, "node-a", "a3", 5)], "line_order long, timestamp_unix_ms long, entity_id string, t string, anomalous long")
    labels = L.inline_group_labels(rows)
    assert [tuple(r) for r in labels.collect()] == [("node-a", 1)]
    assert tuple(L.count_entities_by_label(rows, labels).first()) == (1, 2)
    assert L.has_inline_labels(rows) and not L.has_inline_labels(rows.where("line_order < 2"))


def test_sources(tmp_path):
    root = tmp_path / "d"
    root.mkdir()
    (root / "x.log").write_text("a\n")
    assert LocalDir(root).raw_logs_path("x", LocalDir(root).materialise(tmp_path)) == (root / "x.log").resolve()
    for bad, error in (("../x.log", ValueError), ("/x.log", ValueError), ("y.log", FileNotFoundError), (".", IsADirectoryError)):
        with pytest.raises(error):
            log_path(bad, "x", root)
    with pytest.raises(FileNotFoundError):
        LocalDir(tmp_path / "no").materialise(tmp_path)
    archive = tmp_path / "x.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("x.log", "a\n")
    out = LocalZip(archive).materialise(tmp_path / "out")
    assert (out / "x.log").read_text() == "a\n"
    with pytest.raises(ValueError):
        verify_md5(archive, "0" * 32)
    waits, tries = [], []

    def fetcher(url, to):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("no route")
        to.write_bytes(archive.read_bytes())

    got = RemoteZip("https://example.org/x.zip", fetcher=fetcher, wait=waits.append).materialise(tmp_path / "far")
    assert (got / "x.log").exists() and waits == [2, 5] and not (tmp_path / "far.zip").exists()
    with pytest.raises(ValueError):
        RemoteZip("ftp://example.org/x.zip")


def test_stream(spark, tmp_path):
    from seqloom.streaming.logs import line_stream, parsed_stream, windowed_counts

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"081109 2035{i:02d} 1 INFO a: b\n" for i in range(10)) + "junk\n081109 203605 1 INFO a: c\n")
    counts = windowed_counts(parsed_stream(line_stream(spark, str(folder)), parser("hdfs_v1")), "1 minute")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["events"] for r in spark.table("counts").collect()) == [1, 10]


def test_java_patterns_are_the_python_ones():
    from seqloom.functions.parsers import BGL, HDFS

    assert re.match(HDFS, "081109 203518 143 INFO a: b").group(5) == "a"
    assert re.match(BGL, "- 1 2005.06.03 X 2005-06-03-15.42.50.1 X A B C d").group(7) == "A B C d"


def test_lines_of_several_files_are_not_numbered_as_one(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("x\ny\n")
    with pytest.raises(ValueError, match="one file"):
        numbered_lines(spark, str(tmp_path))


def test_writer_settings_show_in_footers(spark, tmp_path):
    import pyarrow.parquet as pq

    frame = spark.range(1000).selectExpr("id * 10 AS timestamp_unix_ms", "concat('e', id % 3) AS entity_id", "'text' AS untemplated_message_text", "0L AS anomalous", "id AS line_order")
    store = StructuredStore(str(tmp_path / "s"), StoreConfig(buckets=2, rows_per_file=300, rows_per_group=70, partitions=3))
    store.write(frame)
    files = list((tmp_path / "s").rglob("*.parquet"))
    found = [pq.read_metadata(f) for f in files]
    assert sum(m.num_rows for m in found) == 1000 and max(m.num_rows for m in found) <= 300
    groups = [m.row_group(k).num_rows for m in found for k in range(m.num_row_groups)]
    assert max(groups) <= 70 and len(groups) > len(files)
    assert len({f.name.split("-")[1] for f in files}) <= 3
    assert store.count_rows(spark) == 1000
    for bad in ({"buckets": 0}, {"rows_per_group": 0}, {"partitions": 0}):
        with pytest.raises(ValueError, match="positive"):
            StoreConfig(**bad)


def test_code_of_closures_and_defaults():
    from seqloom.functions.parsers import code_of

    def made(mark, limit=1):
        def parse(line, size=limit, *, kind="x"):
            return line.startswith(mark) and size

        return parse

    def nested(inner):
        return lambda line: inner(line)

    same = code_of(made("a"))
    assert same == code_of(made("a")) and same != code_of(made("b")) and same != code_of(made("a", 2))
    assert code_of(nested(made("a"))) == code_of(nested(made("a"))) != code_of(nested(made("b")))

    def again(n):
        return again(n - 1) if n else 0

    assert code_of(again) == code_of(again)


def test_content_digest(spark, tmp_path):
    from seqloom.plans.dataset import content_digest

    one, two = tmp_path / "one.log", tmp_path / "two.log"
    one.write_text("".join(f"line {i}\n" for i in range(300)))
    two.write_bytes(one.read_bytes())
    first = content_digest(spark, str(one))
    assert first == content_digest(spark, str(two)) == content_digest(spark, str(one)) != content_digest(spark, str(one), 7)
    import os

    times = os.stat(one)
    one.write_text(one.read_text().replace("line 7\n", "line 9\n"))  # as long, and as old
    os.utime(one, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert os.stat(one).st_size == times.st_size and content_digest(spark, str(one)) != first
    lines = two.read_text().splitlines(keepends=True)
    two.write_text("".join(reversed(lines)))
    assert content_digest(spark, str(two)) != first


def test_representation_of_ones_own_streams_a_long_sequence(spark):
    from seqloom.operators import representations

    class Gaps:
        """Counts batches and the largest one, to see how a sequence comes."""

        columns = ("template",)

        def start(self):
            return (0, 0, 0)

        def step(self, state, events):
            return state[0] + events.num_rows, state[1] + 1, max(state[2], events.num_rows)

        def finish(self, state):
            return zip(("events", "batches", "largest"), state)

    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 7L ELSE id % 5 END AS window_id", "id AS pos", "concat('t', id % 3) AS template").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        representations.register("gaps", Gaps)
        found = {(r["window_id"], r["feature"]): r["cnt"] for r in representations.represented(rows, "gaps").collect()}
        assert found[7, "events"] == 4000 and found[7, "batches"] >= 40 and found[7, "largest"] <= 100 and found[0, "events"] == 200
        moves = {(r["window_id"], r["feature"]): r["cnt"] for r in representations.represented(rows, "transitions").collect()}
        assert moves[7, "t0 > t1"] == 1333 and sum(v for (w, _), v in moves.items() if w == 7) == 3999
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        representations.REPRESENTATIONS.pop("gaps", None)
    with pytest.raises(ValueError, match="already"):
        representations.register("transitions", Gaps)
    with pytest.raises(KeyError, match="unknown"):
        representations.represented(rows, "none")
