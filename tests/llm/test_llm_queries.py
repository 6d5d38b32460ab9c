"""Queries that SQL can express against their SQL, and two more contracts."""

import zlib

import duckdb
import pytest

from seqloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    rows = QUERIES[name](spark, sf_dir)
    found = con.sql(ORACLES[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert sorted(rows.columns) == sorted(found.columns)
    assert sorted(repr([r[c] for c in sorted(rows.columns)]) for r in rows.collect()) == sorted(repr([r[i] for i in order]) for r in found.fetchall())


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op5_quality_ftrl"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    ranks = sorted(rows, key=lambda r: r["score"])
    place = [i for i, r in enumerate(ranks) if r["quality"] == 1]
    bad = len(ranks) - len(place)
    auc = (sum(place) - len(place) * (len(place) - 1) / 2) / (len(place) * bad)
    assert auc > 0.9
    assert sum(r["predicted"] for r in rows if r["quality"] == 1) / len(place) > 0.98
