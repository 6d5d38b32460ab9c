"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    got = sorted(repr([shown(r[c]) for c in sorted(rows.columns)]) for r in rows.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.sql(ORACLES[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert sorted(rows.columns) == sorted(found.columns)
    assert got == sorted(repr([shown(r[i]) for i in order]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
