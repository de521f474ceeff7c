"""Each core query against its SQL, on the smallest tables, and the entry."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bizmatch.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return v if v is None or isinstance(v, (str, int)) else round(float(v), 5)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in ORACLE_SQL:
        rel = sql.sql(ORACLE_SQL[name])
        names = list(rel.columns)
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    else:
        assert got


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source1_entity_id", "matched_entity_ids"]
