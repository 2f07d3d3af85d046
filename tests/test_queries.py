"""Every query with SQL against DuckDB, on the driver's smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as plans

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not SF.exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(plans.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(plans.FIXTURES))
def test_fixture_has_its_known_rows(spark, duck, name):
    got = plans.FIXTURES[name](spark, str(SF)).toPandas()
    if name in plans.FIXTURE_SQL:
        want = duck.execute(plans.FIXTURE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    if not SF.exists():
        pytest.skip("no driver tables here")
    assert plans.QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    if SF.exists():
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
