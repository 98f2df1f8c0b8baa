"""Every registered query against its SQL, on the smallest data folder."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tests.conftest import DATA

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return v.item() if hasattr(v, "item") else v


def _table(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    out = [tuple(_plain(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return list(df.columns), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    columns, got = _table(QUERIES[name](spark, DATA).toPandas())
    expected_columns, expected = _table(duck.execute(ORACLE[name]).df())
    assert columns == expected_columns
    assert got == expected


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "WeeklyReturn_1W" in df.columns


def test_all_operators_are_covered():
    """Every operator id of the inventory is run by a query or named in the list of unit-tested ones."""
    covered = {c for q in QUERIES.values() for c in getattr(q, "covers", ())}
    unit_tested = {"A4", "A5", "A6", "A10"}  # files and databases the data folder does not hold
    wanted = {f"{a}{i}" for a, n in (("A", 11), ("B", 14), ("C", 16), ("D", 17), ("E", 21), ("F", 9), ("G", 6), ("H", 26), ("I", 6),
                                     ("J", 27), ("K", 4), ("M", 5), ("P", 22)) for i in range(1, n + 1)}
    assert wanted - covered - unit_tested == set()
