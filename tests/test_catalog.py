"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from ledgerlens import catalog, operators  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    names = sorted(ours.columns)
    theirs = duck.execute(catalog.ORACLES[name])
    assert sorted(c[0] for c in theirs.description) == names
    at = [[c[0] for c in theirs.description].index(x) for x in names]
    expected = sorted(tuple(shown(r[i]) for i in at) for r in theirs.fetchall())
    got = sorted(tuple(shown(r[x]) for x in names) for r in ours.collect())
    assert got == expected
