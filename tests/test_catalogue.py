"""Every query of the library that has SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from globeframe.plans import catalogue

TABLES = "/root/testdata/sf0.001"


def _text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(int(value)) if isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, TABLES)
    expected = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(_text(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted(tuple(_text(r[names.index(c)]) for c in sorted(names)) for r in expected.fetchall())
    assert got == want
