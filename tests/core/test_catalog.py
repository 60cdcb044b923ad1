"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import pytest

from lakewright import catalog

SF = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in catalog.ORACLES:
        assert mine
        return
    rel = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.ORACLES[name]})")
    assert sorted(tuple(plain(v) for v in r) for r in rel.fetchall()) == mine
