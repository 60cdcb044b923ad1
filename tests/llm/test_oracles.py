import pytest

from lakewright.llm import queries


def plain(v):
    return f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    theirs = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert mine == sorted(tuple(plain(v) for v in r) for r in theirs)
