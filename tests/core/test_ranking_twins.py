"""Rankings against their SQL on rows that the shared tables may lack: halves of a cent, a document of key 0."""

import datetime

import __spark_entry__
import duckdb


def _tables(spark, at, prices, lines):
    """orders (key, customer, price) and lineitem (order, line, part, quantity) as tables under ``at``."""
    day = datetime.datetime(1995, 1, 1)
    spark.createDataFrame([(k, c, p, day, "F") for k, c, p in prices], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderstatus string").write.parquet(f"{at}/orders.parquet")
    rows = [(o, n, p, 7, q, 0.0, "A", "F") for o, n, p, q in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")


def _both(spark, at, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    out = __spark_entry__.queries()[name](spark, str(at))
    cols = ", ".join(out.columns)
    want = con.sql(f"select {cols} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, out.collect())), sorted(want)


def test_trec_rows_round_half_cents_as_sql_does(spark, tmp_path):
    prices = [(k, k, p) for k, p in enumerate([979.5, 984.5, 992.5, 32072.5, 260375.5, 1000.5, 75462.67])]
    _tables(spark, tmp_path, prices, [(k, 1, 3 * k + 3, 10.0) for k, _, _ in prices])
    got, want = _both(spark, tmp_path, "trec_rows")
    assert got == want and len(got) == len(prices)


def test_run_violations_with_a_document_of_key_zero(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 3, 100.0), (2, 7, 100.0)], [(1, n, p, q) for n, p, q in [(1, 5, 40.0), (2, 7, 30.0), (3, 0, 2.0), (4, 8, 1.0)]] + [(2, 1, 4, 9.0)])
    got, want = _both(spark, tmp_path, "run_violations")
    assert got == want and len(got) == 2
