"""How the shared tables play the parts of the evidence model.

Evidence: a customer is a topic, an order a nugget, a line an answer that
cites a part; the supplier is the passage the answer was read in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.spread import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of documents, lines stripped of blanks."""
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return d.withColumn("line", F.trim("line"))


def nuggets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("topic_id"),
        F.col("o_orderkey").alias("nugget_id"),
        # As SQL rounds: the product, so that halves go by its double and not by its decimal digits.
        (F.round(F.col("o_totalprice") / 1e6 * 1e6) / 1e6).alias("weight"),
        (F.year("o_orderdate") - 1992).alias("origin_round"),
        F.col("o_orderstatus").alias("status"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("nugget_id"),
        F.col("l_linenumber").alias("answer_index"),
        F.col("l_partkey").alias("doc_id"),
        F.col("l_suppkey").alias("passage_id"),
        F.round((1 - F.col("l_discount")) * F.col("l_quantity") / 50, 6).alias("score"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
    )


#: The same two views in SQL.
EVIDENCE = """
nuggets AS (SELECT o_custkey AS topic_id, o_orderkey AS nugget_id, round(o_totalprice / 1e6, 6) AS weight,
  year(o_orderdate) - 1992 AS origin_round, o_orderstatus AS status FROM orders),
answers AS (SELECT l_orderkey AS nugget_id, l_linenumber AS answer_index, l_partkey AS doc_id, l_suppkey AS passage_id,
  round((1 - l_discount) * l_quantity / 50, 6) AS score, l_returnflag AS flag, l_linestatus AS line_status FROM lineitem)"""
