"""Rankings: support and rerank of one pass, in partitions whose size the tables don't change."""

from lakewright.operators import evidence
from lakewright.plans.spread import PART_BYTES, parts_of
from pyspark.sql import functions as F


def test_partitions_grow_with_the_tables(spark):
    few, many = spark.range(PART_BYTES), spark.range(10 * PART_BYTES)
    assert parts_of(few) == 8 and parts_of(many) == 80 and parts_of(few, many) == 88
    assert parts_of(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_support_and_rerank_of_one_pass_are_those_of_two(spark):
    rows = [(t, i % 5, i % 3, i % 4, i / 64, i % 7 == 0, None if i % 3 else i / 32, 0.5) for t in (1, 2) for i in range(60)]
    o = spark.createDataFrame(rows, "topic_id long, nugget_id long, passage_id long, doc_id long, score double, cited boolean, citation double, weight double")
    one = evidence.support_and_rerank(o)
    two = evidence.document_support(o.select("topic_id", "doc_id", F.col("citation").alias("score"), "weight")).join(evidence.rerank_evidence(o), ["topic_id", "doc_id"])
    rounded = lambda df: sorted(map(tuple, df.select("topic_id", "doc_id", "total", "unscored", F.round("rerank", 9)).collect()))
    assert rounded(one) == rounded(two) and len(rounded(one)) == 8
    assert str(one._jdf.queryExecution().optimizedPlan().toString()).count("Aggregate") == 2
