"""Reciprocal rank fusion, collapsing to documents, reranking the head."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Damping of reciprocal ranks.
K = 60


def rrf(pools: DataFrame, *, k: int = K, by: str = "query_id") -> DataFrame:
    """(by, id, score, rank) of pools (by, pool, id, rank).

    Contributions are added in the order of ``pool``, so equal inputs give
    equal doubles whatever the partitioning. The number of pools per id is
    bounded by the pools of a query.
    """
    parts = pools.select(by, "id", F.struct("pool", (F.lit(1.0) / (k + F.col("rank"))).alias("c")).alias("p"))
    g = parts.groupBy(by, "id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    fused = g.select(by, "id", F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["c"]).alias("score"))
    w = W.partitionBy(by).orderBy(F.col("score").desc(), F.col("id").asc())
    return fused.withColumn("rank", F.row_number().over(w))


def max_passage(scored: DataFrame, doc: Column, *, by: str = "query_id") -> DataFrame:
    """(by, doc_id, score): the best passage of each document."""
    return scored.groupBy(by, doc.alias("doc_id")).agg(F.max("score").alias("score"))


def rerank_head(fused: DataFrame, score: Callable[[DataFrame], DataFrame], *, depth: int, top_k: int, by: str = "query_id") -> DataFrame:
    """Fused rows with the first ``depth`` reordered by ``score`` and the rest behind them.

    ``score`` maps the head rows to the same rows with ``rerank`` (larger is
    better). Returns by, id, score, rank; the tail keeps its fused scores.
    """
    head = score(fused.filter(F.col("rank") <= depth)).select(by, "id", F.col("rerank").alias("score"), F.lit(0).alias("tail"), F.col("rank").alias("at"))
    tail = fused.filter(F.col("rank") > depth).select(by, "id", "score", F.lit(1).alias("tail"), F.col("rank").alias("at"))
    order = W.partitionBy(by).orderBy(
        "tail", F.when(F.col("tail") == 0, -F.col("score")).asc_nulls_last(), F.when(F.col("tail") == 0, F.col("id")), "at"
    )
    both = head.unionByName(tail).withColumn("rank", F.row_number().over(order))
    return both.filter(F.col("rank") <= top_k).select(by, "id", "score", "rank")


def overlap_score(query_words: Column, text_words: Column) -> Column:
    """Stand-in for a cross-encoder: log of the smoothed share of query words in the text."""
    q = F.array_distinct(query_words)
    return F.log((F.size(F.array_intersect(q, text_words)) + 0.5) / (F.size(q) + 1))


def candidate_depth(top_k: int, rerank_depth: int) -> int:
    """How many hits each pool must give: enough for the answer and for the reranker, one at least."""
    return max(top_k, rerank_depth, 1)
