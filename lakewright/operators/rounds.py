"""Round-indexed series: novelty, saturation, growth carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def novelty(bank: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, round, novelty): nuggets that first appeared in each round, true zeros between included."""
    n = bank.groupBy(by, F.col("origin_round").alias("round")).agg(F.count(F.lit(1)).alias("novelty"))
    spine = n.groupBy(by).agg(F.max("round").alias("_m")).select(
        by, F.explode(F.sequence(F.lit(0), F.col("_m").cast("int"))).alias("round")
    )
    return spine.join(n, [by, "round"], "left").withColumn("novelty", F.coalesce("novelty", F.lit(0).cast("long")))


def saturation(series: DataFrame, *, min_new: int = 1, streak: int = 2, by: str = "topic_id") -> DataFrame:
    """``series`` (by, round, novelty) with ``saturated``: the last ``streak`` rounds all brought ``min_new`` or fewer."""
    w = W.partitionBy(by).orderBy("round").rowsBetween(-(streak - 1), 0)
    return series.withColumn(
        "saturated", (F.count(F.lit(1)).over(w) == streak) & (F.max("novelty").over(w) <= min_new)
    )


def carry_forward(sizes: DataFrame, horizon: int, by: str = "topic_id") -> DataFrame:
    """(by, round, size) for every round to ``horizon``, the last known size kept; ``gap`` marks filled rounds."""
    spine = sizes.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("round"))
    w = W.partitionBy(by).orderBy("round").rowsBetween(W.unboundedPreceding, 0)
    j = spine.join(sizes, [by, "round"], "left").withColumn("gap", F.col("size").isNull())
    return j.withColumn("size", F.last("size", ignorenulls=True).over(w))


def growth(sizes: DataFrame, by: str = "topic_id") -> DataFrame:
    """``sizes`` with the change from the round before and whether it shrank."""
    w = W.partitionBy(by).orderBy("round")
    return sizes.withColumn("change", F.col("size") - F.lag("size").over(w)).withColumn(
        "shrank", F.coalesce(F.col("change") < 0, F.lit(False))
    )
