"""Ordered-partition operators: islands, as-of lookup, fixed-size parts, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``island``: the number of the run of equal ``value`` in order, from 0."""
    w = W.partitionBy(*by).orderBy(*order)
    turn = (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).cast("int")
    return rows.withColumn("_t", turn).withColumn("island", F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_t")


def split_runs(isles: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, runs) of values whose rows do not stand together."""
    return isles.groupBy(*by, value).agg(F.count_distinct("island").alias("runs")).filter("runs > 1")


def as_of(left: DataFrame, right: DataFrame, *, by: str, at: str, start: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row (by, start, value) not after ``at``.

    One union and one window, so each key is sorted once and nothing is joined.
    Equal times see the right row; equal starts the largest value.
    """
    cols = left.columns
    l = left.select(*[F.col(c) for c in cols], F.col(at).alias("_o"), F.lit(1).alias("_s"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(
        *[(F.col(by) if c == by else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols],
        F.col(start).alias("_o"),
        F.lit(0).alias("_s"),
        F.col(value).alias("_v"),
    )
    w = W.partitionBy(by).orderBy("_o", "_s", "_v").rowsBetween(W.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return out.filter("_s = 1").select(*cols, value)


def parts(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with ``ordinal`` (dense from 0), ``part`` (ordinal // size) and its place in it."""
    w = W.partitionBy(*by).orderBy(*order)
    r = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    return r.withColumn("part", F.floor(F.col("ordinal") / size).cast("int")).withColumn("place", F.col("ordinal") % size)


def part_violations(dealt: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, part, n): parts missing from 0..N-1, or short though not the last."""
    n = dealt.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by)
    n = n.withColumn("_last", F.max("part").over(w)).withColumn("_at", F.row_number().over(w.orderBy("part")) - 1)
    return n.filter((F.col("_at") != F.col("part")) | ((F.col("n") != size) & (F.col("part") < F.col("_last")))).select(*by, "part", "n")


def running(value: Column, by: list[str], order: list[str]) -> Column:
    return F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def interpolate(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with nulls of ``value`` filled on the line between their neighbours in ``order``."""
    back = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    r = rows.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    slope = (F.col("_b.y") - F.col("_a.y")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    line = F.col("_a.y") + slope * (F.col(order).cast("double") - F.col("_a.x"))
    return r.withColumn("filled", F.coalesce(F.col(value).cast("double"), line)).drop("_a", "_b")


def run_starts(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, value, ordinal): where each run of equal ``value`` begins, by its place from 0; nulls are equal."""
    w = W.partitionBy(*by).orderBy(*order)
    at = (F.row_number().over(w) - 1).cast("long")
    turn = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("ordinal", at).withColumn("_turn", turn).filter("_turn").select(*by, value, "ordinal")


def slices(rows: DataFrame, by: list[str], order: list[str], width: int) -> DataFrame:
    """``rows`` with ``slice``: ``width`` contiguous slices of sizes that differ by one at most.

    Slice i of n rows takes the places from floor(i n / width) up to the next
    slice's first; with fewer rows than slices some slices are empty.
    """
    w = W.partitionBy(*by).orderBy(*order)
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    number = F.expr(f"((_at * {width}L + _n - 1) div _n) - 1")
    return rows.withColumn("_at", F.row_number().over(w)).withColumn("_n", n).withColumn("slice", number).drop("_at", "_n")
