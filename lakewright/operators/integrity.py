"""Digests, set equality, counters and liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_digest(rows: DataFrame, id_: str, by: list[str]) -> DataFrame:
    """(by, n, digest): sha256 over the sorted ids, each ended by a line feed.

    A group's ids are one string in one task; for sets past memory compare
    ``partition_digests`` instead.
    """
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(id_).cast("string"))).alias("ids"))
    text = F.concat(F.array_join("ids", "\n"), F.lit("\n"))
    return g.select(*by, F.size("ids").cast("long").alias("n"), F.sha2(text.cast("binary"), 256).alias("digest"))


def partition_digests(rows: DataFrame, id_: str, by: list[str], buckets: int = 1024) -> DataFrame:
    """``set_digest`` per hash bucket of the id: equal sets have equal buckets, at any size."""
    b = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_).cast("string")), F.lit(buckets)).cast("int"))
    return set_digest(b, id_, [*by, "bucket"])


def set_difference(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """(id, side) of ids that only one side holds, and (id, ``twice``) of ids that a side repeats."""
    n = lambda df, name: df.groupBy(F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias(name))
    j = n(left, "l").join(n(right, "r"), "id", "full")
    side = (
        F.when(F.col("r").isNull(), "left only")
        .when(F.col("l").isNull(), "right only")
        .when((F.col("l") > 1) | (F.col("r") > 1), "twice")
    )
    return j.select("id", side.alias("side")).filter("side is not null")


def counters(metrics: DataFrame) -> DataFrame:
    """Sums of (metric, slices map, value) per metric and slice map; null values count as 0."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("slices"))))
    return metrics.groupBy("metric", key.alias("slice_key")).agg(
        F.round(F.sum(F.coalesce("value", F.lit(0.0))), 6).alias("total"), F.count(F.lit(1)).alias("n")
    )


def finite_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which a number is not finite."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.coalesce(bad, F.lit(False)))


def stale_leases(beats: DataFrame, now: Column, max_age_s: float, by: str = "owner") -> DataFrame:
    """(by, last_beat, age_s, stale) of heartbeats (by, ts)."""
    g = beats.groupBy(by).agg(F.max("ts").alias("last_beat"))
    age = now.cast("timestamp").cast("double") - F.col("last_beat").cast("timestamp").cast("double")
    return g.withColumn("age_s", F.round(age, 3)).withColumn("stale", age > max_age_s)


def first_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; later writers lose."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def hash_sample(rows: DataFrame, by: list[str], id_: str, k: int, seed: str) -> DataFrame:
    """The k rows of each group with the smallest keyed md5 of their id: a seeded sample."""
    order = F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")).cast("binary"))
    w = W.partitionBy(*by).orderBy(order, id_)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def first_mismatch(left: DataFrame, right: DataFrame, by: list[str], ordinal: str, value: str) -> DataFrame:
    """(by, ordinal): the first place where two sequences (by, ordinal, value) differ or one ends.

    Sequences that are the same give no row; nulls are equal.
    """
    a = left.select(*by, ordinal, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*by, ordinal, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, [*by, ordinal], "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) & F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.filter(~same).groupBy(*by).agg(F.min(ordinal).alias(ordinal))
