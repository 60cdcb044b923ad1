"""How far rankings, citations and answers agree: set, rank and curve statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def three_way(a: Column, b: Column, c: Column) -> Column:
    union = F.size(F.array_union(F.array_union(a, b), c))
    return F.when(union > 0, F.size(F.array_intersect(F.array_intersect(a, b), c)) / union)


def unique_share(a: Column, b: Column, c: Column) -> Column:
    """Share of ``a`` that neither ``b`` nor ``c`` has."""
    size = F.size(F.array_distinct(a))
    return F.when(size > 0, F.size(F.array_except(F.array_except(a, b), c)) / size)


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Truncated, normalised rank-biased overlap of two lists of distinct items."""
    depth = F.least(F.size(a), F.size(b))
    steps = F.sequence(F.lit(1), depth)

    def part(acc: Column, d: Column) -> Column:
        shared = F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d)))
        w = F.pow(F.lit(p), d - 1)
        return F.struct((acc["num"] + w * shared / d).alias("num"), (acc["den"] + w).alias("den"))

    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    return F.when(depth > 0, F.aggregate(steps, zero, part, lambda x: x["num"] / x["den"])).otherwise(F.lit(0.0))


def kendall_tau(left: DataFrame, right: DataFrame, by: list[str], empty: float | None = None) -> DataFrame:
    """(by, shared, tau) of two rankings (by, id, rank) over the items both hold.

    Ranked lists are cut-offs of fixed depth, so a list's pairs are bounded by
    the square of that depth. Fewer than two shared items give ``empty``.
    """
    both = left.select(*by, "id", F.col("rank").alias("ra")).join(right.select(*by, "id", F.col("rank").alias("rb")), [*by, "id"])
    g = both.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("x"))
    pairs = F.aggregate(
        F.sequence(F.lit(1), F.size("x")),
        F.lit(0).cast("long"),
        lambda acc, i: acc
        + F.aggregate(
            F.slice("x", i + 1, F.size("x")),
            F.lit(0).cast("long"),
            lambda c, y: c + F.signum((y["rb"] - F.element_at("x", i)["rb"]).cast("double")).cast("long"),
        ),
    )
    n = F.size("x")
    tau = F.when(n >= 2, pairs / (n * (n - 1) / 2)).otherwise(F.lit(empty).cast("double"))
    return g.select(*by, n.cast("long").alias("shared"), tau.alias("tau"))


def exclusive_quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, q1, q2, q3) with positions i(n+1)/4, held inside the sample.

    A group's values are one sorted array: meant for statistics over topics.
    """
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"), F.avg(value).alias("mean"))
    n = F.size("v")

    def q(i: int) -> Column:
        at = F.lit(i) * (n + 1)
        j = F.greatest(F.least(F.floor(at / 4), n - 1), F.lit(1)).cast("int")
        delta = at - j * 4
        lo, hi = F.try_element_at("v", j), F.try_element_at("v", j + 1)
        return F.when(n == 1, F.element_at("v", 1)).otherwise((lo * (4 - delta) + hi * delta) / 4)

    return g.select(*by, n.cast("long").alias("n"), "mean", q(1).alias("q1"), q(2).alias("q2"), q(3).alias("q3"))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, median, q1, q3, lo, hi, mean), quartiles interpolated linearly."""
    p = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*by).agg(
        F.count(value).alias("n"), p.alias("p"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean")
    )
    return g.select(*by, "n", F.col("p")[1].alias("median"), F.col("p")[0].alias("q1"), F.col("p")[2].alias("q3"), "lo", "hi", "mean")


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, median): the element at n // 2 of the sorted values."""
    w = W.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    r = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("n", n)
    return r.filter(F.col("_r") == F.floor(F.col("n") / 2)).select(*by, "n", F.col(value).alias("median"))


def kde(df: DataFrame, value: str, *, points: int, hi: float) -> DataFrame:
    """(x, density) on a grid from 0 to ``hi``: Gaussian kernel, Silverman width, mirrored at 0.

    Each value is added to all grid points inside its row's task, so what is
    shuffled are ``points`` partial sums per task.
    """
    s = df.agg(
        F.count(value).alias("n"),
        F.stddev_samp(value).alias("sd"),
        (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"),
    )
    width = F.lit(0.9) * F.least("sd", F.col("iqr") / 1.349) * F.pow("n", F.lit(-0.2))
    s = s.select("n", width.alias("h"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (hi / (points - 1)))).alias("x")
    j = counted.join(F.broadcast(s)).select("v", "c", "n", "h", grid)
    k = lambda d: F.exp(-(d * d) / 2)
    dens = F.sum(F.col("c") * (k((F.col("x") - F.col("v")) / F.col("h")) + k((F.col("x") + F.col("v")) / F.col("h"))))
    return j.groupBy("x").agg((dens / (F.first("n") * F.first("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def language_mix(run: DataFrame, languages: DataFrame, cuts: list[int]) -> DataFrame:
    """(cut, lang, n, share, topics): languages among the first ``cut`` documents of each topic.

    run: topic_id, doc_id, rank; languages: doc_id, lang. ``topics`` counts the
    topics whose run is at least that deep.
    """
    r = run.join(languages, "doc_id", "left").withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    n = r.filter("rank <= cut").groupBy("cut", "lang").agg(F.count(F.lit(1)).alias("n"))
    depth = r.groupBy("cut", "topic_id").agg(F.max("rank").alias("d")).groupBy("cut").agg(
        F.count_if(F.col("d") >= F.col("cut")).alias("topics")
    )
    share = F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("cut")), 6)
    return n.withColumn("share", share).join(depth, "cut")
