"""What a reader is shown, and what can be said about a quote that misses."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that count as one another: dashes, single and double quotation marks.
ALIKE = (r"[\p{Pd}\u2212]", r"['\u2018-\u201B\u2039\u203A]", r"[\"\u201C-\u201F\u00AB\u00BB]")


def within_budget(hits: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """``hits`` (by, rank, text) with ``shown``: whole texts in rank order, those that don't fit passed over.

    Later, shorter texts may still fit, so this is a fold over a query's ranked
    list, whose length is its cut-off.
    """
    row = F.struct("rank", F.length("text").alias("n"))
    lists = hits.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("l"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["ranks"], F.array(x["rank"]))).otherwise(acc["ranks"]).alias("ranks"),
        )

    zero = F.struct(F.lit(0).alias("used"), F.lit([]).cast("array<int>").alias("ranks"))
    kept = lists.select(by, F.aggregate("l", zero, step)["ranks"].alias("_ranks"))
    return hits.join(kept, by).withColumn("shown", F.array_contains("_ranks", F.col("rank"))).drop("_ranks")


def passage_block(shown: DataFrame, rendering: str, by: str = "query_id") -> DataFrame:
    """(by, block): the shown passages (by, rank, id, text, shown) as one labelled text."""
    order = W.partitionBy(by).orderBy("rank")
    s = shown.filter("shown").withColumn("k", F.row_number().over(order))
    piece = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] passage_id="), F.col("id").cast("string"), F.lit("\n"), "text")
    g = s.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", piece.alias("p")))).alias("ps"))
    left = shown.groupBy(by).agg(F.count_if(~F.col("shown")).alias("left"))
    head = F.concat(F.lit("PASSAGES ("), F.size("ps").cast("string"), F.lit(f", rendering={rendering}):"))
    tail = F.when(F.col("left") > 0, F.array(F.concat(F.lit("("), F.col("left").cast("string"), F.lit(" more did not fit)")))).otherwise(F.array())
    block = F.array_join(F.concat(F.array(head), F.transform("ps", lambda x: x["p"]), tail), "\n\n")
    return left.join(g, by, "left").select(by, F.when(F.col("ps").isNull(), "PASSAGES: none.").otherwise(block).alias("block"))


def quote_pattern(span: str) -> regex.Pattern | None:
    """What a span's words look like whatever the case, the white space and the typography; None without words."""

    def like(c: str) -> str:
        kind = next((k for k in ALIKE if regex.fullmatch(k, c)), None)
        return kind or regex.escape(c)

    words = unicodedata.normalize("NFC", span).split()
    pattern = r"\s+".join("".join(map(like, w)) for w in words)
    return regex.compile(pattern, regex.V1 | regex.IGNORECASE | regex.FULLCASE) if words else None


def closest_quote(span: str, text: str, most: int = 300) -> str | None:
    """The text's own characters for a span that differs in case, typography or white space only; ``most`` of them."""
    pattern = quote_pattern(span)
    found = pattern and pattern.search(unicodedata.normalize("NFC", text))
    if not found:
        return None
    return found[0] if len(found[0]) <= most else f"{found[0][:most]}..."


def near_misses(claims: DataFrame) -> DataFrame:
    """``claims`` (span, text, ...) with ``quote``: see ``closest_quote``; null where nothing is close."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def quote(span: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else closest_quote(s, t) for s, t in zip(span, text, strict=True)])

    return claims.withColumn("quote", quote("span", "text"))


def best_per_passage(retrieved: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """(by, passage_id, score[, rank]): best score of each passage, the ``top`` ones if asked."""
    best = retrieved.groupBy(*by, "passage_id").agg(F.max("score").alias("score"))
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("passage_id").asc())
    best = best.withColumn("rank", F.row_number().over(w))
    return best if top is None else best.filter(F.col("rank") <= top)


def trigger_passages(nuggets: DataFrame, evidence: DataFrame, by: str = "topic_id") -> DataFrame:
    """``nuggets`` whose trigger_passage_id is nulled where the topic's evidence lacks it."""
    known = evidence.select(by, F.col("passage_id").alias("trigger_passage_id")).distinct().withColumn("_k", F.lit(True))
    j = nuggets.join(known, [by, "trigger_passage_id"], "left")
    return j.withColumn("trigger_passage_id", F.when(F.col("_k"), F.col("trigger_passage_id"))).drop("_k").select(nuggets.columns)


def live_services(services: DataFrame, rendering: str, now: Column, max_age_s: float) -> DataFrame:
    """Services (name, rendering, beat) of a rendering with a fresh heartbeat, by name."""
    age = now.cast("timestamp").cast("double") - F.col("beat").cast("timestamp").cast("double")
    return services.filter((F.col("rendering") == rendering) & (age <= max_age_s)).orderBy("name")
