"""The coverage loop: rounds over a bank of questions until nothing new comes.

A round is a function of the bank and the round number that returns claims and
new questions; how it finds them (a model, a script) is its own affair. State
is two tables, cut after every round, so lineage does not grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.functions.text import mint
from lakewright.operators.rounds import saturation
from lakewright.plans.checkpoints import cut


@dataclass(frozen=True)
class LoopOptions:
    max_rounds: int = 8
    min_new: int = 1
    streak: int = 2


def legal_actions(searches: Column, failed: Column, *, max_searches: int = 5, min_searches: int = 1) -> Column:
    """Claim and answer always; search while the budget lasts; abstain after an effort and a failed answer."""
    return F.array_compact(
        F.array(
            F.lit("claim"),
            F.lit("answer"),
            F.when(searches < max_searches, "search"),
            F.when((searches >= min_searches) & (failed >= 1), "abstain"),
        )
    )


def forced_actions(turns: Column, searches: Column, tokens: Column, claims: Column) -> Column:
    """The one action left when a budget is spent (8 turns, 5 searches, 20,000 tokens), else null."""
    spent = (turns >= 8) | (searches >= 5) | (tokens >= 20_000)
    return F.when(spent, F.when(claims > 0, F.array(F.lit("answer"))).otherwise(F.array(F.lit("abstain"))))


def mint_nuggets(bank: DataFrame, questions: DataFrame, number: int) -> DataFrame:
    """New open nuggets of (topic_id, question): blank and known questions dropped, ids going on."""
    clean = questions.withColumn("question", F.trim("question")).filter("question <> ''").distinct()
    new = clean.join(bank.select("topic_id", "question"), ["topic_id", "question"], "left_anti")
    last = bank.groupBy("topic_id").agg((F.max(F.regexp_extract("nugget_id", r"#n(\d+)$", 1).cast("int")) + 1).alias("next"))
    order = W.partitionBy("topic_id").orderBy("question")
    n = new.join(last, "topic_id", "left").withColumn("k", F.row_number().over(order) - 1 + F.coalesce("next", F.lit(0)))
    return n.select(
        "topic_id", mint(F.col("topic_id"), "n", F.col("k")).alias("nugget_id"), "question",
        F.lit("unanswered").alias("status"), F.lit(number).alias("origin_round"),
    )


def apply_closures(bank: DataFrame, answered: DataFrame, pruned: DataFrame) -> DataFrame:
    """Statuses after a round: answered where claims came; pruned only where none did; pruned stays."""
    a = answered.select("nugget_id").distinct().withColumn("_a", F.lit(True))
    p = pruned.select("nugget_id").distinct().withColumn("_p", F.lit(True))
    j = bank.join(a, "nugget_id", "left").join(p, "nugget_id", "left")
    status = (
        F.when(F.col("status") == "pruned", "pruned")
        .when(F.col("_a"), "answered")
        .when(F.col("_p") & (F.col("status") != "answered"), "pruned")
        .otherwise(F.col("status"))
    )
    return j.withColumn("status", status).drop("_a", "_p").select(bank.columns)


def run_rounds(
    seeds: DataFrame, step: Callable[[DataFrame, int], tuple[DataFrame, DataFrame, DataFrame]], options: LoopOptions = LoopOptions()
) -> tuple[DataFrame, DataFrame]:
    """(bank, records) after rounds to saturation or ``max_rounds``.

    seeds: topic_id, question. ``step(open, round)`` returns claims (topic_id,
    nugget_id, ...), questions (topic_id, question) and pruned (nugget_id) of
    one round. A topic whose last ``streak`` rounds brought ``min_new`` or
    fewer questions is no longer asked; what its last rounds left open stays.
    """
    empty = seeds.sparkSession.createDataFrame([], "topic_id string, nugget_id string, question string, status string, origin_round int")
    empty = empty.withColumn("topic_id", F.col("topic_id").cast(seeds.schema["topic_id"].dataType))
    bank = cut(mint_nuggets(empty, seeds, 0))
    records = None
    grown = bank.groupBy("topic_id").agg(F.count(F.lit(1)).alias("novelty")).withColumn("round", F.lit(0))
    for number in range(1, options.max_rounds + 1):
        series = saturation(grown, min_new=options.min_new, streak=options.streak)
        done = series.filter((F.col("round") == number - 1) & F.col("saturated")).select("topic_id")
        asked = cut(bank.filter("status = 'unanswered'").join(done, "topic_id", "left_anti"))
        if asked.limit(1).count() == 0:
            break
        claims, questions, pruned = step(asked, number)
        claims = cut(claims.withColumn("round", F.lit(number)))
        records = claims if records is None else cut(records.unionByName(claims))
        new = mint_nuggets(bank, questions, number)
        topics = bank.select("topic_id").distinct()
        counts = topics.join(new.groupBy("topic_id").agg(F.count(F.lit(1)).alias("novelty")), "topic_id", "left")
        counts = counts.select("topic_id", F.coalesce("novelty", F.lit(0).cast("long")).alias("novelty"), F.lit(number).alias("round"))
        grown = cut(grown.unionByName(counts))
        bank = cut(apply_closures(bank, claims, pruned).unionByName(new))
    return bank, records
