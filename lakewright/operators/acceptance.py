"""Checks over built artefacts: fingerprints, parity, gates, manifests, answer merges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.plans.grouped import fold_groups


def bank_fingerprint(bank: DataFrame, by: list[str]) -> DataFrame:
    """(by, fingerprint, counter) of banks (by, nugget_id, question, aggregator_type).

    Order, weights and statuses don't count. ``counter`` is the number of the
    first 13 hex digits, which a double holds exactly.
    """
    item = F.struct("nugget_id", F.to_json(F.struct("aggregator_type", "question")).alias("j"))
    g = bank.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    text = F.concat(F.lit('{"nuggets":['), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]}"))
    g = g.select(*by, F.sha2(text.cast("binary"), 256).alias("fingerprint"))
    return g.withColumn("counter", F.conv(F.substring("fingerprint", 1, 13), 16, 10).cast("double"))


def parity_violations(prints: DataFrame, by: list[str]) -> DataFrame:
    """(by, prints) where variants of one thing have more than one ``fingerprint``."""
    return prints.groupBy(*by).agg(F.count_distinct("fingerprint").alias("prints")).filter("prints > 1")


def self_retrieval(hits: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(query_id, found, excused, passed) of dense hits (query_id, id, score, rank) of stored vectors.

    A vector must be its own first hit, unless all that was returned ties with
    the top score: then copies pushed it out.
    """
    g = hits.groupBy("query_id").agg(
        F.min(F.when(F.col("id") == F.col("query_id"), F.col("rank"))).alias("own"),
        F.max("score").alias("top"),
        F.min("score").alias("low"),
    )
    excused = (F.col("own").isNull() | (F.col("own") > 1)) & (F.col("top") - F.col("low") <= eps)
    found = F.coalesce(F.col("own") == 1, F.lit(False))
    return g.select("query_id", found.alias("found"), excused.alias("excused"), (found | excused).alias("passed"))


def manifest_violations(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, declared, actual) where a table's declared and actual rows differ or one is missing."""
    j = declared.select("name", F.col("rows").alias("declared")).join(actual.select("name", F.col("rows").alias("actual")), "name", "full")
    return j.filter(~F.col("declared").eqNullSafe(F.col("actual")))


def reduce_manifests(fragments: DataFrame, key: str, shared: list[str], listed: list[str]) -> DataFrame:
    """One row per ``key``: shared fields (or null and a place in ``conflicts`` if they differ), lists in order of ``part``."""
    aggs = []
    for c in shared:
        aggs += [F.count_distinct(c).alias(f"_{c}"), F.min(c).alias(c)]
    for c in listed:
        pairs = F.array_sort(F.collect_list(F.struct("part", c)))
        aggs.append(F.array_distinct(pairs[c]).alias(c))
    g = fragments.groupBy(key).agg(*aggs)
    clash = F.array_compact(F.array(*[F.when(F.col(f"_{c}") > 1, F.lit(c)) for c in shared]))
    return g.withColumn("conflicts", clash).select(key, *[F.when(F.col(f"_{c}") <= 1, F.col(c)).alias(c) for c in shared], *listed, "conflicts")


def text_blocks(texts: DataFrame) -> DataFrame:
    """(name, block, digest) of texts (name, text): top-level ``key:`` lines with what is indented below."""
    lines = texts.select("name", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    w = W.partitionBy("name").orderBy("at")
    head = F.regexp_extract("line", r"^(\w[\w-]*):", 1)
    lines = lines.withColumn("block", F.last(F.when(head != "", head), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = lines.filter("block is not null").groupBy("name", "block").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.rtrim(x["line"])), "\n")
    return g.select("name", "block", F.sha2(text.cast("binary"), 256).alias("digest"))


def truncated(tokens: Column, most: int, leading: int = 1) -> Column:
    """At most ``most`` tokens, the leading specials and the last token kept."""
    cut = F.concat(
        F.slice(tokens, 1, leading), F.slice(tokens, leading + 1, most - 1 - leading), F.slice(tokens, -1, 1)
    )
    return F.when(F.size(tokens) <= most, tokens).otherwise(cut)


def unit_violations(members: DataFrame) -> DataFrame:
    """(unit_id, violation) of unit members (unit_id, place, n, doc_id, sentence_index)."""
    g = members.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("doc_id").alias("docs"),
        F.count_distinct("place").alias("places"), F.max("place").alias("last"), (F.max("sentence_index") - F.min("sentence_index")).alias("reach"),
    )
    v = (
        F.when(F.col("docs") > 1, "several documents")
        .when(F.col("lo") != F.col("hi"), "counts differ")
        .when(F.col("c") != F.col("lo"), "count is not the members")
        .when((F.col("places") != F.col("c")) | (F.col("last") != F.col("c") - 1), "places not dense")
        .when(F.col("reach") != F.col("c") - 1, "sentences not neighbours")
    )
    return g.select("unit_id", v.alias("violation")).filter("violation is not null")


def paragraph_edges(spine: DataFrame) -> DataFrame:
    """``spine`` with ``opens`` and ``closes``: whether a sentence begins or ends its paragraph."""
    w = W.partitionBy("doc_id").orderBy("sentence_index")
    other = lambda f: ~F.col("paragraph_index").eqNullSafe(f("paragraph_index").over(w))
    return spine.withColumn("opens", other(F.lag)).withColumn("closes", other(F.lead))


def merge_same_answers(
    answers: list[dict], vectors: np.ndarray, cutoff: float, confirm: Callable[[str, str], bool]
) -> list[dict]:
    """Answers of one nugget, those that say the same merged into the earlier one.

    answers: answer, score, references (dict), support (list). Survivors are
    asked in order; both the cosine and ``confirm`` (on the sorted pair) must
    agree. References keep the larger score, support each entry once.
    """
    near = vectors @ vectors.T >= cutoff
    leader = np.arange(len(answers))
    for i in range(len(answers)):
        before = np.flatnonzero(near[i, :i] & (leader[:i] == np.arange(i)))
        same = (k for k in before if confirm(*sorted((answers[k]["answer"], answers[i]["answer"]))))
        leader[i] = next(same, i)

    def together(members: list[dict]) -> dict:
        ids = dict.fromkeys(d for a in members for d in a["references"])
        return members[0] | {
            "score": max(a["score"] for a in members),
            "references": {d: max(a["references"][d] for a in members if d in a["references"]) for d in ids},
            "support": list(dict.fromkeys(x for a in members for x in a["support"])),
        }

    return [together([answers[i] for i in np.flatnonzero(leader == k)]) for k in np.unique(leader)]


def merge_answers(answers: DataFrame, cutoff: float, confirm: Callable[[str, str], bool] = lambda a, b: True) -> DataFrame:
    """(nugget_id, answer, score, references) after merging inside OR nuggets; AND nuggets pass.

    answers: nugget_id, aggregator_type, answer_index, answer, vector, score,
    references (map<long,double>).
    """

    def fold(g: dict[str, list]) -> dict[str, list]:
        rows = [
            {"answer": a, "score": s, "references": dict(r), "support": []}
            for a, s, r in zip(g["answer"], g["score"], g["references"], strict=True)
        ]
        if g["aggregator_type"][0] == "OR" and len(rows) > 1:
            rows = merge_same_answers(rows, np.array([list(v) for v in g["vector"]], float), cutoff, confirm)
        return {
            "nugget_id": g["nugget_id"][:1] * len(rows),
            "answer": [r["answer"] for r in rows],
            "score": [r["score"] for r in rows],
            "references": [r["references"] for r in rows],
        }

    kind = dict(answers.dtypes)["nugget_id"]
    return fold_groups(
        answers, ["nugget_id"], ["answer_index"], fold, f"nugget_id {kind}, answer string, score double, references map<bigint,double>"
    )


def component_merge(nuggets: DataFrame, answers: DataFrame, retrieved: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nuggets, answers and retrieved passages of components (id, component): greatest weight, each answer and passage once, first kept."""
    c = components.select(F.col("id").alias("nugget_id"), "component")
    n = nuggets.join(c, "nugget_id").groupBy("component").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("members"))
    first = lambda df, key: (
        df.join(c, "nugget_id")
        .withColumn("_r", F.row_number().over(W.partitionBy("component", *key).orderBy("nugget_id", *[x for x in df.columns if x != "nugget_id"])))
        .filter("_r = 1").drop("_r")
    )
    return n, first(answers, ["answer", "span"]), first(retrieved, ["passage_id"])
