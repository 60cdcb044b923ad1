"""Duplicate questions and answers: two policies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.operators.graph import connected_components
from lakewright.plans.grouped import fold_groups

#: Rows of a block; a pair of blocks is compared by one matrix product.
BLOCK = 2_048


def _deal(vectors: DataFrame, by: str) -> DataFrame:
    sizes = vectors.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    v = vectors.select(by, "id", "vector").join(sizes, by).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = v.select(by, F.col("_b").alias("i"), every.alias("j"), F.lit(0).alias("side"), "id", "vector")
    right = v.select(by, every.alias("i"), F.col("_b").alias("j"), F.lit(1).alias("side"), "id", "vector")
    return left.unionByName(right).filter("i <= j")


def similar_pairs(vectors: DataFrame, cutoff: float, by: str) -> DataFrame:
    """(by, a, b, score) with a < b and an inner product of ``cutoff`` or more.

    vectors: by, id, vector. Every pair of one ``by`` is compared, in blocks;
    only pairs that are similar leave a task.
    """

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({by: [], "a": [], "b": [], "score": []})
        s = np.round(np.array(x["vector"].tolist(), float) @ np.array(y["vector"].tolist(), float).T, 9)
        i, j = np.nonzero(s >= cutoff)
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        keep = (a < b) if pdf["i"].iloc[0] == pdf["j"].iloc[0] else (a != b)
        out = pd.DataFrame({by: pdf[by].iloc[0], "a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": s[i, j][keep]})
        return out

    kind = dict(vectors.dtypes)[by]
    return _deal(vectors, by).groupBy(by, "i", "j").applyInPandas(block, f"`{by}` {kind}, a long, b long, score double")


def merge_questions(vectors: DataFrame, cutoff: float, by: str) -> DataFrame:
    """(by, id, component): ids that hang together at ``cutoff``; the smallest id names them. Runs actions."""
    comps = connected_components(similar_pairs(vectors, cutoff, by), "a", "b")
    out = vectors.select(by, "id").join(comps.withColumnRenamed("node", "id"), "id", "left")
    return out.select(by, "id", F.coalesce("component", "id").alias("component"))


def greedy_survivors(ids: list, vectors: np.ndarray, cutoff: float, confirm=None) -> list:
    """For each id in order, the earlier survivor that absorbs it, or itself.

    The most similar survivor is asked first, older ones first among equals,
    down to ``cutoff``; ``confirm(kept, candidate)`` may refuse.
    """
    kept: list[int] = []
    into = []
    for i in range(len(ids)):
        target = None
        if kept:
            s = np.round(vectors[kept] @ vectors[i], 9)
            for pos in np.argsort(-s, kind="stable"):
                if s[pos] < cutoff:
                    break
                if confirm is None or confirm(ids[kept[pos]], ids[i]):
                    target = kept[pos]
                    break
        if target is None:
            kept.append(i)
        into.append(ids[i if target is None else target])
    return into


def greedy_dedup(vectors: DataFrame, cutoff: float, by: str, confirm=None) -> DataFrame:
    """(by, id, survivor) in order of id; one group's fold runs in one task."""

    def fold(g: dict[str, list]) -> dict[str, list]:
        vectors = np.array([list(v) for v in g["vector"]], float)
        return {by: g[by], "id": g["id"], "survivor": greedy_survivors(g["id"], vectors, cutoff, confirm)}

    kind = dict(vectors.dtypes)[by]
    return fold_groups(vectors.select(by, "id", "vector"), [by], ["id"], fold, f"`{by}` {kind}, id long, survivor long")


def merge_references(maps: DataFrame) -> DataFrame:
    """(key, references): of (key, references map) the best score per document."""
    e = maps.select("key", F.explode("references").alias("doc_id", "score"))
    best = e.groupBy("key", "doc_id").agg(F.max("score").alias("score"))
    return best.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "score")))).alias("references"))
