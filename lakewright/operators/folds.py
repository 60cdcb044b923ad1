"""Sequential folds: short-sentence merge, passage packing, batches, shard cuts.

Each rule is a plain function over one group's sorted rows, tested without
Spark; the DataFrame wrappers group by document (or length bucket) and run it
there. Groups are single documents, whose size is bounded by what a text holds.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.plans.grouped import fold_groups


def merge_short(
    spans: Sequence[tuple[int, int]],
    paras: Sequence[int],
    counts: Sequence[int],
    text: str,
    count: Callable[[str], int],
    *,
    min_tokens: int = 16,
    cap: float = 76.8,
    cross_paragraph: bool = True,
) -> list[tuple[int, int, int]]:
    """Units (first, last, tokens) of one document's sentences, left to right.

    A unit under ``min_tokens`` takes its neighbour: forward if it opens its
    paragraph, backward if not; a whole paragraph tries both, forward first,
    where paragraphs may be crossed. The fused text is counted anew and may
    not exceed ``cap``. What fits nowhere stays as it is.

    An automaton over two stacks: what is settled, and what is to come. A
    fused unit goes back to what is to come and is looked at again.
    """
    n = len(spans)
    begins = [k in (0, n) or paras[k - 1] != paras[k] for k in range(n + 1)]
    settled: list[tuple[int, int, int]] = []
    coming = [(k, k, counts[k]) for k in reversed(range(n))]

    def fusions(unit: tuple[int, int, int]):
        """(partner's stack, first, last) of what the unit may become, the preferred first."""
        opens, closes = begins[unit[0]], begins[unit[1] + 1]
        alone = opens and closes
        if coming and opens and (cross_paragraph or not alone):
            yield coming, unit[0], coming[-1][1]
        if settled and (not opens or alone and cross_paragraph):
            yield settled, settled[-1][0], unit[1]

    while coming:
        unit = coming.pop()
        fused = None
        for partner, first, last in fusions(unit) if unit[2] < min_tokens else ():
            tokens = count(text[spans[first][0] : spans[last][1]])
            if tokens <= cap:
                partner.pop()
                fused = (first, last, tokens)
                break
        (coming if fused else settled).append(fused or unit)
    return settled


def pack(
    counts: Sequence[int],
    paras: Sequence[int],
    *,
    budget: int = 512,
    overlap: float = 0.15,
    prefer_paragraph: bool = True,
    min_fill: float = 0.6,
    special: int = 0,
) -> list[tuple[int, int, int, bool]]:
    """Passages (first, last, tokens, oversized) over one document's sentences.

    ``special`` tokens of every passage are reserved from the budget. With
    running totals, each end and each beginning is one search.
    """
    budget -= special
    n, total = len(counts), [0, *accumulate(counts)]
    large = [k for k in range(n) if counts[k] > budget]
    turns = [k for k in range(1, n) if paras[k] != paras[k - 1]] if prefer_paragraph else []

    def first_from(places: list[int], k: int) -> int:
        at = bisect_left(places, k)
        return places[at] if at < len(places) else n

    out: list[tuple[int, int, int, bool]] = []
    first = fresh = 0
    while fresh < n:
        if counts[fresh] > budget:
            out.append((fresh, fresh, counts[fresh], True))
            first = fresh = fresh + 1
            continue
        full = bisect_right(total, total[first] + budget) - 1
        filled = bisect_left(total, total[first] + min_fill * budget)
        end = min(full, first_from(large, fresh), first_from(turns, max(fresh + 1, filled)))
        out.append((first, end - 1, total[end] - total[first], False))
        low, first, fresh = first, end, end
        room = budget - counts[end] if end < n else -1
        if overlap > 0 and counts[end - 1] <= room:
            # The tail: as far back as the share and the room allow, one sentence at least.
            first = bisect_left(total, total[end] - min(overlap * budget, room), low, end - 1)
    return out


def batches(lengths: Sequence[int], *, budget: int, most: int) -> list[int]:
    """Batch number of each item, by length then place; no batch over ``budget`` unless one item is."""
    order = sorted(range(len(lengths)), key=lambda k: (lengths[k], k))
    total = [0, *accumulate(lengths[k] for k in order)]
    out, start, number = [0] * len(order), 0, 0
    while start < len(order):
        end = min(start + most, max(start + 1, bisect_right(total, total[start] + budget) - 1))
        for k in order[start:end]:
            out[k] = number
        start, number = end, number + 1
    return out


def cut_shards(sizes: Sequence[int], cap: int) -> list[int]:
    """Shard number of each document in order, cut before the one that would pass ``cap``."""
    out, shard, used = [], 0, 0
    for s in sizes:
        if used and used + s > cap:
            shard, used = shard + 1, 0
        out.append(shard)
        used += s
    return out


def count_words(text: str) -> int:
    return len(text.split())


def merge_units(spine: DataFrame, docs: DataFrame, *, count=count_words, **options) -> DataFrame:
    """doc_id, unit, first, last, token_count of a spine (doc_id, sentence_index, ...); English stays single."""

    def fold(g: dict[str, list]) -> dict[str, list]:
        if g["lang"][0] == "en":
            units = [(i, i, c) for i, c in enumerate(g["token_count"])]
        else:
            spans = list(zip(g["start"], g["end"], strict=True))
            units = merge_short(spans, g["paragraph_index"], g["token_count"], g["text"][0], count, **options)
        n = len(units)
        return {
            "doc_id": g["doc_id"][:1] * n,
            "unit": list(range(n)),
            "first": [u[0] for u in units],
            "last": [u[1] for u in units],
            "token_count": [u[2] for u in units],
        }

    kind = dict(spine.dtypes)["doc_id"]
    rows = spine.select("doc_id", "sentence_index", "lang", "start", "end", "paragraph_index", "token_count")
    first = F.when(F.col("sentence_index") == 0, F.col("text")).otherwise(F.lit(""))
    rows = rows.join(docs.select("doc_id", "text"), "doc_id").withColumn("text", first)
    return fold_groups(
        rows, ["doc_id"], ["sentence_index"], fold, f"doc_id {kind}, unit int, first int, last int, token_count int"
    )


def pack_passages(spine: DataFrame, **options) -> DataFrame:
    """passage_id, doc_id, lang, first, last, token_count, is_oversized of a spine; a null count is 0."""

    def fold(g: dict[str, list]) -> dict[str, list]:
        out = pack([n or 0 for n in g["token_count"]], g["paragraph_index"], **options)
        n, doc = len(out), g["doc_id"][0]
        return {
            "passage_id": [f"{doc}#p{k}" for k in range(n)],
            "doc_id": [doc] * n,
            "lang": g["lang"][:1] * n,
            "first": [p[0] for p in out],
            "last": [p[1] for p in out],
            "token_count": [p[2] for p in out],
            "is_oversized": [p[3] for p in out],
        }

    kind = dict(spine.dtypes)["doc_id"]
    lean = spine.select("doc_id", "lang", "sentence_index", "paragraph_index", "token_count")
    schema = f"passage_id string, doc_id {kind}, lang string, first int, last int, token_count int, is_oversized boolean"
    return fold_groups(lean, ["doc_id"], ["sentence_index"], fold, schema)


def passage_violations(passages: DataFrame, spine: DataFrame, budget: int) -> DataFrame:
    """(passage_id or doc_id, violation): wrong sums, over budget, sentences left out."""
    m = passages.select("passage_id", "doc_id", "token_count", "is_oversized", F.explode(F.sequence("first", "last")).alias("sentence_index"))
    j = m.join(spine.select("doc_id", "sentence_index", F.col("token_count").alias("own")), ["doc_id", "sentence_index"], "left")
    per = j.groupBy("passage_id").agg(
        F.sum("own").alias("sum"), F.first("token_count").alias("declared"), F.first("is_oversized").alias("over"), F.count_if(F.col("own").isNull()).alias("orphans")
    )
    bad = per.select(
        F.col("passage_id").alias("id"),
        F.when(F.col("orphans") > 0, "orphan member")
        .when(F.col("sum") != F.col("declared"), "token sum")
        .when((F.col("declared") > budget) & ~F.col("over"), "over budget")
        .alias("violation"),
    ).filter("violation is not null")
    left = spine.join(m.select("doc_id", "sentence_index"), ["doc_id", "sentence_index"], "left_anti")
    return bad.unionByName(left.select(F.col("sentence_id").alias("id"), F.lit("not in a passage").alias("violation")))


def length_batches(items: DataFrame, group: str, length: str, *, budget: int, most: int) -> DataFrame:
    """``items`` (group, id, length) with ``batch`` inside each group, by (length, id); a null length counts as 0."""

    def fold(g: dict[str, list]) -> dict[str, list]:
        return g | {"batch": batches([n or 0 for n in g[length]], budget=budget, most=most)}

    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return fold_groups(items, [group], [length, "id"], fold, f"{schema}, batch int")


def decode_cap(longest: int, ratio: float = 2.0, extra: int = 10, most: int = 512) -> int:
    return max(1, min(most, math.ceil(ratio * longest) + extra))
