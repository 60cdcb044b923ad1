"""Claims, answers, citations and the three outputs made of them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.functions.text import cluster_key, nfc, utrim
from lakewright.plans.grouped import fold_groups


def ground(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """``claims`` (loop_id, claim, span, passage_id) with ``verdict``.

    Checks in order: empty span, empty claim, no passage, a passage that the
    loop was not shown (loop_id, passage_id, text), a span that the passage
    does not hold. Span and text are compared in their composed form (NFC).
    """
    s = shown.select("loop_id", "passage_id", F.col("text").alias("_text"))
    j = claims.join(s, ["loop_id", "passage_id"], "left")
    blank = lambda c: utrim(F.coalesce(c, F.lit(""))) == ""
    verdict = (
        F.when(blank(F.col("span")), "empty span")
        .when(blank(F.col("claim")), "empty claim")
        .when(F.col("passage_id").isNull(), "no passage")
        .when(F.col("_text").isNull(), "passage not shown")
        .when(F.instr(nfc(F.col("_text")), nfc(F.col("span"))) == 0, "span not in passage")
        .otherwise("grounded")
    )
    return j.withColumn("verdict", verdict).drop("_text")


def fan_in(claims: DataFrame) -> DataFrame:
    """Claims (nugget_id, seq, answer, doc_id, score) clustered by what they say.

    One row per nugget and value key: the first wording, its place, the claims,
    the documents (first seen first) and the best score per document.
    """
    c = claims.withColumn("value_key", cluster_key(F.col("answer")))
    per_doc = c.groupBy("nugget_id", "value_key", "doc_id").agg(
        F.min("seq").alias("first"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n"),
        F.min_by("answer", "seq").alias("answer"),
    )
    g = per_doc.groupBy("nugget_id", "value_key").agg(
        F.min_by("answer", "first").alias("answer"),
        F.min("first").alias("first_seq"),
        F.sum("n").alias("claims"),
        F.array_sort(F.collect_list(F.struct("first", "doc_id", "score"))).alias("refs"),
    )
    w = W.partitionBy("nugget_id").orderBy("first_seq", "value_key")
    return g.withColumn("answer_index", F.row_number().over(w) - 1)


def contested(answers: DataFrame) -> DataFrame:
    """(nugget_id, values, contested) of fanned-in answers."""
    return answers.groupBy("nugget_id").agg(F.count_distinct("value_key").alias("values")).withColumn(
        "contested", F.col("values") >= 2
    )


def last_complete_round(rounds: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, through): the last round of the gap-free run from 0; null without round 0."""
    w = W.partitionBy(by).orderBy("round")
    r = rounds.select(by, "round").distinct().withColumn("at", F.row_number().over(w) - 1)
    return r.groupBy(by).agg(F.max(F.when(F.col("round") == F.col("at"), F.col("round"))).alias("through"))


def loop_references(records: DataFrame, through: DataFrame) -> DataFrame:
    """Best score per (topic_id, nugget_id, answer, span, doc_id) over rounds up to ``through``."""
    r = records.join(through, "topic_id").filter(F.col("round") <= F.col("through"))
    return r.groupBy("topic_id", "nugget_id", "answer", "span", "doc_id").agg(F.max("score").alias("score"))


def bank_evidence(bank: DataFrame, references: DataFrame, citation_scores: DataFrame) -> DataFrame:
    """Bank answers (topic_id, nugget_id, answer, span, weight) with their references.

    One row per answer and document; ``score`` is the citation's, else the
    loop's; an answer without references has one row with a null document.
    """
    keys = ["nugget_id", "answer", "span"]
    j = bank.join(references.drop("topic_id").withColumnRenamed("score", "loop_score"), keys, "left")
    cites = citation_scores.select(*keys, "doc_id", F.col("score").alias("cited"))
    j = j.join(cites, [*keys, "doc_id"], "left")
    return j.withColumn("score", F.coalesce("cited", "loop_score"))


def orphans(bank: DataFrame, references: DataFrame) -> DataFrame:
    """Bank answers that no loop record supports."""
    return bank.join(references, ["nugget_id", "answer", "span"], "left_anti")


def document_support(citations: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, doc_id, total, unscored) of citations (by, doc_id, score, weight).

    An unscored citation counts with its nugget's weight.
    """
    return citations.groupBy(by, "doc_id").agg(
        F.round(F.sum(F.coalesce("score", "weight")), 6).alias("total"), F.count_if(F.col("score").isNull()).alias("unscored")
    )


def rerank_evidence(observed: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, doc_id, rerank) of observations (by, nugget_id, passage_id, doc_id, score, cited).

    Per nugget the best score of a passage, then the mean over nuggets and
    passages; cited passages decide where there are any, the pool elsewhere.
    """
    best = observed.groupBy(by, "nugget_id", "passage_id", "doc_id").agg(
        F.max("score").alias("score"), F.max("cited").alias("cited")
    )
    means = best.groupBy(by, "doc_id").agg(
        F.avg(F.when(F.col("cited"), F.col("score"))).alias("c"), F.avg(F.when(~F.col("cited"), F.col("score"))).alias("p")
    )
    return means.select(by, "doc_id", F.coalesce("c", "p").alias("rerank"))


def support_and_rerank(observed: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, doc_id, total, unscored, rerank): ``document_support`` and ``rerank_evidence`` of the same rows at once.

    observed: by, nugget_id, passage_id, doc_id, score, cited, and of the
    citation its ``citation`` score and ``weight``. Rows that stand together by
    ``by`` are not shuffled.
    """
    best = observed.groupBy(by, "nugget_id", "passage_id", "doc_id").agg(
        F.max("score").alias("score"), F.max("cited").alias("cited"),
        F.sum(F.coalesce("citation", "weight")).alias("part"), F.count_if(F.col("citation").isNull()).alias("unscored"),
    )
    g = best.groupBy(by, "doc_id").agg(
        F.round(F.sum("part"), 6).alias("total"), F.sum("unscored").alias("unscored"),
        F.avg(F.when(F.col("cited"), F.col("score"))).alias("c"), F.avg(F.when(~F.col("cited"), F.col("score"))).alias("p"),
    )
    return g.select(by, "doc_id", "total", "unscored", F.coalesce("c", "p").alias("rerank"))


def rank_documents(support: DataFrame, top: int, rerank: DataFrame | None = None, by: str = "topic_id") -> DataFrame:
    """The ``top`` documents: total descending, rerank descending (missing last), doc_id."""
    s = support if rerank is None else support.join(rerank, [by, "doc_id"], "left")
    if "rerank" not in s.columns:
        s = s.withColumn("rerank", F.lit(None).cast("double"))
    w = W.partitionBy(by).orderBy(F.col("total").desc(), F.col("rerank").desc_nulls_last(), F.col("doc_id").asc())
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def separate_ties(ranked: DataFrame, *, gap: float = 1e-6, by: str = "topic_id") -> DataFrame:
    """``ranked`` (by, doc_id, total, rank) with strictly falling ``score``.

    Rows that print alike with nine decimals are spread evenly towards the next
    lower score (or one less, at the end), ``gap`` short of it. ``separable``
    is false where a step would be under 1e-9.
    """
    r = ranked.withColumn("printed", F.round("total", 9))
    group = W.partitionBy(by, "printed")
    order = group.orderBy("rank")
    below = r.select(by, "printed").distinct().withColumn(
        "next", F.lead("printed").over(W.partitionBy(by).orderBy(F.col("printed").desc()))
    )
    r = r.join(below, [by, "printed"]).withColumn("n", F.count(F.lit(1)).over(group)).withColumn("g", F.row_number().over(order) - 1)
    usable = F.col("printed") - F.coalesce("next", F.col("printed") - 1) - gap
    step = F.when(F.col("n") > 1, usable / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return r.withColumn("score", F.col("printed") - F.col("g") * step).withColumn(
        "separable", (F.col("n") == 1) | (step >= 1e-9)
    ).drop("printed", "next", "n", "g")


def run_violations(run: DataFrame, by: str = "topic_id") -> DataFrame:
    """(by, rank, violation) of a run (by, doc_id, rank, score)."""
    w = W.partitionBy(by).orderBy("rank")
    r = run.withColumn("at", F.row_number().over(w)).withColumn("above", F.lag("score").over(w))
    r = r.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy(by, "doc_id")))
    v = (
        F.when(F.col("doc_id").isNull(), "no document")
        .when(F.col("at") != F.col("rank"), "rank is not the place")
        .when(F.col("score") >= F.col("above"), "score does not fall")
        .when(F.col("copies") > 1, "document repeats")
    )
    return r.withColumn("violation", v).filter("violation is not null").select(by, "rank", "violation")


def cap_bank(nuggets: DataFrame, answers: DataFrame, *, top_nuggets: int, top_answers: int) -> DataFrame:
    """Answers (nugget_id, answer_index, score) of the best nuggets (topic_id, nugget_id, weight)."""
    wn = W.partitionBy("topic_id").orderBy(F.col("weight").desc(), F.col("nugget_id").asc())
    n = nuggets.withColumn("nugget_rank", F.row_number().over(wn)).filter(F.col("nugget_rank") <= top_nuggets)
    wa = W.partitionBy("nugget_id").orderBy(F.col("score").desc(), F.col("answer_index").asc())
    a = answers.withColumn("answer_rank", F.row_number().over(wa)).filter(F.col("answer_rank") <= top_answers)
    return n.join(a, "nugget_id")


def k_band(topics: DataFrame, bands: DataFrame) -> DataFrame:
    """``topics`` (topic_id, limit) with k_min, k_max of the first band (threshold, k_min, k_max) that holds the limit.

    A limit over every threshold takes the last band. Bands are a handful of
    configured rows, so they come as one array to every topic.
    """
    all_ = bands.agg(F.array_sort(F.collect_list(F.struct("threshold", "k_min", "k_max"))).alias("bands"))
    t = topics.join(F.broadcast(all_))
    fits = F.filter("bands", lambda b: F.col("limit") <= b["threshold"])
    pick = F.coalesce(F.try_element_at(fits, F.lit(1)), F.element_at("bands", -1))
    return t.withColumn("b", pick).select(*topics.columns, "b.k_min", "b.k_max")


def sentence_key(s: str) -> str:
    return " ".join(unicodedata.normalize("NFC", s).split()).casefold()


def nfkc_size(texts: list[str]) -> int:
    return len(unicodedata.normalize("NFKC", " ".join(texts)))


#: What a report says when no cited sentence fits. A fixed value of our own.
FALLBACK = "No sufficiently grounded evidence was found."


def fill_report(rows: list[dict], limit: int) -> list[tuple[str, list]]:
    """(sentence, sorted documents) of one topic's report within ``limit`` characters.

    rows: nugget_id, weight, answer_index, score, sentence, docs. First the
    best answer of each nugget, by weight; then the rest by weight x score. A
    sentence said before only adds its documents; one that does not fit is
    passed over and shorter ones may follow. Sizes are of the NFKC form.
    """
    by_nugget: dict = {}
    for r in rows:
        by_nugget.setdefault(r["nugget_id"], []).append(r)
    first = []
    for answers in by_nugget.values():
        first.append(min(answers, key=lambda r: (-r["score"], r["answer_index"])))
    first.sort(key=lambda r: (-r["weight"], r["nugget_id"]))
    chosen = {(r["nugget_id"], r["answer_index"]) for r in first}
    value = lambda r: (-(r["weight"] * r["score"]), r["nugget_id"], r["answer_index"])
    later = sorted((r for r in rows if (r["nugget_id"], r["answer_index"]) not in chosen), key=value)
    said: dict[str, int] = {}
    out: list[tuple[str, set]] = []
    used = 0
    for r in [*first, *later]:
        if not len(r["docs"]):
            continue
        key = sentence_key(r["sentence"])
        if key in said:
            out[said[key]][1].update(r["docs"])
            continue
        cost = nfkc_size([r["sentence"]]) + (1 if out else 0)
        if used + cost > limit:
            continue
        said[key] = len(out)
        out.append((r["sentence"], set(r["docs"])))
        used += cost
    if not out:
        best = min(rows, key=value, default=None)
        if best and len(best["docs"]) and best["sentence"] and nfkc_size([best["sentence"]]) <= limit:
            out = [(best["sentence"], set(best["docs"]))]
        else:
            return [(FALLBACK, [])]
    while out and nfkc_size([t for t, _ in out]) > limit:
        out.pop()
    return [(t, sorted(d)) for t, d in out]


def task1_reports(answers: DataFrame) -> DataFrame:
    """(topic_id, position, sentence, docs) from answers of answered nuggets.

    answers: topic_id, limit, nugget_id, weight, answer_index, score, sentence,
    docs (array<long>). One topic's answers are folded in one task.
    """

    names = ("nugget_id", "weight", "answer_index", "score", "sentence", "docs")

    def fold(g: dict[str, list]) -> dict[str, list]:
        rows = [dict(zip(names, r, strict=True)) for r in zip(*(g[n] for n in names), strict=True)]
        report = fill_report(rows, int(g["limit"][0]))
        return {
            "topic_id": g["topic_id"][:1] * len(report),
            "position": list(range(len(report))),
            "sentence": [t for t, _ in report],
            "docs": [list(map(int, d)) for _, d in report],
        }

    kind = dict(answers.dtypes)["topic_id"]
    schema = f"topic_id {kind}, position int, sentence string, docs array<bigint>"
    return fold_groups(answers.select("topic_id", "limit", *names), ["topic_id"], ["nugget_id", "answer_index"], fold, schema)


def task3_bank(capped: DataFrame, references: DataFrame) -> DataFrame:
    """One row per nugget of ``cap_bank``'s result: its answers with sorted distinct documents."""
    refs = references.groupBy("nugget_id", "answer_index").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    j = capped.join(refs, ["nugget_id", "answer_index"], "left")
    return j.groupBy("topic_id", "nugget_id", "nugget_rank").agg(
        F.first("weight").alias("weight"),
        F.count(F.lit(1)).alias("answers"),
        F.array_sort(F.collect_list(F.struct("answer_rank", "answer_index", "docs"))).alias("items"),
    )


def trec_rows(ranked: DataFrame, tag: str, score: Column) -> DataFrame:
    """Six-column run lines; ``score`` is the printed score."""
    return ranked.select(
        F.concat_ws(" ", F.col("topic_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), score, F.lit(tag)).alias("line")
    )


def vital(weight: Column, cutoff: float) -> Column:
    """Whether a nugget is vital: its weight reaches ``cutoff``. A null weight is not."""
    return F.coalesce(weight >= cutoff, F.lit(False))


def uncovered(topics: DataFrame, run: DataFrame, by: str = "topic_id") -> DataFrame:
    """Topics (by) that a run has no row of; each once."""
    return topics.select(by).distinct().join(run.select(by), by, "left_anti")
