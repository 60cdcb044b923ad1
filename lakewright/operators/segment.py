"""Paragraphs and offset-addressed sentences.

All of a document's work is inside its row until sentences, numbered already,
are exploded, so segmentation shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.functions.text import lead_of, mint, utrim, word_count
from lakewright.operators.boilerplate import is_chrome

#: Stand-in for a sentence model: up to and with a run of terminators.
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+$"
#: Strings gathered before they are set aside.
RUN = 256


def paragraphs(docs: DataFrame, *, mode: str = "blank", strip: str | None = "v1") -> DataFrame:
    """(doc_id, lang, paragraphs, text) of documents (doc_id, lang, text).

    ``blank``: blank lines part paragraphs, whose lines are joined by a blank;
    a chrome line goes and parts nothing. ``line``: each line is a paragraph.
    If nothing is left, the document is empty where chrome was stripped and
    its stripped text otherwise.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), utrim)
    kept = F.filter(lines, lambda x: ~is_chrome(x, strip)) if strip else lines
    if mode == "line":
        paras = F.filter(kept, lambda x: x != "")
    elif mode == "blank":
        marked = F.array_join(F.transform(kept, lambda x: F.when(x == "", "\u0000").otherwise(x)), " ")
        paras = F.filter(F.transform(F.split(marked, "\u0000", -1), utrim), lambda x: x != "")
    else:
        raise ValueError(f"unknown paragraph mode {mode!r}; known: blank, line")
    if not strip:
        whole = utrim(F.coalesce("text", F.lit("")))
        paras = F.when((F.size(paras) == 0) & (whole != ""), F.array(whole)).otherwise(paras)
    return docs.select("doc_id", "lang", paras.alias("paragraphs")).withColumn("text", F.array_join("paragraphs", " "))


def placed(parts: Column, gap: int) -> Column:
    """Structs (part, at) of strings, ``at`` being each one's start in their join by ``gap`` characters.

    One pass. What is gathered is set aside every ``RUN`` strings, for an array
    is copied whenever it grows.
    """
    item = "array<struct<part:string,at:int>>"
    zero = F.struct(
        F.array().cast(f"array<{item}>").alias("aside"), F.array().cast(item).alias("run"), F.lit(0).alias("at")
    )

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["run"]) >= RUN
        one = F.array(F.struct(x.alias("part"), acc["at"].alias("at")))
        return F.struct(
            F.when(full, F.concat(acc["aside"], F.array(acc["run"]))).otherwise(acc["aside"]).alias("aside"),
            F.when(full, one).otherwise(F.concat(acc["run"], one)).alias("run"),
            (acc["at"] + F.length(x) + gap).alias("at"),
        )

    return F.aggregate(parts, zero, step, lambda acc: F.flatten(F.concat(acc["aside"], F.array(acc["run"]))))


def sentences(paras: DataFrame, pattern: str = SENTENCE) -> DataFrame:
    """The sentence spine of ``paragraphs``' result, text included.

    sentence_id, doc_id, sentence_index, lang, start, end, paragraph_index,
    token_count, sentence. Spans are trimmed and index the document's text.
    Each row of ``paras`` is numbered by itself.
    """

    def cut(p: Column, i: Column) -> Column:
        segs = F.filter(placed(F.regexp_extract_all(p["part"], F.lit(pattern), 0), 0), lambda s: s["part"].rlike(r"(?U)\S"))
        return F.transform(
            segs, lambda s: F.struct(i.alias("paragraph_index"), (p["at"] + s["at"]).alias("at"), s["part"].alias("part"))
        )

    every = F.flatten(F.transform(placed(F.col("paragraphs"), 1), cut))
    s = paras.select("doc_id", "lang", F.posexplode(every).alias("sentence_index", "s"))
    s = s.select("doc_id", "lang", "sentence_index", "s.*")
    s = s.withColumn("sentence", utrim(F.col("part"))).withColumn("start", F.col("at") + lead_of(F.col("part")))
    return s.select(
        mint(F.col("doc_id"), "s", F.col("sentence_index")).alias("sentence_id"),
        "doc_id",
        "sentence_index",
        "lang",
        "start",
        (F.col("start") + F.length("sentence")).alias("end"),
        "paragraph_index",
        word_count(F.col("sentence")).alias("token_count"),
        "sentence",
    )


def span_violations(spine: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, violation) of the spine against the documents' text."""
    order = W.partitionBy("doc_id").orderBy("sentence_index")
    # Sorted before a document's text is beside each of its sentences.
    s = spine.withColumn("at", F.row_number().over(order) - 1).withColumn("before", F.lag("end").over(order))
    s = s.join(docs.select("doc_id", "text"), "doc_id", "left")
    cut = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return s.withColumn(
        "violation",
        F.when(F.col("text").isNull(), "no document")
        .when(F.col("at") != F.col("sentence_index"), "index not dense")
        .when(F.col("start") < F.coalesce("before", F.lit(0)), "spans overlap")
        .when(cut != F.col("sentence"), "text is not the slice")
        .when(F.length(utrim(F.col("sentence"))) != F.length("sentence"), "not trimmed"),
    ).filter("violation is not null").select("doc_id", "sentence_index", "violation")
