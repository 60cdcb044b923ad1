"""Translation units, split-back, reconciliation and renderings.

Every stage is keyed by document: one shuffle, reused by the windows and joins
that follow. Reconciling is an interval join inside a document, expressed as an
explode of each unit's positions and an equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.functions.text import MARKER, join_constituents, mint, scrub_markers, split_translation

#: What a unit knows of each of its sentences.
MEMBER = ["sentence_index", "start", "end", "paragraph_index", "token_count"]


def units_of(spine: DataFrame, size: int = 2) -> DataFrame:
    """Merge units of ``size`` neighbours (the last may be shorter); English stays single.

    doc_id, lang, head (first sentence_index), n, token_count, constituents,
    members (the sentences' index, span, paragraph and count, which
    ``reconcile`` then needn't look up). One shuffle, on the document.
    """
    n = F.when(F.col("lang") == "en", 1).otherwise(size)
    at = (F.floor(F.col("sentence_index") / n) * n).cast("int")
    row = F.struct(*MEMBER, "sentence")
    units = spine.repartition("doc_id").groupBy("doc_id", "lang", at.alias("head")).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.sum("token_count").cast("int").alias("token_count"),
        F.array_sort(F.collect_list(row)).alias("_rows"),
    )
    return units.select(
        "doc_id", "lang", "head", "n", "token_count",
        F.transform("_rows", lambda x: x["sentence"]).alias("constituents"),
        F.transform("_rows", lambda x: F.struct(*[x[c].alias(c) for c in MEMBER])).alias("members"),
    )


def merge_map(units: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, head) for every sentence of the units (doc_id, lang, head, n) outside English."""
    places = F.explode(F.sequence(F.col("head"), F.col("head") + F.col("n") - 1)).alias("sentence_index")
    return units.filter("lang <> 'en' or lang is null").select("doc_id", places, "head")


def unit_heads(map_: DataFrame) -> DataFrame:
    """The rows of a merge map whose sentence is its unit's head."""
    return map_.filter(F.col("sentence_index") == F.col("head"))


def merge_map_violations(map_: DataFrame, spine: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, violation) of a merge map against the spine outside English.

    A sentence must have one row, a row a sentence, and a unit must be a run
    of sentences that begins at its head. Units are named by their head.
    """
    keys = ["doc_id", "sentence_index"]
    told = map_.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    have = spine.filter("lang <> 'en' or lang is null").select(*keys, F.lit(True).alias("known"))
    single = have.join(told, keys, "full").withColumn(
        "violation",
        F.when(F.col("known").isNull(), "not of the spine").when(F.col("rows").isNull(), "no unit").when(F.col("rows") > 1, "in two units"),
    )
    units = map_.groupBy("doc_id", "head").agg(
        F.min("sentence_index").alias("low"), F.max("sentence_index").alias("high"), F.count_distinct("sentence_index").alias("n")
    )
    gaps = units.filter((F.col("low") != F.col("head")) | (F.col("high") - F.col("low") + 1 != F.col("n")))
    gaps = gaps.select("doc_id", F.col("head").alias("sentence_index"), F.lit("not a run from its head").alias("violation"))
    return single.filter("violation is not null").select(*keys, "violation").unionByName(gaps)


def translate_units(units: DataFrame, translate) -> DataFrame:
    """Raw translations of units: ``translate`` maps the marker-joined text column; English is itself."""
    joined = join_constituents(F.col("constituents"))
    return units.withColumn("text_raw", F.when(F.col("lang") == "en", joined).otherwise(translate(joined))).drop(
        "constituents"
    )


def reconcile(raw: DataFrame, spine: DataFrame, min_segment_chars: int = 1) -> tuple[DataFrame, DataFrame]:
    """Final sentences with translations, and the remap of every input sentence.

    A unit splits back where its marked segments are as many as its sentences
    and none is shorter than ``min_segment_chars``; else it becomes one fused
    sentence over the union of the spans. English is kept as it is. Units that
    carry their members need no look at the spine.
    """
    parts = split_translation(F.col("text_raw"), F.col("n"))
    parts = F.when((F.col("n") > 1) & F.forall(parts, lambda x: F.length(x) >= min_segment_chars), parts)
    r = raw.withColumn("parts", parts).withColumn("fused", (F.col("n") > 1) & F.col("parts").isNull())
    unit = ["doc_id", "head", "n", "fused", "text_raw", "parts", F.col("token_count").alias("unit_tokens")]
    if "members" in raw.columns:
        m = r.select(*unit, "lang", F.posexplode("members").alias("at", "_m")).select("*", "_m.*").drop("_m")
    else:
        at = F.posexplode(F.sequence(F.col("head"), F.col("head") + F.col("n") - 1)).alias("at", "sentence_index")
        m = r.select(*unit, at).join(spine.select("doc_id", "lang", *MEMBER), ["doc_id", "sentence_index"])
    text = F.when(
        F.col("n") == 1, F.when(F.col("lang") == "en", F.col("text_raw")).otherwise(scrub_markers(F.col("text_raw")))
    ).otherwise(F.when(F.col("fused"), scrub_markers(F.col("text_raw"))).otherwise(F.try_element_at("parts", F.col("at") + 1)))
    m = m.withColumn("text", text).withColumn("slot", F.when(F.col("fused"), F.col("head")).otherwise(F.col("sentence_index")))
    # Numbered before the slots are gathered: final sentences and remap share the partitioning.
    order = W.partitionBy("doc_id").orderBy("slot")
    m = m.withColumn("final_index", F.dense_rank().over(order) - 1)
    final = m.groupBy("doc_id", "lang", "slot", "final_index").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("paragraph_index", "sentence_index").alias("paragraph_index"),
        F.when(F.first("fused"), F.first("unit_tokens")).otherwise(F.first("token_count")).alias("token_count"),
        F.first("text").alias("text"),
        F.first("fused").alias("fused"),
    )
    remap = m.select(
        "doc_id",
        mint(F.col("doc_id"), "s", F.col("sentence_index")).alias("sentence_id"),
        mint(F.col("doc_id"), "s", F.col("final_index")).alias("final_sentence_id"),
        "fused",
    )
    return final.drop("slot"), remap


def reconcile_violations(final: DataFrame, raw: DataFrame, spine: DataFrame) -> DataFrame:
    """(doc_id, violation): units that don't tile a document, or markers left outside English."""
    covered = raw.groupBy("doc_id").agg(F.sum("n").alias("units"), F.count_distinct("head").alias("heads"), F.count(F.lit(1)).alias("rows"))
    have = spine.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    tiles = have.join(covered, "doc_id", "full").filter(
        F.coalesce("units", F.lit(-1)) != F.coalesce("sentences", F.lit(-2))
    ).select("doc_id", F.lit("units do not tile").alias("violation"))
    marked = final.filter((F.col("lang") != "en") & F.contains("text", F.lit(MARKER))).select(
        "doc_id", F.lit("marker in text").alias("violation")
    )
    return tiles.unionByName(marked)


def length_maxima(sentences: DataFrame, renderings: dict[str, str]) -> DataFrame:
    """``sentences`` with len_<name> of each rendering column and their greatest, len_max."""
    for name, column in renderings.items():
        sentences = sentences.withColumn(f"len_{name}", F.length(column))
    return sentences.withColumn("len_max", F.greatest(*[f"len_{n}" for n in renderings]))


def typed_absence(joined: DataFrame, text: str, lang: str = "lang") -> DataFrame:
    """Rows whose ``text`` is null though only English may lack one."""
    return joined.filter(F.col(text).isNull() & (F.col(lang) != "en"))


def render_passages(passages: DataFrame, sentences: DataFrame, docs: DataFrame) -> DataFrame:
    """Renderings of passages (passage_id, doc_id, first, last): native slice and translated join.

    ``sentences``: doc_id, sentence_index, lang, start, end, translation;
    ``docs``: doc_id, text. English without translations shows the native text;
    a passage of another language with any missing shows null. Spans are code
    points of the native rendering.
    """
    m = passages.select(
        "passage_id", "doc_id", F.explode(F.sequence("first", "last")).alias("sentence_index")
    ).join(sentences, ["doc_id", "sentence_index"])
    g = m.groupBy("doc_id", "passage_id").agg(
        F.first("lang").alias("lang"),
        F.min("start").alias("lo"),
        F.max("end").alias("hi"),
        F.count(F.lit(1)).alias("members"),
        F.count("translation").alias("translated"),
        F.array_sort(F.collect_list(F.struct("sentence_index", "start", "end", "translation"))).alias("parts"),
    )
    g = g.join(docs.select("doc_id", "text"), "doc_id")
    native = F.substr("text", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    joined = F.array_join(F.transform("parts", lambda x: x["translation"]), " ")
    return g.select(
        "passage_id",
        "doc_id",
        "lang",
        native.alias("original"),
        F.when(F.col("translated") == F.col("members"), joined).when((F.col("lang") == "en") & (F.col("translated") == 0), native).alias("rendered"),
        F.transform("parts", lambda x: F.struct((x["start"] - F.col("lo")).alias("start"), (x["end"] - F.col("lo")).alias("end"))).alias("spans"),
    )


def released_native(members: DataFrame) -> DataFrame:
    """Text of members (passage_id, pos, start, end, text), a blank only where spans leave a gap."""
    order = W.partitionBy("passage_id").orderBy("pos")
    m = members.withColumn("before", F.lag("end").over(order))
    m = m.withColumn("piece", F.concat(F.when(F.col("start") > F.col("before"), " ").otherwise(""), F.col("text")))
    return m.groupBy("passage_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), ""
        ).alias("text")
    )
