"""What is done per sentence: no text is sorted beside its sentences, no expression searches a text for its ends."""

from lakewright.functions import text as T
from lakewright.operators import segment
from pyspark.sql import functions as F


def _spine(spark):
    docs = spark.createDataFrame([(1, "en", " One two.　Three!\n Four \x85 five ")], "doc_id long, lang string, text string")
    paras = segment.paragraphs(docs, mode="line", strip=None)
    return paras, segment.sentences(paras)


def test_spans_are_sorted_before_texts_are_joined(spark):
    paras, spine = _spine(spark)
    out = segment.span_violations(spine, paras)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")
    assert out.count() == 0


def test_sentences_are_trimmed_and_counted_without_replacing(spark):
    spine = _spine(spark)[1]
    assert "regexp_replace" not in spine._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.start, r.end, r.sentence, r.token_count) for r in spine.orderBy("sentence_index").collect()]
    assert got == [(0, 8, "One two.", 2), (9, 15, "Three!", 1), (16, 27, "Four \x85 five", 2)]


def test_white_space_is_what_regular_expressions_call_so(spark):
    rows = spark.createDataFrame([(chr(c),) for c in range(1, 0xD800)], "c string").select(F.concat("c", F.lit("a"), "c", F.lit("b"), "c").alias("x"), "c")
    same = (T.utrim(F.col("x")) == F.regexp_replace("x", r"(?U)^\s+|\s+$", "")) & (
        T.lead_of(F.col("x")) == F.length(F.regexp_extract("x", r"(?U)^\s*", 0))
    )
    assert rows.filter(~same).count() == 0
    assert rows.filter(T.word_count(F.col("c")) == 0).count() == len(T.WHITE)
