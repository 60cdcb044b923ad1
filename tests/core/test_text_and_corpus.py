import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.operators import boilerplate, segment, translation


def values(spark, column, rows):
    df = spark.createDataFrame([Row(i=i, x=x) for i, x in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_ids_and_questions(spark):
    assert values(spark, T.doc_id_of(F.col("x")), ["d#p1", "d#s2", "d"]) == ["d", "d", "d"]
    assert values(spark, T.question_of(F.col("x")), ["Why? Because", "no", " What ? "]) == ["Why?", "", "What ?"]


def test_unicode_space_and_markers(spark):
    assert values(spark, T.utrim(F.col("x")), [" a b ", "", None]) == ["a b", "", None]
    assert values(spark, T.scrub_markers(F.col("x")), ["a § b", "§a§"]) == ["a b", "a"]
    assert values(spark, T.split_translation(F.col("x"), F.lit(2)), ["a § b", "a b", "a § b § c", "a § "]) == [["a", "b"], None, None, None]


def test_normal_forms(spark):
    assert values(spark, T.nfc(F.col("x")), ["é", None]) == ["é", None]
    assert values(spark, T.nfkc_len(F.col("x")), ["ﬃ", None]) == [3, None]
    df = spark.createDataFrame([(2.0**-10,), (None,)], "x double")
    assert [r[0] for r in df.select(T.fixed9("x")).collect()] == ["0.000976562", None]


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("Home > News > Sport", "nav_breadcrumb"),
        ("Accept all cookies", "cookie_consent"),
        ("Facebook | Twitter | Email", None),
        ("Facebook | Tweet | Email", "social_share"),
        ("By Jane Doe", "dateline_byline"),
        ("by jane doe", "dateline_byline"),
        ("© 2020 Example", "copyright_footer"),
        ("copyright law was broken", None),
        ("Read more about this", "read_more_pagination"),
        ("A plain sentence about cookies and other food in the shop.", None),
        ("x > y", None),
    ],
)
def test_chrome_rules(spark, line, rule):
    df = boilerplate.flag_lines(spark.createDataFrame([(line,)], "line string")).first().asDict()
    hits = [k for k, v in df.items() if v is True and k != "is_chrome"]
    assert hits == ([rule] if rule else []) and df["is_chrome"] == bool(rule)


def test_second_rule_version(spark):
    lines = ["comments / 0", "{{ x }}", "3 days ago", "+2", "Подписывайтесь на наш канал", "Подписаться на услугу банка", "word"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [r[0] for r in df.orderBy("i").select(boilerplate.is_chrome(F.col("line"), "v2")).collect()]
    assert got == [True, True, True, True, True, False, False]
    with pytest.raises(ValueError):
        boilerplate.rules("v3")


def test_mining_and_marking(spark):
    df = spark.createDataFrame([(d, x) for d in (1, 2, 3) for x in ("• Related:", f"own {d}")], "doc_id int, line string")
    mined = boilerplate.mine_chrome(df, 3)
    assert [tuple(r) for r in mined.collect()] == [("related", 3, 3)]
    assert boilerplate.mark_mined(df, mined).filter("mined").count() == 3


def doc(spark, text, lang="de", i=1):
    return spark.createDataFrame([(i, lang, text)], "doc_id long, lang string, text string")


def test_paragraph_modes(spark):
    text = "One.\nTwo.\n\nBy Jane Doe\nThree."
    blank = segment.paragraphs(doc(spark, text)).first()
    assert blank["paragraphs"] == ["One. Two.", "Three."] and blank["text"] == "One. Two. Three."
    assert segment.paragraphs(doc(spark, text), mode="line").first()["paragraphs"] == ["One.", "Two.", "Three."]
    assert segment.paragraphs(doc(spark, "By Jane Doe")).first()["paragraphs"] == []
    assert segment.paragraphs(doc(spark, None)).first()["paragraphs"] == []


def test_spans_index_the_text(spark):
    text = "Ein Satz. Noch 😀 einer!  Und\n\n… drei? Rest"
    paras = segment.paragraphs(doc(spark, text), strip=None)
    rows = segment.sentences(paras).orderBy("sentence_index").collect()
    whole = paras.first()["text"]
    assert [r["sentence"] for r in rows] == [whole[r["start"] : r["end"]] for r in rows]
    assert [r["sentence_index"] for r in rows] == list(range(len(rows)))
    assert segment.span_violations(segment.sentences(paras), paras).count() == 0
    broken = segment.sentences(paras).withColumn("start", F.col("start") + 1)
    assert segment.span_violations(broken, paras).count() == len(rows)


def test_reconcile_splits_and_fuses(spark):
    spine = segment.sentences(segment.paragraphs(doc(spark, "A a. B b. C c. D d."), strip=None))
    raw = translation.units_of(spine).drop("constituents").withColumn(
        "text_raw", F.when(F.col("head") == 0, "X § Y").otherwise("only § one § more")
    )
    final, remap = translation.reconcile(raw, spine)
    got = [(r["final_index"], r["start"], r["end"], r["text"], r["fused"]) for r in final.orderBy("final_index").collect()]
    assert got == [(0, 0, 4, "X", False), (1, 5, 9, "Y", False), (2, 10, 19, "only one more", True)]
    ids = [(r["sentence_id"], r["final_sentence_id"]) for r in remap.orderBy("sentence_id").collect()]
    assert ids == [("1#s0", "1#s0"), ("1#s1", "1#s1"), ("1#s2", "1#s2"), ("1#s3", "1#s2")]
    assert translation.reconcile_violations(final, raw, spine).count() == 0
    assert translation.reconcile_violations(final, raw.filter("head = 0"), spine).count() == 1


def test_english_keeps_its_markers(spark):
    spine = segment.sentences(segment.paragraphs(doc(spark, "See § 5. End.", "en"), strip=None))
    raw = translation.translate_units(translation.units_of(spine), F.upper)
    final, _ = translation.reconcile(raw, spine)
    assert [r["text"] for r in final.orderBy("final_index").collect()] == ["See § 5.", "End."]


def test_merge_map_is_total_and_names_its_faults(spark):
    spine = spark.createDataFrame([(1, "de", i) for i in range(4)] + [(2, "en", 0)], "doc_id long, lang string, sentence_index int")
    units = spark.createDataFrame([(1, "de", 0, 2), (1, "de", 2, 2), (2, "en", 0, 1)], "doc_id long, lang string, head int, n int")
    m = translation.merge_map(units)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(m) == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 2)]
    assert rows(translation.unit_heads(m)) == [(1, 0, 0), (1, 2, 2)]
    assert rows(translation.merge_map_violations(m, spine)) == []
    assert rows(translation.merge_map_violations(m.filter("false"), spine.filter("false"))) == []
    bad = m.filter("sentence_index <> 2").union(spark.createDataFrame([(1, 0, 0), (2, 0, 0)], m.schema))
    assert rows(translation.merge_map_violations(bad, spine)) == [
        (1, 0, "in two units"), (1, 2, "no unit"), (1, 2, "not a run from its head"), (2, 0, "not of the spine")
    ]
