import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import langid, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(spark, n=400):
    r = random.Random(4)
    syllables = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = [word() for _ in range(r.randint(20, 80))]
        if toxic:
            for _ in range(4):
                w.insert(r.randint(0, len(w)), r.choice(["vexatious", "scoundrel", "blackguard"]))
        docs.append((i, " ".join(w), "xx", "s"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_never_sees_held_out_labels(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    out = [i for i in got if held(i)]
    assert sum((got[i] >= 0.3) == truth[i] for i in out) / len(out) >= 0.95
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs.repartition(3), flipped.repartition(5)) == model
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")).withColumn("score", F.lit("clash"))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(other, model).collect()} == got


def test_toxicity_edges(spark):
    docs, labels = corpus(spark, 60)
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "vexatious"), (5, "\x00😀 " + "long " * 60_000)] * 2, "doc_id long, text string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(odd.filter("false"), model).count() == 0
    blank = toxicity.train(docs, labels.filter("false"))
    assert len(set(blank.score(["a", "b c"]))) == 1
    one_class = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)))
    assert max(one_class.score(["vexatious"])) < 0.3


def test_toxicity_calibration_converges_where_whole_newton_steps_overshoot():
    x = np.zeros((1000, toxicity.FEATURES))
    x[:, 0] = (np.arange(1000) % 100 / 20) ** 4 / 100
    y = (x[:, 0] >= 5).astype(float)
    model = toxicity.ToxicityModel(b"", b"")
    model.calibrate(x, y)
    z = model.weights[0] + (x - model.mean) / model.scale @ np.array(model.weights[1:])
    found = z >= np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    assert found[y == 1].all() and found[y == 0].mean() < 0.02
    assert np.abs(model.weights).max() < 1000


def languages(spark, n=90):
    r = random.Random(5)
    alphabets = {"aa": ["sch", "ung", "der", "ich", "ä"], "bb": ["tion", "the", "ing", "ou"], "cc": ["да", "нет", "мы", "что"]}
    rows = []
    for i in range(n):
        lang = list(alphabets)[i % 3]
        rows.append((i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)), lang, "s"))
    return spark.createDataFrame(rows, DOCS)


def test_languages_are_told_apart(spark):
    docs = languages(spark)
    model = langid.train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = langid.identify(docs.withColumn("lang", F.lit("clash")).withColumn("score", F.lit("clash")), model).collect()
    assert all(r["lang_pred"] == truth[r["doc_id"]] and r["score"] > 0.9 for r in out)
    wrong = docs.withColumn("lang", F.when(toxicity.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert langid.train(wrong).languages == model.languages


def test_language_edges(spark):
    model = langid.train(languages(spark))
    texts = [None, "", "123 !?", "der ich", "ДА МЫ", "\U00010400\U00010401", "the " * 100_000, "q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(out[i]["score"] == 0 for i in range(3))
    assert [out[i]["lang_pred"] for i in (3, 4, 6)] == ["aa", "cc", "bb"]
    assert all(out[i]["lang_pred"] in model.languages and 0 <= out[i]["score"] <= 1 for i in (5, 7))
    assert langid.identify(df.filter("false"), model).count() == 0
    empty = langid.train(languages(spark).filter("false"))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"}


def test_a_language_not_learned_is_rejected(spark):
    docs = languages(spark, 240)
    model = langid.train(docs)
    r = random.Random(9)
    known = langid.identify(docs, model)
    assert known.filter("rejected").count() <= 0.02 * docs.count()
    other = ["".join(r.choice("szcżłwykoprj ") for _ in range(200)) for _ in range(20)] + ["zzzz qqqq", "ααβ γγδ εζη θικ"]
    df = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    assert langid.identify(df, model).filter("rejected").count() == len(other)


def test_held_out_toxicity(spark):
    """Of the labelled rows that nothing is learned from, on the larger tables."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    out = toxicity.query(spark, folder).join(labels, "doc_id").filter("held_out")
    rows = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert rows.get((1, 1), 0) / (rows.get((1, 1), 0) + rows.get((1, 0), 0)) >= 0.6
    assert rows.get((0, 1), 0) <= 0.05 * rows[0, 0]


def test_kneser_ney_sums_to_one():
    model = langid.fit({"x": {"aba": 3, "bab": 2, "abc": 1, "bca": 1, "cab": 4}})
    import numpy as np

    known = np.array(sorted(map(ord, "abc")), np.uint64)
    for a in "abc":
        for b in "abc":
            total = 0.0
            for c in known:
                total += np.exp(-model.entropies(np.array([ord(a), ord(b), c], np.uint64))[0])
            total += np.exp(-model.entropies(np.array([ord(a), ord(b), ord("z")], np.uint64))[0])
            assert total == pytest.approx(1.0, abs=1e-6)


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = langid.query(spark, sf_dir).join(docs, "doc_id").filter("held_out")
    assert out.filter("lang_pred <> lang").count() == 0 and out.count() > 20
    tox = toxicity.query(spark, sf_dir)
    assert tox.count() == docs.count() and tox.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
