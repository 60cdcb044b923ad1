import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import acceptance, context
from lakewright.plans import stage


def test_budget_passes_over_and_goes_on(spark):
    rows = [(1, 1, "a", "x" * 6), (1, 2, "b", "x" * 6), (1, 3, "c", "x" * 4), (2, 1, "d", "x" * 99)]
    shown = context.within_budget(spark.createDataFrame(rows, "query_id int, rank int, id string, text string"), 10)
    assert {r["id"]: r["shown"] for r in shown.collect()} == {"a": True, "b": False, "c": True, "d": False}
    blocks = {r["query_id"]: r["block"] for r in context.passage_block(shown, "original").collect()}
    assert blocks[1] == "PASSAGES (2, rendering=original):\n\n[1] passage_id=a\nxxxxxx\n\n[2] passage_id=c\nxxxx\n\n(1 more did not fit)"
    assert blocks[2] == "PASSAGES: none."


@pytest.mark.parametrize(
    ("span", "text", "quote"),
    [
        ('he said "no"', "Then HE said  “No” twice", "HE said  “No”"),
        ("straße", "Die STRASSE hier", "STRASSE"),
        ("absent", "nothing of it", None),
        ("", "x", None),
        ("a-b", "a–b", "a–b"),
    ],
)
def test_closest_quote(span, text, quote):
    assert context.closest_quote(span, text) == quote


def test_near_misses_column(spark):
    df = spark.createDataFrame([("A b", "x a  B y"), (None, "x")], "span string, text string")
    assert [r["quote"] for r in context.near_misses(df).collect()] == ["a  B", None]


def test_services_must_be_fresh(spark):
    df = spark.createDataFrame([("b", "o", 100), ("a", "o", 95), ("c", "o", 10), ("d", "t", 100)], "name string, rendering string, s long")
    live = context.live_services(df.withColumn("beat", F.timestamp_seconds("s")), "o", F.timestamp_seconds(F.lit(101)), 10)
    assert [r["name"] for r in live.collect()] == ["a", "b"]


def test_fingerprints_ignore_order_and_show_leaks(spark):
    rows = [("v1", "a", "q?", "OR"), ("v1", "b", "r?", "AND"), ("v2", "b", "r?", "AND"), ("v2", "a", "q?", "OR"), ("v3", "a", "q!", "OR"), ("v3", "b", "r?", "AND")]
    df = spark.createDataFrame(rows, "variant string, nugget_id string, question string, aggregator_type string")
    prints = acceptance.bank_fingerprint(df, ["variant"]).withColumn("topic", F.lit("t"))
    got = {r["variant"]: r["fingerprint"] for r in prints.collect()}
    assert got["v1"] == got["v2"] != got["v3"]
    assert acceptance.parity_violations(prints, ["topic"]).first()["prints"] == 2
    assert acceptance.parity_violations(prints.filter("variant <> 'v3'"), ["topic"]).count() == 0


def test_self_retrieval_excuses_ties_only(spark):
    rows = [(1, 1, 1.0, 1), (1, 2, 0.4, 2), (2, 8, 1.0, 1), (2, 9, 1.0, 2), (3, 8, 1.0, 1), (3, 9, 0.5, 2)]
    df = spark.createDataFrame(rows, "query_id int, id int, score double, rank int")
    got = {r["query_id"]: (r["found"], r["excused"], r["passed"]) for r in acceptance.self_retrieval(df).collect()}
    assert got == {1: (True, False, True), 2: (False, True, True), 3: (False, False, False)}


def test_manifests(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, rows int")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "name string, rows int")
    assert {r["name"] for r in acceptance.manifest_violations(a, b).collect()} == {"y", "z"}
    f = spark.createDataFrame([("r", 0, "c1", "m1"), ("r", 1, "c1", "m2"), ("s", 0, "c1", "m1"), ("s", 1, "c2", "m1")], "run string, part int, collection string, model string")
    got = {r["run"]: (r["collection"], r["model"], r["conflicts"]) for r in acceptance.reduce_manifests(f, "run", ["collection"], ["model"]).collect()}
    assert got == {"r": ("c1", ["m1", "m2"], []), "s": (None, ["m1"], ["collection"])}


def test_shared_blocks_of_configurations(spark):
    one, two = "a:\n  x: 1\nb: 2\n", "b: 2\na:\n  x: 2"
    df = spark.createDataFrame([("1", one), ("2", two)], "name string, text string")
    got = {(r["name"], r["block"]): r["digest"] for r in acceptance.text_blocks(df).collect()}
    assert got["1", "a"] != got["2", "a"] and len(got) == 4


def test_truncation_and_units(spark):
    df = spark.createDataFrame([(["s", "a", "b", "c", "e"],)], "t array<string>")
    cut = lambda m, k: df.select(acceptance.truncated(F.col("t"), m, k)).first()[0]
    assert cut(4, 1) == ["s", "a", "b", "e"] and cut(3, 0) == ["s", "a", "e"] and cut(5, 1) == ["s", "a", "b", "c", "e"]
    rows = [("u", 0, 2, "d", 4), ("u", 1, 2, "d", 5), ("v", 0, 2, "d", 6), ("w", 0, 2, "d", 1), ("w", 1, 2, "e", 2), ("x", 0, 2, "d", 8), ("x", 1, 2, "d", 10)]
    m = spark.createDataFrame(rows, "unit_id string, place int, n int, doc_id string, sentence_index int")
    got = {r["unit_id"]: r["violation"] for r in acceptance.unit_violations(m).collect()}
    assert got == {"v": "count is not the members", "w": "several documents", "x": "sentences not neighbours"}


def test_same_answers_merge_in_order():
    a = lambda t, s, refs: {"answer": t, "score": s, "references": refs, "support": [t]}
    x = np.array([[1.0, 0], [1, 0], [0, 1], [1, 0]])
    rows = [a("p", 0.1, {1: 0.1}), a("q", 0.9, {1: 0.5, 2: 0.2}), a("r", 0.3, {}), a("p", 0.2, {3: 0.3})]
    got = acceptance.merge_same_answers(rows, x, 0.9, lambda l, r: (l, r) != ("p", "q"))
    assert [(g["answer"], g["score"], g["references"]) for g in got] == [("p", 0.2, {1: 0.1, 3: 0.3}), ("q", 0.9, {1: 0.5, 2: 0.2}), ("r", 0.3, {})]


def test_stages_stop_at_violations(spark):
    class Twice:
        name = "twice"

        def build(self, t):
            return t["n"].select((F.col("id") * 2).alias("id"))

        def violations(self, t, out):
            return out.filter("id > 4")

    tables = {"n": spark.range(3)}
    assert stage.run_stages([Twice()], tables, lambda name, df: df)["twice"].count() == 3
    with pytest.raises(stage.ViolationsFound):
        stage.run_stages([Twice()], {"n": spark.range(9)}, lambda name, df: df)
    done = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "node string, done boolean")
    assert {r["node"]: r["done"] for r in stage.nodes_done(done).collect()} == {"a": False, "b": True}
    assert stage.expand_seeds(spark.range(2), 3).count() == 6
