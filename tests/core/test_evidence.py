import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import dedup, evidence


def answer(nugget, index, weight, score, sentence, docs):
    return {"nugget_id": nugget, "answer_index": index, "weight": weight, "score": score, "sentence": sentence, "docs": docs}


def test_report_takes_the_best_answer_of_each_nugget_first():
    rows = [
        answer("a", 0, 0.9, 0.5, "first a", [1]),
        answer("a", 1, 0.9, 0.8, "second a", [2]),
        answer("b", 0, 0.1, 0.9, "only b", [3]),
    ]
    assert evidence.fill_report(rows, 1000) == [("second a", [2]), ("only b", [3]), ("first a", [1])]


def test_report_merges_what_was_said_and_skips_what_does_not_fit():
    rows = [
        answer("a", 0, 0.9, 1.0, "Same  thing", [1]),
        answer("b", 0, 0.8, 1.0, "same thing", [2, 3]),
        answer("c", 0, 0.7, 1.0, "x" * 100, [4]),
        answer("d", 0, 0.6, 1.0, "short", [5]),
        answer("e", 0, 0.5, 1.0, "uncited", []),
    ]
    assert evidence.fill_report(rows, 20) == [("Same  thing", [1, 2, 3]), ("short", [5])]


def test_report_falls_back():
    assert evidence.fill_report([answer("a", 0, 1, 1, "uncited", [])], 50) == [(evidence.FALLBACK, [])]
    assert evidence.fill_report([], 50) == [(evidence.FALLBACK, [])]


def test_report_counts_compatibility_forms():
    # One ligature counts as three letters.
    assert evidence.fill_report([answer("a", 0, 1, 1, "ﬃ", [1])], 2) == [(evidence.FALLBACK, [])]


@pytest.mark.parametrize("seed", range(5))
def test_greedy_survivors_against_pairwise_scan(seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = dedup.greedy_survivors(list(range(40)), x, 0.7)
    kept = []
    for i in range(40):
        close = [(-round(float(x[k] @ x[i]), 9), n, k) for n, k in enumerate(kept) if round(float(x[k] @ x[i]), 9) >= 0.7]
        if close:
            assert got[i] == min(close)[2]
        else:
            assert got[i] == i
            kept.append(i)


def test_greedy_asks_the_next_when_refused():
    x = np.array([[1.0, 0], [0.8, 0.6], [0.95, 0.3122498999199199]])
    assert dedup.greedy_survivors([0, 1, 2], x, 0.9) == [0, 1, 0]
    assert dedup.greedy_survivors([0, 1, 2], x, 0.9, lambda kept, new: kept != 0) == [0, 1, 1]


def test_similar_pairs_match_all_pairs(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i % 2, i, x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, vector array<double>")
    got = {(r["a"], r["b"]) for r in dedup.similar_pairs(df, 0.9, "g").collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and round(float(x[i] @ x[j]), 9) >= 0.9}
    assert got == want


@pytest.mark.parametrize("sizes", [(3,), (2, 5), (17, 1)])
def test_ties_part_strictly(spark, sizes):
    rows, rank = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rank += 1
            rows.append((1, rank, 10.0 - g * 0.001, rank))
    out = evidence.separate_ties(spark.createDataFrame(rows, "topic_id int, doc_id int, total double, rank int"))
    scores = [r["score"] for r in out.orderBy("rank").collect()]
    assert all(a > b for a, b in zip(scores, scores[1:]))
    assert scores[0] == 10.0 and out.filter(~F.col("separable")).count() == 0
    assert evidence.run_violations(out).count() == 0


def test_known_tie_group(spark):
    rows = [(1, "A", 6.0, 1), (1, "B", 6.0, 2), (1, "C", 6.0, 3), (1, "D", 5.0, 4)]
    out = evidence.separate_ties(spark.createDataFrame(rows, "topic_id int, doc_id string, total double, rank int"))
    assert [round(r["score"], 7) for r in out.orderBy("rank").collect()] == [6.0, 5.5000005, 5.000001, 5.0]


def test_run_violations_are_found(spark):
    rows = [(1, "a", 1, 3.0), (1, "a", 2, 3.0), (1, "b", 4, 1.0)]
    got = evidence.run_violations(spark.createDataFrame(rows, "topic_id int, doc_id string, rank int, score double"))
    assert {r["violation"] for r in got.collect()} == {"document repeats", "score does not fall", "rank is not the place"}


def test_grounding_ladder(spark):
    claims = [("", "c", "p"), ("s", " ", "p"), ("s", "c", None), ("s", "c", "q"), ("z", "c", "p"), ("s", "c", "p")]
    c = spark.createDataFrame([(1, i, *x) for i, x in enumerate(claims)], "loop_id int, i int, span string, claim string, passage_id string")
    shown = spark.createDataFrame([(1, "p", "a s b")], "loop_id int, passage_id string, text string")
    got = [r["verdict"] for r in evidence.ground(c, shown).orderBy("i").collect()]
    assert got == ["empty span", "empty claim", "no passage", "passage not shown", "span not in passage", "grounded"]


def test_last_complete_round_stops_at_a_gap(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1)], "topic_id string, round int")
    got = {r["topic_id"]: r["through"] for r in evidence.last_complete_round(df).collect()}
    assert got == {"a": 1, "b": None}


def test_grounding_compares_composed_texts(spark):
    claims = [(1, "c", "e\u0301te\u0301", 1), (2, "c", "\u00a0", 1), (3, "c", "\u00e9t\u00e9", 1)]
    df = spark.createDataFrame([(1, *c[1:3], c[3], c[0]) for c in claims], "loop_id int, claim string, span string, passage_id int, k int")
    shown = spark.createDataFrame([(1, 1, "un \u00e9te\u0301 chaud")], "loop_id int, passage_id int, text string")
    assert {r["k"]: r["verdict"] for r in evidence.ground(df, shown).collect()} == {1: "grounded", 2: "empty span", 3: "grounded"}
