import random

import pytest
from pyspark.sql import functions as F

from lakewright.llm import mixing

DOCS = "doc_id long, source string, text string"


def words(n):
    return " ".join(["w"] * n)


def by_resharing(sizes, weights, cap=3):
    """Targets as the contract words it: share, cap, share the excess, until none is above."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i] + 1e-9]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


@pytest.mark.parametrize("seed", range(12))
def test_targets_follow_resharing(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, 40, 900]) for _ in range(r.randint(1, 9))]
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.source_targets(df).collect()}
    want = by_resharing(sizes, [1 + i % 3 for i in range(len(sizes))])
    if sum(sizes):
        assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def by_seats(sizes, seats):
    got = [0] * len(sizes)
    for _ in range(seats):
        k = min((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (-sizes[i] / (2 * got[i] + 1), i))
        got[k] += 1
    return got


@pytest.mark.parametrize("seed", range(12))
def test_seats_follow_the_highest_quotients(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for g in range(4):
        sizes = [r.choice([0, 1, 1, 2, 7, 50, 333]) for _ in range(r.randint(2, 8))] + [3]
        seats = r.choice([0, 1, 2, 10, 97])
        rows += [(g, i, float(s), seats) for i, s in enumerate(sizes)]
        want |= {(g, i): n for i, n in enumerate(by_seats(sizes, seats))}
    df = spark.createDataFrame(rows, "g int, party int, size double, seats long")
    got = {(x["g"], x["party"]): x["got"] for x in mixing.sainte_lague(df, ["g"], "party", "size", "seats").collect()}
    assert got == want


def docs_of(spark, n=400):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), words(r.randint(0, 60)) if i % 17 else None) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_its_targets_and_reruns_agree(spark):
    docs = docs_of(spark)
    one = mixing.mix_sources(docs, shard_words=2_000)
    two = mixing.mix_sources(docs.repartition(7), shard_words=2_000)
    rows = sorted(one.collect(), key=str)
    assert rows == sorted(two.collect(), key=str) and len(rows) == 400
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for s in ("a", "b", "c", None):
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=16 + 1)


def test_mix_edges(spark):
    none = docs_of(spark).filter("false")
    assert mixing.mix_sources(none).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (1, "a", ""), (None, None, " \t")], DOCS)
    assert [(r["size"], r["taken"]) for r in mixing.mix_sources(blank).collect()] == [(0, 0)] * 3
    same = spark.createDataFrame([(1, "a", words(10))] * 3, DOCS).withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    assert sum(r["taken"] for r in mixing.mix_sources(same).collect()) <= 30


def test_word_count_splits_on_ascii_space_only(spark):
    df = spark.createDataFrame([("a\u00a0b c\x0bd",)], "t string")
    assert df.select(mixing.word_count(F.col("t"))).first()[0] == 3
