import statistics
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakewright.operators import agreement, fusion, graph, integrity, legs, ordered, retrieve, rounds
from lakewright.plans.checkpoints import cut


def test_dense_ties_go_to_the_smaller_id_over_partitions(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    for n in (1, 3, 16):
        got = [r["id"] for r in legs.dense_top_k(q, docs.repartition(n), 5).orderBy("rank").collect()]
        assert got == [1, 3, 5, 7, 9]
    assert legs.dense_top_k(q.filter("false"), docs, 5).count() == 0
    assert 1 not in [r["id"] for r in legs.dense_top_k(q.withColumn("query_id", F.lit(1).cast("long")), docs, 5, exclude_self=True).collect()]


def test_max_sim(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((30, 4))
    flat = lambda at: v[at].ravel().tolist()
    rows = [(d, flat(range(3 * d, 3 * d + 3))) for d in range(10)] + [(10, []), (11, None)]
    docs = spark.createDataFrame(rows, "id long, vectors array<double>")
    q = spark.createDataFrame([(7, flat([0, 5])), (8, flat([1])), (9, [])], "query_id long, vectors array<double>")
    every = legs.max_sim_top_k(q, docs, 20, 4).collect()
    assert {x["query_id"] for x in every} == {7, 8} and {x["id"] for x in every} == set(range(10))
    got = {x["id"]: x["score"] for x in every if x["query_id"] == 7}
    for d in range(10):
        assert got[d] == pytest.approx(sum(max(v[k] @ v[j] for j in range(3 * d, 3 * d + 3)) for k in (0, 5)), abs=1e-5)


def test_lexical_leg_equals_the_postings_join(spark):
    texts = ["a b a c", "b b", "", None, "d e f a", "c c c b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = retrieve.words_of(F.col("text"))
    q = spark.createDataFrame([(0, "A b"), (1, "c"), (2, "zz"), (3, None)], "id long, text string")
    post = legs.sparse_top_k(legs.postings(q, words), legs.postings(docs, words, legs.postings(q, words)), 3)
    got = legs.lexical_top_k(q.select(F.col("id").alias("query_id"), words.alias("words")), docs.select("id", words.alias("words")), 3)
    key = lambda df: sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())
    assert key(got) == key(post) and {r[0] for r in key(got)} == {0, 1}


def test_retrieve_takes_every_language_and_no_empty_text(spark):
    rows = [(1, "en", "red fox runs"), (2, "de", "fuchs läuft"), (3, None, "red fox"), (4, "en", ""), (5, "de", None)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    q = spark.createDataFrame([(1, "red fox"), (2, "")], "query_id long, text string")
    p = retrieve.pools(q, docs, 5)
    assert {(r["pool"], r["id"]) for r in p.collect()} == {
        (f"{leg}/{lang}", i) for leg in ("dense", "late") for lang, i in (("en", 1), ("de", 2), ("-", 3))
    } | {("sparse/en", 1), ("sparse/-", 3)}
    out = retrieve.retrieve(q, docs, top_k=3, rerank_depth=2).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 3, 2] and {r["query_id"] for r in out} == {1}
    assert retrieve.retrieve(q, docs.filter("false")).count() == 0 and retrieve.retrieve(q.filter("false"), docs).count() == 0


def test_rrf_and_rerank(spark):
    pools = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query_id int, pool int, id string, rank int")
    fused = fusion.rrf(pools)
    got = {r["id"]: (r["rank"], r["score"]) for r in fused.collect()}
    assert got["b"] == (1, 1 / 62 + 1 / 61) and got["a"][0] == 2 and got["c"][0] == 3
    out = fusion.rerank_head(fused, lambda h: h.withColumn("rerank", F.when(F.col("id") == "a", 1.0).otherwise(0.0)), depth=2, top_k=3)
    assert [r["id"] for r in out.orderBy("rank").collect()] == ["a", "b", "c"]


def test_pruning_keeps_the_heaviest(spark):
    p = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0), (1, "d", -1.0)], "id int, term string, weight double")
    assert [r["term"] for r in legs.prune_postings(p, 2).orderBy("term").collect()] == ["a", "c"]


@pytest.mark.parametrize("n", [2, 3, 4, 7, 10])
def test_quartiles_follow_the_standard_library(spark, n):
    xs = [float((i * 37) % 11) for i in range(n)]
    row = agreement.exclusive_quartiles(spark.createDataFrame([("g", x) for x in xs], "g string, x double"), "x", ["g"]).first()
    assert [row["q1"], row["q2"], row["q3"]] == pytest.approx(statistics.quantiles(xs, n=4))


def test_rank_statistics(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3, 4])], "a array<int>, b array<int>")
    row = df.select(agreement.jaccard(F.col("a"), F.col("b")), agreement.rbo(F.col("a"), F.col("b"), 0.5)).first()
    assert row[0] == 0.5
    assert row[1] == pytest.approx((1 + 0.5 * 1 / 2 + 0.25 * 2 / 3) / 1.75)
    lists = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "q int, id string, rank int")
    tau = agreement.kendall_tau(lists("abcd"), lists("badc"), ["q"]).first()
    assert (tau["shared"], tau["tau"]) == (4, pytest.approx(2 / 6))
    one = agreement.kendall_tau(lists("ab"), lists("bz"), ["q"]).first()
    assert (one["shared"], one["tau"]) == (1, None)


def test_saturation_and_carry(spark):
    s = spark.createDataFrame([("t", 0, 9), ("t", 1, 1), ("t", 2, 0), ("t", 3, 4)], "topic_id string, round int, novelty long")
    assert [r["saturated"] for r in rounds.saturation(s).orderBy("round").collect()] == [False, False, True, False]
    c = rounds.carry_forward(s.select("topic_id", "round", F.col("novelty").alias("size")).filter("round <> 2"), 4)
    assert [(r["size"], r["gap"]) for r in c.orderBy("round").collect()] == [(9, False), (1, False), (1, True), (4, False), (4, True)]


def test_ordered_operators(spark):
    r = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "a")], "k int, o int, v string")
    isles = ordered.islands(r, ["k"], ["o"], "v")
    assert [x["island"] for x in isles.orderBy("o").collect()] == [0, 0, 1, 2]
    assert [tuple(x) for x in ordered.split_runs(isles, ["k"], "v").collect()] == [(1, "a", 2)]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y")], "k int, s int, v string")
    got = {(x["k"], x["t"]): x["v"] for x in ordered.as_of(left, right, by="k", at="t", start="s", value="v").collect()}
    assert got == {(1, 5): "y", (1, 1): None, (2, 9): None}
    p = ordered.parts(r, ["k"], ["o"], 3)
    assert [(x["part"], x["place"]) for x in p.orderBy("o").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert ordered.part_violations(p, ["k"], 3).count() == 0
    assert ordered.part_violations(p.filter("o <> 0"), ["k"], 3).count() == 1


@pytest.mark.parametrize("n", [1, 5])
def test_components_of_a_path_a_star_and_a_loop(spark, n):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(8, 20)] + [(50, 50)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(n)
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, **{i: 7 for i in range(7, 20)}, 50: 50}
    assert graph.connected_components(df.filter("false")).count() == 0


def test_estimated_sizes_stay_bounded_over_rounds(spark):
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    order = [i * 37 % 101 for i in range(101)]
    path = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")
    found = graph.connected_components(path)
    assert size(found).bit_length() <= 63
    assert [tuple(r) for r in found.orderBy("node").collect()] == [(i, 0) for i in range(101)]
    odd = spark.createDataFrame([(1, [1, None], None), (1, [], "x"), (2, None, "y")], "k int, a array<int>, s string")
    twice = cut(odd.join(odd.select("k", F.col("s").alias("t")), "k").join(odd.select("k"), "k").repartition(3, "k"))
    assert size(twice).bit_length() <= 63 and twice.count() == 9
    assert sorted(map(str, twice.groupBy("k", "a", "s").count().collect())) == sorted(
        map(str, [Row(k=1, a=[1, None], s=None, count=4), Row(k=1, a=[], s="x", count=4), Row(k=2, a=None, s="y", count=1)])
    )


def test_shuffle_files_go_with_the_checkpoint_made_of_them(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffled()
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    sums = rows.repartition(3, "k").groupBy("k").count()
    kept = cut(sums.join(rows.hint("merge"), "k"))
    late = time.time() + 20
    while shuffled() - before and time.time() < late:
        time.sleep(0.1)
    assert not shuffled() - before
    assert kept.count() == 1000 and cut(sums).agg(F.sum("count")).first()[0] == 1000 and sums.count() == 7


def test_set_checks(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert {(r["id"], r["side"]) for r in integrity.set_difference(a, b, "id").collect()} == {(1, "left only"), (2, "twice"), (3, "right only")}
    x = integrity.set_digest(a.distinct().withColumn("g", F.lit(1)), "id", ["g"]).first()["digest"]
    y = integrity.set_digest(a.distinct().orderBy(F.desc("id")).withColumn("g", F.lit(1)), "id", ["g"]).first()["digest"]
    assert x == y


def test_candidate_depth():
    from lakewright.operators import fusion

    assert [fusion.candidate_depth(*x) for x in ((20, 100), (20, 0), (0, 0))] == [100, 20, 1]


def test_slices_are_contiguous_and_even(spark):
    from lakewright.operators import ordered

    for n, width in ((10, 3), (2, 5), (7, 7), (1, 1)):
        rows = spark.createDataFrame([("p", i) for i in range(n)], "part string, id int")
        got = [r["slice"] for r in ordered.slices(rows, ["part"], ["id"], width).orderBy("id").collect()]
        want = [next(i for i in range(width) if i * n // width <= k < (i + 1) * n // width) for k in range(n)]
        assert got == want


def test_first_mismatch_sees_ends_and_nulls(spark):
    from lakewright.operators import integrity

    rows = lambda x: spark.createDataFrame(x, "p string, at int, v string")
    left = rows([("a", 0, "x"), ("a", 1, None), ("b", 0, "x"), ("b", 1, "y"), ("c", 0, "x")])
    right = rows([("a", 0, "x"), ("a", 1, None), ("b", 0, "x"), ("c", 0, "z"), ("d", 0, None)])
    got = {r["p"]: r["at"] for r in integrity.first_mismatch(left, right, ["p"], "at", "v").collect()}
    assert got == {"b": 1, "c": 0, "d": 0}
