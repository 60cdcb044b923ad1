import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.llm import embed_dedup, minhash


def union(n_links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in n_links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def by_hand(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    find = union(links)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=6, copies=25):
    """Chains: each copy changes a few words of an earlier one, so links are not all direct."""
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        made = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([30, 90, 200]))]]
        for _ in range(copies):
            w = list(r.choice(made))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            made.append(w)
        for w in made:
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2_000_000, 1_500])
def test_components_match_all_pairs(spark, block):
    rows = near_copies(block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, words=4, block_shingles=block).collect()}
    assert got == by_hand(rows)


@pytest.mark.parametrize("seed", range(15))
def test_search_inside_a_block_is_exact(seed):
    r = random.Random(seed)
    base = [r.randint(0, 10**9) for _ in range(30)]
    sets = [np.unique(np.array(r.sample(base, r.randint(20, 30)) + [r.randint(0, 10**9) for _ in range(r.randint(0, 3))], np.uint64)) for _ in range(40)]
    ids = np.array(r.sample(range(1000), 40))
    labels = np.array([ids[0] if i < 3 else ids[i] for i in range(40)])
    links = [(int(ids[0]), int(ids[1])), (int(ids[0]), int(ids[2]))]
    for i in range(40):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                links.append((int(ids[i]), int(ids[j])))
    find = union(links)
    assert minhash.linked_components(ids, sets, labels).tolist() == [find(int(i)) for i in ids]


def test_text_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three four"), (None, "one two"), (8, "É x"), (9, "é x"), (4, "One two"), (4, "other text of this id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rep", F.lit("clash"))
    out = collections.defaultdict(set)
    for r in minhash.near_duplicates(df, words=4).collect():
        out[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert out[1] == out_of(0, 1) and out[2] == out_of(0, 2) and out[3] == out_of(0, 3)
    assert out[4] == {(1, 4, True), (2, 4, True)} and out[5] == {(1, 4, False)} and out[6] == out_of(1, 6)
    assert out[None] == {(1, None, True)} and out[8] == out_of(1, 8) and out[9] == out_of(1, 9)
    assert minhash.near_duplicates(df.filter("false")).count() == 0
    kept = [r["doc_id"] for r in minhash.drop_near_duplicates(df, words=4).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 4, 6, None, 8, 9], key=str)


def test_repeated_ids_lose_no_link_and_no_text(spark):
    b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "bc")
    rows = [(1, b), (1, c), (2, b + " x"), (3, c + " y"), (9, c), (1, b), (5, "on its own")]
    for part in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("clash")).repartition(part)
        got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(df, words=4).collect()}
        assert got == {(1, 17): 1, (2, 18): 1, (3, 18): 1, (9, 17): 1, (5, 1): 5}
        kept = sorted((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df, words=4).collect())
        assert kept == sorted([(1, b), (1, c), (5, "on its own")])
        chain = spark.createDataFrame([(4, b), (1, c), (1, b + " x"), (0, c + " y"), (7, "alone here now ok")], "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(chain, words=4).collect()}
        assert got == {4: 0, 1: 0, 0: 0, 7: 7}


def out_of(n, i):
    return {(n, i, True)}


def test_very_long_text_and_many_copies(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, long) for i in range(3)] + [(10 + i, "a b c d e f") for i in range(300)] + [(500, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert {got[i] for i in (0, 1, 2, 500)} == {0} and {got[10 + i] for i in range(300)} == {10}


def vectors(seed, n=700, dims=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dims))
    rows = []
    for i in range(n):
        v = centres[i % 12] + r.standard_normal(dims) * r.choice([0.02, 0.1, 0.2, 1.0])
        if i % 50 == 0 and i:
            v = np.array(rows[-1][1])
        rows.append((i, [float(np.float32(x)) for x in v], None if i % 97 == 5 else i % 3))
    return rows


def links_by_hand(rows, cosine=0.93):
    ok = [(i, np.array(v), g) for i, v, g in rows if v is not None and g is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))]
    n, pairs = collections.Counter(), []
    for a, (i, x, g) in enumerate(ok):
        for j, y, h in ok[:a]:
            if g == h and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                pairs.append((i, j))
    find = union(pairs)
    return {i: (n[i], find(i)) for i, _, _ in rows}


@pytest.mark.parametrize("kw", [{}, {"block": 40}, {"target": 60, "block": 50, "most_copies": 100.0}, {"target": 120, "most_copies": 4.0}])
def test_links_match_all_pairs(spark, kw):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df, **kw).collect()}
    assert got == links_by_hand(rows)


def test_narrow_margin_keeps_most_links(spark):
    rows = vectors(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    narrow = embed_dedup.near_duplicates(df, target=60, block=50, margin=0.2, most_copies=100.0)
    found = narrow.agg(F.sum("n_links")).first()[0]
    assert found / sum(n for n, _ in links_by_hand(rows).values()) >= 0.95


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], []]
    rows = [(i, v, 1) for i, v in enumerate(bad)] + [(10, [1.0, 0.0], 1), (11, [2.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [1.0, 0.0], None), (14, [1.0, 0.0], 1), (15, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("same", F.lit("clash")).withColumn("n_links", F.lit("clash"))
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert all(out[i] == (0, i, True) for i in [*range(6), 12, 13, 15]) and out[None] == (0, None, True)
    assert out[10] == (2, 10, True) and out[11] == (2, 10, False) and out[14] == (2, 10, False)
    assert embed_dedup.near_duplicates(df.filter("false")).count() == 0


def test_a_group_of_many_blocks_keeps_size_estimates_bounded(spark):
    r = random.Random(8)
    words = [str(r.randint(0, 10**6)) for _ in range(60)]
    rows = [(i, " ".join(words[:-1] + [f"w{i}"])) for i in range(60)] + [(60, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.drop_near_duplicates(docs, words=4, block_shingles=500)
    size = kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 500
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 60]
