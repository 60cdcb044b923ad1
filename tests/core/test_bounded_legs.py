"""What a task holds doesn't grow with an Arrow batch, and its best rows are those of brute force."""

import numpy as np
import pytest
from lakewright.operators import legs


def test_scorers_get_slices_of_a_batch(spark):
    docs = spark.range(30_000).repartition(2)

    def scorer(pdf):
        assert len(pdf) <= 4_000, len(pdf)
        yield pdf, slice(None), (pdf["id"].to_numpy() % 1_000).astype(float)[None, :]

    got = legs._over_blocks(docs, [], [(np.array([7]), scorer)], 3, None).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(7, 999, 999.0), (7, 1_999, 999.0), (7, 2_999, 999.0)]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_best_of_slices_is_the_best_of_all(k):
    rng = np.random.default_rng(k)
    scores = rng.integers(0, 6, (9, 300)).astype(float)
    scores[rng.random(scores.shape) < 0.2] = np.nan
    ids = rng.permutation(1_000)[:300]
    coarse = scores + rng.uniform(-0.4, 0.4, scores.shape)
    plain, refined = legs._Best(9, k), legs._Best(9, k)
    for low in range(0, 300, 37):
        at = np.arange(low, min(low + 37, 300))
        for part in (slice(0, 4), slice(4, 9)):
            plain.add("x", ids[at], part, scores[part][:, at])
        refined.add("x", ids[at], slice(None), coarse[:, at], np.full((9, 1), 0.5), lambda q, c, at=at: scores[q, at[c]])
    for best in (plain, refined):
        got, own = best.cells["x"]
        for q in range(9):
            want = sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if s == s)[:k]
            assert [(-s, i) for s, i in zip(got[q], own[q], strict=True) if s > -np.inf] == want


def test_late_interaction_equals_brute_force_near_ties(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=(n, 4)).round(3) for n in rng.integers(1, 700, 60)]
    vectors += [v + 1e-8 for v in vectors[:20]]
    asked = [rng.normal(size=(n, 4)).round(3) for n in (1, 3, 8)]
    docs = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(vectors)] + [(99, [])], "id long, vectors array<double>")
    queries = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(asked)], "query_id long, vectors array<double>")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in legs.max_sim_top_k(queries, docs, 15, 4).collect()}
    for q, a in enumerate(asked):
        scores = [round(float(np.round((a @ v.T).max(axis=1), 9).sum()), 9) for v in vectors]
        for rank, i in enumerate(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:15], 1):
            assert got[q, rank][0] == i and abs(got[q, rank][1] - scores[i]) < 2e-9
    assert len(got) == 45
