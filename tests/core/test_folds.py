"""The sequential folds against plain restatements of their rules."""

import random

import pytest

from lakewright.operators import folds


def words(n):
    return " ".join(["w"] * n)


def spans_of(counts):
    text, spans = "", []
    for c in counts:
        start = len(text) + (1 if text else 0)
        text = f"{text} {words(c)}" if text else words(c)
        spans.append((start, len(text)))
    return text, spans


def test_pack_budget_and_oversized():
    assert folds.pack([5, 5, 12, 3], [0] * 4, budget=10, overlap=0) == [(0, 1, 10, False), (2, 2, 12, True), (3, 3, 3, False)]


def test_pack_prefers_paragraphs_when_nearly_full():
    assert folds.pack([6, 3, 1], [0, 1, 1], budget=10, overlap=0, min_fill=0.6) == [(0, 0, 6, False), (1, 2, 4, False)]
    assert folds.pack([5, 3, 1], [0, 1, 1], budget=10, overlap=0, min_fill=0.6) == [(0, 2, 9, False)]


def test_pack_overlap_leaves_room():
    # The last sentence comes along though it is over the share; not if the next one leaves no room.
    assert folds.pack([4, 4, 4], [0] * 3, budget=9, overlap=0.15) == [(0, 1, 8, False), (1, 2, 8, False)]
    assert folds.pack([4, 4, 8], [0] * 3, budget=9, overlap=0.15) == [(0, 1, 8, False), (2, 2, 8, False)]


@pytest.mark.parametrize("seed", range(20))
def test_pack_covers_everything_within_budget(seed):
    r = random.Random(seed)
    counts = [r.randint(1, 14) for _ in range(40)]
    out = folds.pack(counts, [i // 4 for i in range(40)], budget=12, overlap=0.3)
    covered = [i for a, b, _, _ in out for i in range(a, b + 1)]
    assert sorted(set(covered)) == list(range(40))
    for a, b, tokens, over in out:
        assert tokens == sum(counts[a : b + 1]) and (tokens <= 12) != over
    assert all(x[0] <= y[0] and x[1] < y[1] for x, y in zip(out, out[1:]))


def merged(counts, paras, **kw):
    text, spans = spans_of(counts)
    return folds.merge_short(spans, paras, counts, text, folds.count_words, **kw)


def test_merge_heading_takes_the_next_paragraph():
    assert merged([2, 20, 20], [0, 1, 1], cap=30) == [(0, 1, 22), (2, 2, 20)]


def test_merge_inside_goes_back_and_may_absorb_again():
    assert merged([20, 3, 20], [0, 0, 0], cap=30) == [(0, 1, 23), (2, 2, 20)]
    assert merged([3, 3, 3], [0, 0, 0], min_tokens=8, cap=30) == [(0, 2, 9)]


def test_merge_refuses_over_the_cap():
    assert merged([2, 29], [0, 1], cap=30) == [(0, 0, 2), (1, 1, 29)]
    assert merged([2, 28], [0, 1], cap=30) == [(0, 1, 30)]


def test_merge_never_crosses_when_told():
    assert merged([2, 20], [0, 1], cap=30, cross_paragraph=False) == [(0, 0, 2), (1, 1, 20)]


@pytest.mark.parametrize("seed", range(20))
def test_merge_tiles_the_document(seed):
    r = random.Random(seed)
    counts = [r.choice([1, 3, 5, 18, 40]) for _ in range(30)]
    paras = sorted(r.randint(0, 8) for _ in counts)
    out = merged(counts, paras, cap=50)
    assert [i for a, b, _ in out for i in range(a, b + 1)] == list(range(30))
    assert all(t <= 50 or a == b for a, b, t in out)


def test_batches_close_before_the_budget_or_the_count():
    assert folds.batches([5, 1, 4, 3], budget=8, most=3) == [1, 0, 0, 0]
    assert folds.batches([9, 9], budget=8, most=3) == [0, 1]
    assert folds.batches([], budget=8, most=3) == []


def test_shards_are_cut_at_documents():
    assert folds.cut_shards([4, 4, 4, 20, 1], 8) == [0, 0, 1, 2, 3]


def test_decode_cap_is_clamped():
    assert folds.decode_cap(3, ratio=2, extra=1, most=100) == 7
    assert folds.decode_cap(1000, most=100) == 100


def test_special_tokens_are_reserved():
    assert folds.pack([5, 3, 4], [0] * 3, budget=10, overlap=0, special=2) == [(0, 1, 8, False), (2, 2, 4, False)]


def test_null_lengths_do_not_switch_the_budget_off(spark):
    rows = [("g", i, n) for i, n in enumerate([None, 5, 5, 5, 5, 5, 5])]
    df = spark.createDataFrame(rows, "grp string, id long, n int")
    got = {r["id"]: r["batch"] for r in folds.length_batches(df, "grp", "n", budget=8, most=9).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}
