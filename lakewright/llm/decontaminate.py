"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words and the common words of
a bounded sample of the corpus's passages, with document counts of the whole
corpus; other words only lengthen a passage's vector, as if no document had
them. A randomised SVD of the benchmark's and the sample's passages, computed
in tasks, gives the latent space: words that the corpus uses alike lie together
in it. Every window of every text, folded in over the singular values, is
compared by cosine there with every passage of every item. What is near enough is checked by the longest common
subsequence of words around the window, and by the item's answer (its last
sentence) where less than ``SURE`` of it is there. For a paraphrase by other
words, words of candidates by cosine also match those that lie beside them in the
latent space.

The cosine of a leak falls with the benchmark's size, as the latent space is
fixed, and with the corpus, as words outside weigh more. So a bound without
either is a second way to the same check: every window around which at least
as many of an item's words stand as the least common subsequence that passes.
It loses nothing that comparing each item with each window would find.

Items are taken in blocks of ``ITEM_BLOCK``, which bounds the model: at most
about 50,000 words of ``DIMENSIONS`` numbers. A larger benchmark costs a pass
per block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import hex_long, spare, table
from lakewright.plans.checkpoints import cut

PASSAGE = 32
STRIDE = 16
DIMENSIONS = 160
OVERSAMPLE = 16
POWER_ROUNDS = 3
ITEM_BLOCK = 512
#: Documents (those with the smallest hashes) that give a passage each to the fit.
FIT_DOCS = 20_000
#: Characters from which that passage is taken, at a place that the hash chooses.
FIT_CHARS = 400
#: Of their words the commonest, if in so many of the passages, have a place in the latent space.
FIT_WORDS = 16_384
FIT_LEAST = 5
#: Words that a larger share of all documents holds have no place there: they tell no passages apart.
FREQUENT = 0.05
SVD_TASKS = 8
#: Rows of the model that are summed up together.
SUM_ROWS = 2_048
#: Words of texts that are searched together, and strides of a piece of them.
BATCH_WORDS = 16_384
PIECE = 1_024
#: Words of a text, at least, for which the items that can be there are found together.
STRETCH = 512
#: Cosine from which a window is a candidate; 7.6 deviations from that of unrelated passages (1 / sqrt(160)).
COSINE = 0.6
#: So many words, the nearest in the latent space, may stand for a word, from this cosine on.
NEAREST = 5
ALIKE = 0.25
#: Share of an item's words that must be there in order: without and with its answer.
SURE = 0.8
LIKELY = 0.6
#: Share of the answer's words that must be there in order, in the second case.
ANSWER = 0.6
#: Items of fewer words are found only whole.
SHORT = 6
_DELETE = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation; runs of one word count once."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DELETE).split()
    return [x for i, x in enumerate(w) if not i or x != w[i - 1]]


def answer_words(text: str) -> int:
    """Words of the last sentence; of the last third where there is but one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if tokens(p)]
    n = len(tokens(text))
    last = len(tokens(parts[-1])) if len(parts) > 1 else n
    return last if 3 <= last < n else max(1, n // 3)


def common_subsequence(masks: dict[int, int], m: int, other) -> int:
    """Length of the longest common subsequence, 64 and more positions at a time."""
    full = (1 << m) - 1
    v = full
    for x in other:
        hit = masks.get(x)
        if hit:
            u = v & hit
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(ids) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def least_words(m: int) -> int:
    """The shortest common subsequence with which an item of m words can be a leak."""
    return m if m < SHORT else next(c for c in range(m + 1) if c / m >= LIKELY)


def passes(m: int, share: float, answer: float) -> bool:
    return share >= 1.0 if m < SHORT else share >= SURE or share >= LIKELY and answer >= ANSWER


@dataclass
class LatentIndex:
    """Word vectors and the items' passage vectors of one block of items.

    Words below ``own`` are the benchmark's, the others the sample's.
    """

    words: dict[bytes, int]
    own: int
    weight: np.ndarray
    unseen: float
    vectors: np.ndarray
    items: list[int]
    passage_vectors: np.ndarray
    first_passage: np.ndarray
    item_ids: list[list[int]]
    answers: list[int]
    alike: dict[int, list[int]]

    def __post_init__(self):
        """Which items hold a word and how often, the items' words, and how many of them must be there."""
        own = [np.unique(np.array(x, np.int32), return_counts=True) for x in self.item_ids]
        self.item_words, self.item_counts = [w for w, _ in own], [c for _, c in own]
        self.least = np.array([least_words(len(x)) for x in self.item_ids], np.int64)
        word = np.concatenate([np.zeros(0, np.int32), *self.item_words])
        by = np.argsort(word, kind="stable")
        self.holder = np.repeat(np.arange(len(own)), [len(w) for w in self.item_words])[by].astype(np.int32)
        self.times = np.concatenate([np.zeros(0, np.int64), *self.item_counts])[by].astype(np.int32)
        self.first = np.searchsorted(word[by], np.arange(self.own + 1))
        self.longest = max(map(len, self.item_ids), default=0)
        self.step = -(-max(STRETCH, 2 * self.longest) // STRIDE) * STRIDE
        #: Whether a word has a vector; the last entry is for words outside, -1.
        self.placed = np.append(self.vectors.any(1), False)
        self.item_of = np.repeat(np.arange(len(own)), [len(_passages(x)) for x in self.item_ids])

        self.known_masks: dict[tuple[int, bool], tuple[dict[int, int], dict[int, int]]] = {}

    def masks(self, k: int, reworded: bool = False) -> tuple[dict[int, int], dict[int, int]]:
        """Masks of an item's words and of its answer's; reworded, with the words that are alike."""
        if (k, reworded) not in self.known_masks:
            item = self.item_ids[k]
            both = masks_of(item), masks_of(item[len(item) - self.answers[k] :])
            if reworded:
                both = tuple({y: 0 for x in m for y in (x, *self.alike.get(x, ()))} for m in both)
                for m, own in zip(both, (item, item[len(item) - self.answers[k] :]), strict=True):
                    for i, x in enumerate(own):
                        for y in (x, *self.alike.get(x, ())):
                            m[y] |= 1 << i
            self.known_masks[k, reworded] = both
        return self.known_masks[k, reworded]

    def shares(self, k: int, region: list[int], reworded: bool = False) -> tuple[float, float]:
        """Shares of an item and of its answer that stand in order in ``region``; 0 for the answer where the item can't pass."""
        item, answer = self.masks(k, reworded)
        m, n = len(self.item_ids[k]), self.answers[k]
        share = common_subsequence(item, m, region) / m
        return share, common_subsequence(answer, n, region) / n if share >= LIKELY else 0.0

    def ids(self, text: str | None) -> np.ndarray:
        w = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DELETE).split()
        x = np.fromiter(map(self.words.get, w, repeat(-1)), np.int32, len(w))
        if len(x) < 2:
            return x
        # Runs of one benchmark word count once; words outside are all -1 and stay.
        return x[np.append(True, (x[1:] != x[:-1]) | (x[1:] < 0))]

    def candidates(self, xs: list[np.ndarray], least: float | None = None) -> tuple[np.ndarray, ...]:
        """(text, start, item, cosine) of all windows and passages with a cosine of ``least`` (COSINE) or more.

        Texts are laid out in whole strides with an empty one behind each, and
        gone through in pieces of bounded size.
        """
        least = COSINE if least is None else least
        strides = np.array([-(-len(x) // STRIDE) for x in xs], np.int64)
        begin = np.cumsum(strides + 1) - strides - 1
        total = int((strides + 1).sum())
        laid = np.full(total * STRIDE, -1, np.int32)
        for x, at in zip(xs, begin, strict=True):
            laid[at * STRIDE : at * STRIDE + len(x)] = x
        owner = np.repeat(np.arange(len(xs)), strides + 1)
        inside = np.ones(total, bool)
        inside[begin + strides] = False
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.float32),)]
        for lo in range(0, total if self.items else 0, PIECE):
            hi = min(lo + PIECE, total)
            piece = laid[lo * STRIDE : (hi + 1) * STRIDE]
            known = np.flatnonzero(self.placed[piece])
            if not len(known):
                continue
            cell = known // STRIDE
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            part = np.zeros((hi - lo + 1, self.vectors.shape[1]), np.float32)
            part[cell[first]] = np.add.reduceat(self.vectors[piece[known]], first)
            both = part[:-1] + part[1:]
            long = np.sqrt(np.einsum("ij,ij->i", both, both))
            at = np.flatnonzero((long > 1e-6) & inside[lo:hi])
            if not len(at):
                continue
            product = both[at] @ self.passage_vectors.T
            w, p = np.nonzero(product >= least * long[at, None])
            text = owner[lo + at[w]]
            out.append((text, (lo + at[w] - begin[text]) * STRIDE, self.item_of[p], product[w, p] / long[at[w]]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def enough(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Per text the items of whose words it holds enough to pass."""
        n = len(self.items)
        text = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
        word = np.concatenate([np.zeros(0, np.int32), *xs]).astype(np.int64)
        known = (word >= 0) & (word < self.own)
        u = np.unique(text[known] * self.own + word[known])
        text, word = u // max(self.own, 1), u % max(self.own, 1)
        times = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        there = np.bincount(np.repeat(text, times) * n + self.holder[at], self.times[at], minlength=len(xs) * n)
        good = there.reshape(len(xs), n) >= self.least
        return [np.flatnonzero(g) for g in good]

    def stretches(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(from, to, first window) of the overlapping parts of a text that hold all regions of their windows."""
        long, step = self.longest, self.step
        return [(max(0, at - long), min(len(x), at + step + PASSAGE + long), at) for at in range(0, len(x), step)]

    def counted(self, x: np.ndarray, items, windows: np.ndarray):
        """(item, places of its words, starts of windows) where enough of an item's words are around to pass."""
        if not len(items):
            return
        known = np.flatnonzero((x >= 0) & (x < self.own))
        own = x[known]
        for k in items:
            m = len(self.item_ids[k])
            words = self.item_words[k]
            place = np.searchsorted(words, own)
            place[place == len(words)] = 0
            mine = words[place] == own
            pos, place = known[mine], place[mine].astype(np.int64)
            lo, hi = np.maximum(windows - m, 0), windows + PASSAGE + m
            near = np.flatnonzero(np.searchsorted(pos, hi) - np.searchsorted(pos, lo) >= self.least[k])
            if not near.size:
                continue
            # Of each word at most as many count as the item has.
            by = np.arange(len(words))[:, None] * (len(x) + PASSAGE + m + 1)
            key = np.sort(place * (len(x) + PASSAGE + m + 1) + pos)
            n = np.searchsorted(key, by + hi[near]) - np.searchsorted(key, by + lo[near])
            near = near[np.minimum(n, self.item_counts[k][:, None]).sum(0) >= self.least[k]]
            if near.size:
                yield int(k), pos, windows[near]

    def cosine(self, x: np.ndarray, start: int, k: int) -> float:
        """Cosine of one window with the best passage of one item."""
        w = x[start : start + PASSAGE]
        z = self.vectors[w[w >= 0]].sum(0)
        own = self.passage_vectors[self.first_passage[k] :][: len(_passages(self.item_ids[k]))]
        return float((own @ z).max() / max(float(np.sqrt(z @ z)), 1e-9))

    def near(self, xs: list[np.ndarray]) -> list[dict[int, tuple[float, float, float]]]:
        """Per text item -> cosine, share, answer of the leaks among the candidates by cosine."""
        best: list[dict[int, tuple[float, float, float]]] = [{} for _ in xs]
        for t, start, k, cosine in zip(*(c.tolist() for c in self.candidates(xs)), strict=True):
            m = len(self.item_ids[k])
            seen = best[t].get(k)
            if seen and seen[1] >= 1.0:
                continue
            region = xs[t][max(0, start - m) : start + PASSAGE + m].tolist()
            share, answer = self.shares(k, region)
            if not passes(m, share, answer) and m >= 2 * SHORT:
                # By other words: the same rule, where words that are alike count.
                share, answer = self.shares(k, region, reworded=True)
            if passes(m, share, answer) and (not seen or (share, answer) > seen[1:]):
                best[t][k] = (cosine, share, answer)
        return best

    def search(self, texts) -> list[list[tuple[int, float, float, float]]]:
        """Per text (item_id, cosine, share of the item, share of its answer) of the leaks."""
        out: list[list[tuple[int, float, float, float]]] = []
        held: list[np.ndarray] = []
        for text in texts:
            held.append(self.ids(text))
            if sum(map(len, held)) >= BATCH_WORDS:
                out += self._search(held)
                held = []
        return out + self._search(held) if held else out

    def hits(self, text: str | None) -> list[tuple[int, float, float, float]]:
        return self.search([text])[0]

    def _search(self, xs: list[np.ndarray]) -> list[list[tuple[int, float, float, float]]]:
        leaks = self.near(xs)
        parts = [(t, *part) for t, x in enumerate(xs) for part in self.stretches(x)]
        more: list[dict[int, tuple[float, float, float]]] = [{} for _ in xs]
        held = self.enough([xs[t][lo:hi] for t, lo, hi, _ in parts])
        for (t, lo, hi, at), items in zip(parts, held, strict=True):
            x = xs[t][lo:hi]
            windows = np.arange(at, min(at + self.step, len(xs[t])), STRIDE) - lo
            for k, pos, near in self.counted(x, [k for k in items.tolist() if k not in leaks[t]], windows):
                m = len(self.item_ids[k])
                found, last = more[t].get(k), None
                for start in near.tolist():
                    # Only the item's words matter to a subsequence; windows with the same ones are alike.
                    span = np.searchsorted(pos, (start - m, start + PASSAGE + m)).tolist()
                    if span == last:
                        continue
                    last = span
                    share, answer = self.shares(k, x[pos[span[0] : span[1]]].tolist())
                    if passes(m, share, answer) and (not found or (share, answer) > found[1:]):
                        found = (self.cosine(x, start, k), share, answer)
                if found:
                    more[t][k] = found
        return [[(self.items[k], *v) for k, v in sorted((a | b).items())] for a, b in zip(leaks, more, strict=True)]


def _passages(ids: list[int]) -> list[list[int]]:
    return [ids[s : s + PASSAGE] for s in range(0, max(1, len(ids) - PASSAGE + STRIDE), STRIDE)]


def passage_vectors(vectors: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all items' passages, item after item, and where each item's begin."""
    parts = [_passages(x) for x in ids]
    own = np.array([vectors[p].sum(0) for x in parts for p in x])
    own /= np.maximum(np.sqrt((own * own).sum(1, keepdims=True)), 1e-9)
    return own, np.cumsum([0, *map(len, parts)])[:-1]


def _document_counts(docs: DataFrame, words: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and all documents; a row per word and task is shuffled."""

    def count(batches):
        total, n = np.zeros(len(words), np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                w = set((text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DELETE).split())
                x = np.fromiter(map(words.get, w, repeat(-1)), np.int32, len(w))
                total[x[x >= 0]] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"word": np.append(at, -1), "n": np.append(total[at], n)}).astype("int64")

    df = np.zeros(len(words), np.int64)
    rows = 0
    for r in docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            rows = r["n"]
        else:
            df[r["word"]] = r["n"]
    return df, rows


def _sample(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(words array<binary>): one passage of each of ``FIT_DOCS`` documents, from a place its hash chooses."""
    order = hex_long(F.concat(F.lit("latent"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ids = docs.filter("doc_id is not null").select("doc_id", order.alias("place")).distinct().orderBy("place", "doc_id").limit(FIT_DOCS)

    def passage(batches):
        for pdf in batches:
            rows = []
            for text, place in zip(pdf["text"], pdf["place"], strict=True):
                text = text or ""
                at = place % max(1, len(text) - FIT_CHARS)
                rows.append(tokens(text[at : at + FIT_CHARS])[at > 0 :][:PASSAGE])
            yield pd.DataFrame({"words": rows})

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "place")
    return cut(rows.mapInPandas(passage, "words array<binary>").repartition(SVD_TASKS))


def _product(passages: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis), with the passages' unit TF-IDF vectors as A; summed in the cluster, block by block."""
    spark = passages.sparkSession
    sent = spark.sparkContext.broadcast((weight, basis))

    def part(batches):
        weight, basis = sent.value
        out = np.zeros(basis.shape, np.float32)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                ids = [np.asarray(v, np.int64) for v in pdf["ids"][at : at + 1024] if len(v)]
                if not ids:
                    continue
                x, n = np.concatenate(ids), np.array([len(v) for v in ids])
                first = np.cumsum(n) - n
                w = weight[x]
                w = w / np.repeat(np.sqrt(np.maximum(np.add.reduceat(w * w, first), 1e-12)), n)
                y = np.add.reduceat(w[:, None] * basis[x], first)
                z = w[:, None] * np.repeat(y, n, axis=0)
                order = np.argsort(x, kind="stable")
                own, start = np.unique(x[order], return_index=True)
                out[own] += np.add.reduceat(z[order], start)
        for b, at in enumerate(range(0, len(out), SUM_ROWS)):
            yield pd.DataFrame({"block": [b], "sum": [out[at : at + SUM_ROWS].tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in sorted(pdf["sum"]))
        return pd.DataFrame({"block": pdf["block"][:1], "sum": [s.astype(np.float32).tobytes()]})

    schema = "block int, sum binary"
    rows = passages.mapInPandas(part, schema).groupBy("block").applyInPandas(total, schema).collect()
    sent.destroy()
    out = np.zeros(basis.shape, np.float32)
    for r in rows:
        own = np.frombuffer(r["sum"], np.float32).reshape(-1, basis.shape[1])
        out[r["block"] * SUM_ROWS :][: len(own)] = own
    return out


def _orthonormal(m: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the span of ``m``, by its small Gram matrix; twice, for rounding."""
    for _ in range(2):
        value, turn = np.linalg.eigh((m.T @ m).astype(np.float64))
        good = value > 1e-7 * max(value.max(initial=0), 1e-30)
        m = m @ (turn[:, good] / np.sqrt(value[good])).astype(np.float32)
    return m


def _latent_space(passages: DataFrame, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors to compare words by (over the root of the singular values), and to fold passages in."""
    basis = np.random.default_rng(7).standard_normal((len(weight), min(DIMENSIONS + OVERSAMPLE, len(weight))), np.float32)
    for _ in range(POWER_ROUNDS if weight.any() else 0):
        basis = _orthonormal(_product(passages, weight, basis))
    if not weight.any() or not basis.size:
        return (np.zeros((len(weight), 1), np.float32),) * 2
    value, turn = np.linalg.eigh((basis.T @ _product(passages, weight, basis)).astype(np.float64))
    best = [k for k in np.argsort(-value)[:DIMENSIONS] if value[k] > 1e-6 * value.max()]
    latent = basis @ turn[:, best].astype(np.float32)
    # Folded in as queries are, over the singular values: else a few directions (languages) decide.
    folded = (latent * weight[:, None] / np.sqrt(value[best])).astype(np.float32)
    return latent * np.sqrt(np.sqrt(value[best])).astype(np.float32), folded


def _alike(vectors: np.ndarray, own: int, often: np.ndarray) -> dict[int, list[int]]:
    """For each benchmark word the nearest others that may stand for it; rare ones have no place of their own."""
    size = np.sqrt((vectors * vectors).sum(1))
    ok = np.flatnonzero((often >= FIT_LEAST) & (size > 1e-6))
    u = vectors[ok] / size[ok, None]
    out: dict[int, list[int]] = {}
    mine = np.flatnonzero(ok < own)
    for at in range(0, len(mine), 64):
        rows = mine[at : at + 64]
        cos = u[rows] @ u.T
        cos[np.arange(len(rows)), rows] = -1
        for i, row in enumerate(cos):
            near = np.argpartition(row, -NEAREST)[-NEAREST:] if len(row) > NEAREST else np.arange(len(row))
            near = np.sort(near[row[near] >= ALIKE])
            if len(near):
                out[int(ok[rows[i]])] = ok[near].tolist()
    return out


def fit(docs: DataFrame, items: list[tuple[int, str]], sample: DataFrame | None = None) -> LatentIndex:
    """The latent index of a block of (item_id, text), with document counts of ``docs``.

    ``sample``: passages of the corpus as ``_sample`` gives them; made from
    ``docs`` (doc_id, text) where not given. Runs actions.
    """
    spark = docs.sparkSession
    items = sorted((i, t) for i, t in items if t and tokens(t))
    words: dict[bytes, int] = {}
    ids = [[words.setdefault(w, len(words)) for w in tokens(t)] for _, t in items]
    own = len(words)
    if not items:
        zero = np.zeros((0, 1), np.float32)
        return LatentIndex({}, 0, np.zeros(1), 1.0, np.zeros((1, 1), np.float32), [], zero, np.zeros(0, np.int64), [], [], {})
    sample = _sample(docs, words) if sample is None else sample
    n_words = F.count(F.lit(1))
    common = (
        sample.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(n_words.alias("n"))
        .filter(f"n >= {FIT_LEAST}").orderBy(F.desc("n"), "w").limit(FIT_WORDS + own).collect()
    )
    seen: dict[int, int] = {}
    for r in common:
        w = bytes(r["w"])
        if w in words or len(words) < own + FIT_WORDS:
            seen[words.setdefault(w, len(words))] = r["n"]
    often = np.array([seen.get(i, 0) for i in range(len(words))])
    df, n = _document_counts(docs, words)
    weight = (np.log((n + 1) / (df + 1)) + 1e-6).astype(np.float32)
    unseen = float(np.log(n + 1) + 1e-6)
    placed = np.where(df <= FREQUENT * max(n, 20), weight, 0).astype(np.float32)
    sent = spark.sparkContext.broadcast(words)

    def numbered(batches):
        get = sent.value.get
        for pdf in batches:
            yield pd.DataFrame({"ids": [[i for i in (get(bytes(w), -1) for w in p) if i >= 0] for p in pdf["words"]]})

    rows = [(p,) for x in ids for p in _passages(x)]
    bench = spark.createDataFrame(rows, "ids array<int>")
    passages = cut(sample.mapInPandas(numbered, "ids array<int>").unionByName(bench).repartition(SVD_TASKS))
    sent.destroy()
    latent, vectors = _latent_space(passages, placed)
    own_vectors, first = passage_vectors(vectors, ids)
    return LatentIndex(
        words, own, weight, unseen, vectors, [i for i, _ in items], own_vectors, first, ids,
        [answer_words(t) for _, t in items], _alike(latent, own, often),
    )


def _blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of at most ITEM_BLOCK items, one after the other."""
    rows = cut(
        benchmark.filter("text is not null and item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
        .withColumn("block", F.expr(f"(row_number() over (order by item_id) - 1) div {ITEM_BLOCK}"))
    )
    last = rows.agg(F.max("block")).first()[0]
    for b in range(0 if last is None else last + 1):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.col("block") == b).collect()]


def _hits(index: LatentIndex, text: str) -> Column:
    @F.pandas_udf("array<struct<item_id:bigint,cosine:double,share:double,answer:double>>")
    def found(s: pd.Series) -> pd.Series:
        names = ("item_id", "cosine", "share", "answer")
        return pd.Series([[dict(zip(names, h, strict=True)) for h in hits] for hits in index.search(s)])

    return found(text)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer): one row per document and item it leaks.

    docs: doc_id, text; benchmark: item_id, text. Whole texts are searched. Null
    and empty texts on either side leak nothing; an item_id that repeats counts
    with its smallest text; rows that repeat a document give rows of their own;
    empty tables give no rows; other columns are ignored. Runs actions.
    """
    out = None
    for items in _blocks(benchmark):
        rows = docs.select("doc_id", F.explode(_hits(fit(docs, items), "text")).alias("h")).select("doc_id", "h.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.select(
            "doc_id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0.0).alias(c) for c in ("cosine", "share", "answer")]
        ).filter("false")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; see ``leaks``."""
    leaks_, corpus = spare(docs, "leaks"), docs
    for items in _blocks(benchmark):
        docs = docs.withColumn(leaks_, _hits(fit(corpus, items), "text")).filter(F.size(leaks_) == 0).drop(leaks_)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
