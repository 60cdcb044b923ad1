"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order 3, over lower-cased letters with runs of
anything else as one blank. All languages share one sorted array of n-gram
hashes per order, with a column of log probabilities each, so a text costs one
binary search per character and order, whatever the number of languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.llm.common import held_out, hex_long, table
from lakewright.plans.checkpoints import cut

#: At most so many documents per language (smallest hashes) are learned from.
TRAIN_DOCS = 300
#: And so many of them set aside to fit the calibration.
CALIBRATE_EVERY = 5
DISCOUNT = 0.75
#: So many ids of documents to learn from are broadcast (24 bytes each); more are joined.
BROADCAST_IDS = 100_000
#: A text is rejected whose cross-entropy lies so many deviations above what its language has.
REJECT = 6.0
UNKNOWN = "und"
_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])
_P = np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: str | None) -> tuple[np.ndarray, bool]:
    """Code points with non-letters as one blank and blanks at both ends; any letter?"""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _ALPHA[np.minimum(raw, 0xFFFF)]
    high = np.flatnonzero(raw > 0xFFFF)
    if len(high):
        letter = letter.copy()
        letter[high] = [chr(c).isalpha() for c in raw[high]]
    c = np.where(letter, raw, 32)
    c = np.concatenate(([32], c, [32])).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep], bool(letter.any())


def _hash2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(21)) | b


def _hash3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = ((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c) * _P
    return h ^ (h >> np.uint64(29))


@dataclass
class LanguageModel:
    """Sorted n-gram hashes of orders 1 to 3; log values per language."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    #: Per language the mean cross-entropy, and its variance: one part for all texts, one that falls with length.
    usual: np.ndarray | None = None

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, keys[at] == wanted

    def entropies(self, c: np.ndarray) -> np.ndarray:
        """Cross-entropy per character in nats, for each language."""
        a, b, last = c[:-2], c[1:-1], c[2:]
        if not len(last):
            return -self.floor
        at3, hit3 = self.find(self.keys[2], _hash3(a, b, last))
        total = np.bincount(at3[hit3], minlength=len(self.keys[2])).astype(np.float64) @ self.logp[2]
        miss = ~hit3
        if miss.any():
            a, b, last = a[miss], b[miss], last[miss]
            at, ok = self.find(self.keys[1], _hash2(a, b))
            total += self.backoff[1][at[ok]].sum(0)
            at2, hit2 = self.find(self.keys[1], _hash2(b, last))
            total += self.logp[1][at2[hit2]].sum(0)
            b, last = b[~hit2], last[~hit2]
            at, ok = self.find(self.keys[0], b)
            total += self.backoff[0][at[ok]].sum(0)
            at, ok = self.find(self.keys[0], last)
            total += self.logp[0][at[ok]].sum(0) + (~ok).sum() * self.floor
        return -total / (len(c) - 2)

    def excess(self, k: int, h: float, n: int) -> float:
        """Deviations by which a text of n characters lies above the cross-entropy of language k."""
        if self.usual is None or np.isnan(self.usual[k, 0]):
            return 0.0
        mean, all_, short = self.usual[k]
        return float((h - mean) / np.sqrt(all_ + short / n + 1e-6))

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, posterior, cross-entropy, excess; ties go to the first language."""
        names, scores, best, over = [], np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts):
            c, any_letter = codes_of(text)
            if not any_letter or not self.languages:
                names.append(UNKNOWN)
                continue
            h = self.entropies(c)
            k = int(np.argmin(h))
            names.append(self.languages[k])
            scores[i] = 1 / np.exp(-(h - h[k]) * self.temperature * np.sqrt(len(c))).sum()
            best[i] = h[k]
            over[i] = self.excess(k, h[k], len(c))
        return names, np.clip(scores, 0.0, 1.0), best, over


def fit(counts: dict[str, dict[str, int]], discount: float = DISCOUNT) -> LanguageModel:
    """Kneser-Ney models from trigram counts {language: {three characters: n}}."""
    languages = sorted(counts)
    tri = sorted({g for v in counts.values() for g in v})
    bi = sorted({g[:2] for g in tri} | {g[1:] for g in tri})
    uni = sorted({x for g in tri for x in g})
    i3, i2, i1 = ({g: i for i, g in enumerate(x)} for x in (tri, bi, uni))
    size = len(languages)
    logp = [np.zeros((len(x), size)) for x in (uni, bi, tri)]
    back = [np.zeros((len(x), size)) for x in (uni, bi, tri)]
    floor = np.zeros(size)
    t_hist = np.array([i2[g[:2]] for g in tri])
    t_low = np.array([i2[g[1:]] for g in tri])
    b_hist = np.array([i1[g[0]] for g in bi])
    b_low = np.array([i1[g[1]] for g in bi])
    for k, lang in enumerate(languages):
        n3 = np.zeros(len(tri))
        for g, n in counts[lang].items():
            n3[i3[g]] = n
        seen3 = (n3 > 0).astype(float)
        cont2 = np.bincount(t_low, seen3, len(bi))
        seen2 = (cont2 > 0).astype(float)
        cont1 = np.bincount(b_low, seen2, len(uni))
        # One more symbol stands for all characters never seen.
        types = cont1.sum()
        free = discount * (cont1 > 0).sum() / max(types, 1)
        p1 = np.maximum(cont1 - discount, 0) / max(types, 1) + free / (len(uni) + 1)
        floor[k] = np.log(max(free / (len(uni) + 1), 1e-9))
        h2 = np.bincount(b_hist, cont2, len(uni))
        lam2 = np.where(h2 > 0, discount * np.bincount(b_hist, seen2, len(uni)) / np.maximum(h2, 1), 1.0)
        p2 = np.maximum(cont2 - discount, 0) / np.maximum(h2[b_hist], 1) + lam2[b_hist] * p1[b_low]
        h3 = np.bincount(t_hist, n3, len(bi))
        lam3 = np.where(h3 > 0, discount * np.bincount(t_hist, seen3, len(bi)) / np.maximum(h3, 1), 1.0)
        p3 = np.maximum(n3 - discount, 0) / np.maximum(h3[t_hist], 1) + lam3[t_hist] * p2[t_low]
        for at, p in enumerate((p1, p2, p3)):
            logp[at][:, k] = np.log(np.maximum(p, 1e-12))
        back[0][:, k], back[1][:, k] = np.log(lam2), np.log(lam3)
    point = lambda grams: np.array([[ord(x) for x in g] for g in grams], np.uint64).T
    if not tri:
        none = [np.zeros(1, np.uint64)] * 3
        return LanguageModel([], none, [np.zeros((1, 0))] * 3, [np.zeros((1, 0))] * 3, floor)
    keys = [point(uni)[0], _hash2(*point(bi)), _hash3(*point(tri))]
    orders = [np.argsort(x) for x in keys]
    return LanguageModel(
        languages,
        [x[o] for x, o in zip(keys, orders, strict=True)],
        [x[o] for x, o in zip(logp, orders, strict=True)],
        [x[o] for x, o in zip(back, orders, strict=True)],
        floor,
    )


def _trigrams(batches):
    for pdf in batches:
        out: dict[tuple[str, str], int] = {}
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            s = codes_of(text)[0].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            for i in range(len(s) - 2):
                k = (lang, s[i : i + 3])
                out[k] = out.get(k, 0) + 1
        yield pd.DataFrame({"lang": [k[0] for k in out], "gram": [k[1] for k in out], "n": list(out.values())}).astype(
            {"lang": "object", "gram": "object", "n": "int64"}
        )


def _usual(k: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Mean cross-entropy of each language's texts, and variance as a + b / length; nan where there are none."""
    out = np.full((h.shape[1], 3), np.nan)
    for lang in range(h.shape[1]):
        own, size = h[k == lang, lang], n[k == lang].astype(float)
        if len(own):
            mean = np.average(own, weights=size)
            square = (own - mean) ** 2
            long = size >= np.median(size)
            a = square[long].mean()
            out[lang] = mean, a, max(0.0, float(((square - a) * size).mean()))
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang) with a lang, held-out rows left out.

    At most ``train_docs`` documents per language are used, those with the
    smallest hashes; what reaches the driver are their distinct trigrams. Each
    fifth of them fits the temperature of the posteriors and the usual
    cross-entropies instead. Rows that repeat a document count again; without
    any row every text is ``und``.
    """
    order = hex_long(F.concat(F.lit("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ids = (
        docs.filter("lang is not null and text is not null and doc_id is not null")
        .filter(~held_out(F.col("doc_id")))
        .select("doc_id", "lang")
        .withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id")))
        .filter(F.col("at") <= train_docs)
    )
    ids = cut(ids)
    small = ids.count() <= BROADCAST_IDS
    picked = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id")
    grams = (
        picked.filter(f"at % {CALIBRATE_EVERY} <> 0 or at < {CALIBRATE_EVERY}")
        .select("lang", "text")
        .mapInPandas(_trigrams, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts: dict[str, dict[str, int]] = {}
    for r in grams.collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = fit(counts)

    def measure(batches):
        for pdf in batches:
            rows = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                c, ok = codes_of(text)
                if ok and lang in model.languages:
                    h = model.entropies(c)
                    rows.append((model.languages.index(lang), len(c), h.tolist()))
            yield pd.DataFrame(rows, columns=["k", "n", "h"]).astype({"k": "int32", "n": "int64", "h": "object"})

    aside = picked.filter(f"at % {CALIBRATE_EVERY} = 0").select("lang", "text")
    seen = aside.mapInPandas(measure, "k int, n long, h array<double>").collect() if model.languages else []
    if seen:
        k, n, h = (np.array([r[c] for r in seen]) for c in ("k", "n", "h"))
        model.usual = _usual(k, n, h)
        h = h * np.sqrt(n)[:, None]
        loss = {}
        for t in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
            z = -h * t
            z -= z.max(1, keepdims=True)
            loss[t] = -np.log(np.maximum(np.exp(z)[np.arange(len(k)), k] / np.exp(z).sum(1), 1e-9)).mean()
        model.temperature = min(loss, key=lambda t: (round(loss[t], 6), t))
    return model


def identify(docs: DataFrame, model: LanguageModel, reject: float = REJECT) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, excess, rejected for each row (doc_id, text).

    Whole texts are read. ``und`` with score 0 where the text is null or has no
    letter; otherwise the language of least cross-entropy per character.
    ``excess`` is how many deviations that lies above what texts of the language
    and length have; ``rejected`` marks ``reject`` and more, which texts of a
    language not learned have. Repeated rows get the same
    answer; an empty table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, excess double")
    def language(text: pd.Series) -> pd.DataFrame:
        names, score, entropy, over = model.predict(text)
        return pd.DataFrame({"lang_pred": names, "score": score, "cross_entropy": entropy, "excess": over})

    out = docs.select("doc_id", language("text").alias("_r")).select("doc_id", "_r.*")
    return out.withColumn("rejected", F.col("excess") >= reject)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
