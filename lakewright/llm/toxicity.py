"""Toxicity by compression distance.

There are two zstandard dictionaries, one of ordinary text and one with toxic
text as well, and every window of a few words is compressed with either. What
the toxic dictionary saves, over all windows of a text, is turned into a
probability by a logistic model. Zstandard's own trainer isn't used for them,
as it found no dictionaries that tell the classes apart (see README). The
logistic model is fitted fold by fold on what dictionaries of the other folds'
labelled rows save, so no row calibrates a dictionary that it chose.

Toxic text is ordinary text with something added, so the toxic dictionary is
the ordinary one plus the word beginnings that mark toxic rows (signed
G-statistic of document counts). The ordinary dictionary has filler of the
same length in their place: match offsets then cost the same in both and
windows without such words compress to the same length. The first letters of
each word are written in capitals before compression, for otherwise a word
beginning would match the middle of other words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import held_out, hex_long, table
from lakewright.llm.minhash import near_duplicates
from lakewright.plans.checkpoints import cut

#: At most so many labelled rows (those with the smallest hashes) are learned from.
MAX_TRAIN = 20_000
WINDOW_WORDS = 4
#: Begins every window and both dictionaries; no text holds these bytes.
ANCHOR = bytes(range(0xC0, 0xE0)) * 2
CAPITALS = 5
GRAM_LENGTHS = range(5, 14)
MIN_DOCS = 8
MIN_G = 40.0
MIN_LOG_ODDS = 1.5
#: A longer word beginning replaces a shorter one that is at most so much better.
LONGER_FROM = 0.7
MAX_GRAMS = 400
ORDINARY_WORDS = 1_500
ORDINARY_BYTES = 6_000
THRESHOLD = 0.3
#: Toxic training texts this alike count as one.
COPY_WORDS = 3
COPY_PERCENT = 40
FEATURES = 10
#: Parts of the labelled rows; each is measured with dictionaries of the others.
FOLDS = 5


def words_of(text: str | None) -> list[str]:
    return [w[:CAPITALS].upper() + w[CAPITALS:] for w in (text or "").lower().split()]


def windows_of(text: str | None) -> list[bytes]:
    w = words_of(text)
    return [
        ANCHOR + (" " + " ".join(w[i : i + WINDOW_WORDS]) + " ").encode("utf-8", "surrogatepass")
        for i in range(0, len(w), WINDOW_WORDS)
    ] or [ANCHOR]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    p = zs.ZstdCompressionParameters(
        format=zs.FORMAT_ZSTD1_MAGICLESS,
        write_checksum=0,
        write_content_size=0,
        write_dict_id=0,
        strategy=zs.STRATEGY_LAZY,
        min_match=4,
        window_log=14,
        hash_log=14,
        chain_log=14,
        search_log=4,
        target_length=32,
    )
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class ToxicityModel:
    """Two dictionaries and a logistic model over what the toxic one saves."""

    ordinary: bytes
    toxic: bytes
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [-2.0] + [0.0] * FEATURES)

    def features(self, texts) -> np.ndarray:
        filler = bytes(1 + (i * 7 + i * i) % 31 for i in range(len(self.toxic)))
        plain, toxic = _compressor(ANCHOR + self.ordinary + filler), _compressor(ANCHOR + self.ordinary + self.toxic)
        out = np.zeros((len(texts), FEATURES))
        for row, text in enumerate(texts):
            windows = windows_of(text)
            saved = np.fromiter(
                (len(plain.compress(x)) - len(toxic.compress(x)) for x in windows), np.int64, len(windows)
            )
            n, size = len(windows), sum(map(len, windows)) - (len(windows) * len(ANCHOR)) + 40
            top = np.sort(saved)[::-1][:3]
            two, three, four = ((saved >= k).sum() for k in (2, 3, 4))
            out[row] = (
                top[0],
                top.mean(),
                two / n,
                three / n,
                four / n,
                1000 * np.maximum(saved, 0).sum() / size,
                1000 * saved.sum() / size,
                math.log1p(three),
                math.log(n),
                three / math.sqrt(n),
            )
        return out

    def score(self, texts) -> np.ndarray:
        z = (self.features(texts) - np.array(self.mean)) / np.array(self.scale)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Fit the logistic model by Newton steps; one class alone gives its share.

        A whole step can overshoot where few rows lie between the classes, and
        then each further one goes farther off: a step is halved until the
        penalised loss, which is convex, is less.
        """
        self.mean, self.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        prior = (y.sum() + 0.5) / (len(y) + 1)
        w = np.zeros(z.shape[1])
        w[0] = math.log(prior / (1 - prior))
        if 0 < y.sum() < len(y):
            penalty = ridge * np.eye(len(w))
            penalty[0, 0] = 1e-6

            def loss(v: np.ndarray) -> float:
                at = z @ v
                return float((np.logaddexp(0, at) - y * at).sum() + v @ penalty @ v / 2)

            now, gain = loss(w), math.inf
            while gain > 1e-9 * (1 + now):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
                part = 1.0
                while part > 1e-9 and not loss(w + part * step) < now:
                    part /= 2
                gain = max(0.0, now - loss(w + part * step))
                if gain:
                    w, now = w + part * step, now - gain
        self.weights = w.tolist()


#: Rows that are counted together.
COUNT_ROWS = 500


def _grams(wanted: frozenset[str] | None = None):
    """Counter of documents (gram, kind, docs) per word beginning, of those ``wanted`` if given.

    kind is 2 * fold + toxic, and -1 for whole words of ordinary texts.
    """

    def count(batches):
        for pdf in batches:
            for at in range(0, len(pdf), COUNT_ROWS):
                counts: dict[tuple[str, int], int] = {}
                rows = pdf.iloc[at : at + COUNT_ROWS]
                for text, toxic, fold in zip(rows["text"], rows["toxic"], rows["fold"], strict=True):
                    own = set(words_of(text))
                    seen = {g for w in own for g in beginnings(w)}
                    if wanted is not None:
                        seen &= wanted
                    for g in seen:
                        counts[g, 2 * fold + toxic] = counts.get((g, 2 * fold + toxic), 0) + 1
                    if not toxic:
                        for w in own:
                            counts[w, -1] = counts.get((w, -1), 0) + 1
                yield pd.DataFrame(
                    {"gram": [g for g, _ in counts], "kind": [t for _, t in counts], "docs": list(counts.values())}
                ).astype({"gram": "object", "kind": "int32", "docs": "int64"})

    return count


def beginnings(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[:j] for j in GRAM_LENGTHS if len(padded) >= j]


def _marking(grams: list[tuple[str, float]]) -> list[str]:
    """Of (gram, G) the best that don't begin one another, each as long as it stays good."""
    order = sorted(grams, key=lambda x: (-x[1], x[0]))
    taken: list[str] = []
    for g, value in order:
        if len(taken) < MAX_GRAMS and not any(g.startswith(x) or x.startswith(g) for x in taken):
            longer = [h for h, v in order if h.startswith(g) and v >= LONGER_FROM * value]
            taken.append(max(longer, key=lambda h: (len(h), h)))
    return taken


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) whose ``labels`` (doc_id, toxic) say 0 or 1.

    Held-out documents are never used. At most ``max_train`` rows are, those
    with the smallest hashes of their id; repeated texts count once, and so do
    near copies among the toxic ones. Without labelled rows every score is the same.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(hex_long(F.concat(F.lit("tox"), F.col("doc_id").cast("string"))), "doc_id")
        .limit(max_train)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = cut(rows.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")))
    # Near copies of one toxic text would make all of its words look toxic: one of each group counts.
    groups = near_duplicates(rows.filter("toxic = 1"), words=COPY_WORDS, percent=COPY_PERCENT).filter("kept")
    first = rows.filter("toxic = 1").join(groups.select("doc_id").distinct(), "doc_id", "left_semi")
    first = first.groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.lit(1).alias("toxic"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    once = cut(first.unionByName(rows.filter("toxic = 0").select("text", "toxic")).select("text", "toxic", fold))
    totals = {(r["fold"], r["toxic"]): r["count"] for r in once.groupBy("fold", "toxic").count().collect()}
    docs_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("docs")).otherwise(0))
    schema = "gram string, kind int, docs long"
    # Only what enough toxic rows hold can mark them, so only that is counted in the others.
    often = (
        once.filter("toxic = 1").mapInPandas(_grams(), schema)
        .groupBy("gram").agg(F.sum("docs").alias("docs"), *[docs_of(2 * f + 1).alias(f"k1_{f}") for f in range(FOLDS)])
        .filter(f"docs >= {MIN_DOCS}")
    )
    often = cut(often)
    wanted = frozenset(r["gram"] for r in often.select("gram").collect())
    ordinary_rows = once.filter("toxic = 0").mapInPandas(_grams(wanted), schema).groupBy("gram")
    others = ordinary_rows.agg(docs_of(-1).alias("kw"), *[docs_of(2 * f).alias(f"k0_{f}") for f in range(FOLDS)])
    counts = cut(others.join(often.drop("docs"), "gram", "full").na.fill(0).filter(f"kw >= {MIN_DOCS} or {' + '.join(f'k1_{f}' for f in range(FOLDS))} > 0"))

    def toxic(folds: list[int]) -> bytes:
        """The toxic dictionary that these folds of the rows make."""
        n0, n1 = (sum(totals.get((f, t), 0) for f in folds) for t in (0, 1))
        if not n0 or not n1:
            return b""
        k0, k1 = (sum((F.col(f"k{t}_{f}") for f in folds), F.lit(0)) for t in (0, 1))
        k, n, share = k0 + k1, n0 + n1, len(folds) / FOLDS
        part = lambda a, m: F.when(a > 0, a * F.log(a * n / (k * m))).otherwise(0.0)
        odds = F.log((k1 + 0.5) / (n1 + 1)) - F.log((k0 + 0.5) / (n0 + 1))
        marked = (
            counts.select("gram", k1.alias("k1"), odds.alias("odds"), (2 * (part(k1, n1) + part(k0, n0))).alias("g"))
            .filter((F.col("k1") >= MIN_DOCS * share) & (F.col("odds") > MIN_LOG_ODDS) & (F.col("g") > MIN_G * share))
            .orderBy(F.desc("g"), "gram")
            .limit(20 * MAX_GRAMS)
        )
        return "".join(reversed(_marking([(r["gram"], r["g"]) for r in marked.collect()]))).encode()

    common = counts.filter("kw > 0").orderBy(F.desc("kw"), "gram").limit(ORDINARY_WORDS).collect()
    ordinary, size = [], 0
    for r in common:
        size += len(r["gram"].encode()) + 1
        if size < ORDINARY_BYTES:
            ordinary.append(r["gram"])
    ordinary = (" " + " ".join(reversed(ordinary)) + " ").encode()
    model = ToxicityModel(ordinary, toxic(list(range(FOLDS))))
    others = [ToxicityModel(ordinary, toxic([x for x in range(FOLDS) if x != f])) for f in range(FOLDS)]

    def measure(batches):
        for pdf in batches:
            for fold, own in pdf.groupby("fold"):
                yield pd.DataFrame({"x": others[fold].features(own["text"]).tolist(), "toxic": own["toxic"]})

    seen = once.mapInPandas(measure, "x array<double>, toxic int").collect()
    if seen:
        seen = sorted((r["toxic"], tuple(r["x"])) for r in seen)
        model.calibrate(np.array([x for _, x in seen]), np.array([t for t, _ in seen], dtype=float))
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (text) with score (0 to 1) for each row.

    Whole texts are read. A null text counts as empty and gets the score of a
    text without words; repeated rows score alike; an empty table gives none.
    """

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text))

    return docs.select(*keep, toxic("text").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
