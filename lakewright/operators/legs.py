"""Retrieval legs: dense, sparse and late interaction, all exact.

Queries are a small stated set that meets all rows. The dense legs take them in
blocks of ``QUERY_BLOCK`` rows, whose vectors travel with the task closure (a
bounded size). A task takes its rows in slices, so that neither what it unpacks
nor the scores it lays out grow with an Arrow batch, and keeps the best k per
query over all its slices; only those are shuffled. Late interaction and the
sparse leg over texts work alike; over stored postings, the sparse leg joins by
term.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructType

QUERY_BLOCK = 4_096
#: Queries of many vectors or words in a block.
TOKEN_BLOCK = 256
#: Most word counts a task lays out at once.
COUNTS = 4_000_000
#: Most scores, and bytes of an Arrow batch, that a task lays out at once.
SCORES = 1_000_000
UNPACKED = 1 << 20
#: Most best rows that a task holds before it hands them back.
HELD = 4_000_000
#: Rows of a product of token vectors, and what rounding one term to single precision may change.
TOKENS = 256
COARSE = 1.2e-7
#: Most terms that are broadcast.
MOST_TERMS = 200_000
#: Scores are rounded before ranking, so that the order of additions decides nothing.
DIGITS = 9


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", id_: str = "id") -> DataFrame:
    """The k best rows per ``by`` with ``rank`` from 1: score descending, then id ascending."""
    w = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_).asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, id_: str, columns: list[str], size: int = QUERY_BLOCK):
    """Pandas frames of about ``size`` queries, dealt by a hash of the id; each is one small action."""
    n = -(-queries.count() // size)
    own = queries.select(id_, *columns)
    for b in range(n):
        yield own.filter(F.pmod(F.xxhash64(id_), F.lit(n)) == b).toPandas()


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def _some(values) -> bool:
    return values is not None and len(values) > 0


def _result(docs: DataFrame, cell: str | None) -> StructType:
    out = StructType().add("query_id", LongType())
    if cell:
        out = out.add(cell, docs.schema[cell].dataType)
    return out.add("id", LongType()).add("score", DoubleType())


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, as a column."""
    at = scores.shape[1] - k
    return np.partition(scores, at, axis=1)[:, at : at + 1]


def _leading(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k largest scores over -inf; of equal ones the first."""
    if scores.shape[1] <= k:
        return np.nonzero(scores > -np.inf)
    least = _kth(scores, k)
    over, level = scores > least, (scores == least) & (least > -np.inf)
    room = k - over.sum(axis=1, keepdims=True)
    return np.nonzero(over | (level & (np.cumsum(level, axis=1) <= room)))


class _Best:
    """The k best rows per query and cell of what a task has seen: k places a query, the best first."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.cells = queries, k, {}

    def held(self) -> int:
        return len(self.cells) * self.queries * self.k

    def add(self, cell, own: np.ndarray, part: slice, scores: np.ndarray, slack=None, exact=None) -> None:
        """Offers rows of ids ``own`` with ``scores`` (``part`` of the queries x rows); ties go to the smaller id.

        With ``exact``, scores are off by less than ``slack`` (a column), and
        exact(queries, rows) gives the scores of those pairs that may be kept.
        """
        if cell not in self.cells:
            shape = (self.queries, self.k)
            self.cells[cell] = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max)
        best, ids = (x[part] for x in self.cells[cell])
        order = np.argsort(own, kind="stable")
        own, scores = own[order], scores[:, order]
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        if exact is not None:
            wanted = (scores >= best[:, -1:] - slack) & (scores > -np.inf)
            if scores.shape[1] > self.k:
                wanted &= scores >= _kth(scores, self.k) - 2 * slack
            at = np.nonzero(wanted)
            scores = np.full(scores.shape, -np.inf)
            scores[at] = exact(at[0], order[at[1]])
        better = (scores > best[:, -1:]) | ((scores == best[:, -1:]) & (own < ids[:, -1:]) & (scores > -np.inf))
        rows = np.flatnonzero(better.any(axis=1))
        if not len(rows):
            return
        scores = np.where(better[rows], scores[rows], -np.inf)
        r, c = _leading(scores, self.k)
        n = np.bincount(r, minlength=len(rows))
        at = np.arange(len(r)) - (np.cumsum(n) - n)[r]
        new, new_ids = np.full((len(rows), n.max()), -np.inf), np.full((len(rows), n.max()), np.iinfo(np.int64).max)
        new[r, at], new_ids[r, at] = scores[r, c], own[c]
        both, both_ids = np.hstack([best[rows], new]), np.hstack([ids[rows], new_ids])
        order = np.lexsort((both_ids, -both), axis=1)[:, : self.k]
        best[rows], ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)

    def batches(self, query_ids: np.ndarray, cell: str | None, schema: pa.Schema):
        """What is held, a batch for each cell; then nothing is."""
        held, self.cells = self.cells, {}
        for name, (best, ids) in held.items():
            q, at = np.nonzero(best > -np.inf)
            columns = [query_ids[q], ids[q, at], best[q, at]]
            arrays = [pa.array(x, type=schema.field(n).type) for n, x in zip(("query_id", "id", "score"), columns, strict=True)]
            if cell:
                arrays.insert(1, pa.array([name], type=schema.field(cell).type).take(pa.array(np.zeros(len(q), np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _by_cell(names: list) -> dict:
    """The places of each name; not-a-number is null."""
    out: dict = {}
    for at, name in enumerate(names):
        out.setdefault(None if name != name else name, []).append(at)
    return {name: np.array(at) for name, at in out.items()}


def _over_blocks(docs: DataFrame, columns: list[str], scorers, k: int, cell: str | None) -> DataFrame:
    """The k best of all rows under each block's scorer.

    A scorer maps a frame of some rows to (rows, part, scores), or (rows, part,
    scores, slack, exact) as ``_Best`` takes them.
    """
    out, result = None, _result(docs, cell)
    arrow = to_arrow_schema(result)
    rows = docs.select("id", *columns, *([cell] if cell else []))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    for n, (ids, scorer) in enumerate(scorers):

        def run(batches, ids=ids, scorer=scorer):
            best = _Best(len(ids), k)
            for batch in batches:
                step = max(1, min(SCORES // TOKEN_BLOCK, batch.num_rows * UNPACKED // max(1, batch.nbytes)))
                for low in range(0, batch.num_rows if len(ids) else 0, step):
                    few = batch.slice(low, step)
                    pdf = few.to_pandas()
                    if cell:
                        pdf[cell] = pd.Series(few.column(cell).to_pylist(), dtype=object)
                    for rows, part, scores, *more in scorer(pdf):
                        own = rows["id"].to_numpy()
                        for name, at in _by_cell(rows[cell].tolist()).items() if cell else [(None, np.arange(len(own)))]:
                            if more:
                                best.add(name, own[at], part, scores[:, at], more[0], lambda q, c, at=at, f=more[1]: f(q, at[c]))
                            else:
                                best.add(name, own[at], part, scores[:, at])
                    if best.held() > HELD:
                        yield from best.batches(ids, cell, arrow)
            yield from best.batches(ids, cell, arrow)

        # Where the blocks are many, so are their tasks, each of which hands back k rows a query.
        part = (rows.coalesce(cores) if n else rows).mapInArrow(run, result)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], result)
    return top_k(out, k, ["query_id"] + ([cell] if cell else []))


def dense_top_k(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    *,
    cell: str | None = None,
    exclude_self: bool = False,
    encode: Callable | None = None,
) -> DataFrame:
    """(query_id, [cell,] id, score, rank): inner products of ``vector`` columns.

    queries: query_id, vector; docs: id, vector and, if named, a cell column.
    With a cell the k best of each cell are kept. With ``encode``, ``vector`` of
    docs holds what it makes vectors of, a slice at a time; those of which it
    makes None meet nothing. Runs one small action per block of queries.
    """

    def scorers():
        for block in _blocks(queries, "query_id", ["vector"]):
            q, ids = _matrix(block["vector"]), block["query_id"].to_numpy()

            def score(pdf, q=q, ids=ids):
                vectors = pdf["vector"]
                if encode is not None:
                    vectors = vectors.map(encode)
                    some = vectors.map(_some).astype(bool)
                    pdf, vectors = pdf[some], vectors[some]
                if not len(pdf):
                    return
                rows = _matrix(vectors).T
                step = max(1, SCORES // len(pdf))
                for low in range(0, len(q), step):
                    part = slice(low, low + step)
                    s = np.round(q[part] @ rows, DIGITS)
                    if exclude_self:
                        s[ids[part, None] == pdf["id"].to_numpy()[None, :]] = -np.inf
                    yield pdf, part, s

            yield ids, score

    return _over_blocks(docs, ["vector"], scorers(), k, cell)


def _nearest(vectors: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The greatest product of each token (a column) with any vector (a row)."""
    out = np.full(tokens.shape[1], -np.inf, tokens.dtype)
    for low in range(0, len(vectors), TOKENS):
        np.maximum(out, (vectors[low : low + TOKENS] @ tokens).max(axis=0), out=out)
    return out


def max_sim_top_k(
    queries: DataFrame, docs: DataFrame, k: int, dim: int, *, cell: str | None = None, encode: Callable | None = None
) -> DataFrame:
    """Late interaction: sum over a query's vectors of the best product with a document's vectors.

    queries: query_id, vectors; docs: id, vectors and, if named, a cell column,
    where ``vectors`` holds a text's token vectors of ``dim`` numbers end to
    end, or with ``encode`` what it makes those of, a slice at a time. All
    pairs are scored at single precision, and at double those that may be among
    the best. Texts without a token meet nothing.
    """

    def scorers():
        for block in _blocks(queries, "query_id", ["vectors"], TOKEN_BLOCK):
            block = block[block["vectors"].map(_some).astype(bool)]
            tokens = _matrix(np.concatenate(list(block["vectors"]))).reshape(-1, dim) if len(block) else np.empty((0, dim))
            sizes = np.array([len(v) // dim for v in block["vectors"]], dtype=np.int64)
            begins = np.cumsum(sizes) - sizes
            # Equal vectors of the block meet a document once.
            tokens, place = np.unique(tokens, axis=0, return_inverse=True)

            def score(pdf, tokens=tokens, begins=begins, sizes=sizes, place=place.ravel()):
                vectors = [v if encode is None else encode(v) for v in pdf["vectors"]]
                pdf = pdf[np.array(list(map(_some, vectors)), bool)]
                vectors = [np.asarray(v, np.float64).reshape(-1, dim) for v in vectors if _some(v)]
                if not len(pdf) or not len(tokens):
                    return
                length = np.sqrt((tokens * tokens).sum(axis=1).max()) * np.sqrt(np.nanmax([(v * v).sum(axis=1).max() for v in vectors]))
                single = np.float32 if length < 1e30 else np.float64
                columns = np.ascontiguousarray(tokens.T, single)
                coarse = np.empty((len(begins), len(pdf)))
                for at, v in enumerate(vectors):
                    coarse[:, at] = np.add.reduceat(_nearest(v.astype(single), columns)[place].astype(np.float64), begins)

                def exact(q, at):
                    out = np.empty(len(q))
                    for doc, own in _by_cell(at.tolist()).items():
                        asked = q[own]
                        ends = np.cumsum(sizes[asked])
                        each = np.repeat(begins[asked] - (ends - sizes[asked]), sizes[asked]) + np.arange(ends[-1])
                        s = np.round(_nearest(vectors[doc], tokens[place[each]].T), DIGITS)
                        out[own] = np.round(np.add.reduceat(s, ends - sizes[asked]), DIGITS)
                    return out

                yield pdf, slice(None), coarse, (COARSE * (dim + 4) * length + 10.0**-DIGITS) * sizes[:, None], exact

            yield block["query_id"].to_numpy(), score

    return _over_blocks(docs, ["vectors"], scorers(), k, cell)


def lexical_top_k(
    queries: DataFrame, docs: DataFrame, k: int, *, cell: str | None = None, split: Callable | None = None
) -> DataFrame:
    """The sparse leg over texts: products of weights ln(1 + times a word occurs), summed per pair.

    queries: query_id, words; docs: id, words and, if named, a cell column,
    where ``words`` may hold what ``split`` makes words of, a slice at a time.
    Each task counts only the block's words in its own documents and keeps its
    k best, so neither postings nor pairs are shuffled and a word that most
    documents hold is no hot key. Pairs without a common word are no hits.
    """

    def scorers():
        for block in _blocks(queries, "query_id", ["words"], TOKEN_BLOCK):
            place: dict[str, int] = {}
            cells = [(place.setdefault(w, len(place)), q) for q, words in enumerate(block["words"]) for w in words]
            ids = block["query_id"].to_numpy()

            def score(pdf, place=place, cells=cells, n=len(ids)):
                width = len(place)
                if not width:
                    return
                asked = np.zeros((width, n))
                np.add.at(asked, tuple(np.array(cells).T), 1)
                asked = np.log1p(asked)
                step = max(1, COUNTS // width)
                for low in range(0, len(pdf), step):
                    rows = pdf.iloc[low : low + step]
                    texts = map(split, rows["words"]) if split else rows["words"]
                    found = [row * width + place[w] for row, words in enumerate(texts) for w in words if w in place]
                    counts = np.bincount(np.array(found, dtype=np.int64), minlength=len(rows) * width)
                    s = np.round(np.log1p(counts.reshape(len(rows), width)) @ asked, 6).T
                    yield rows, slice(None), np.where(s > 0, s, -np.inf)

            yield ids, score

    return _over_blocks(docs, ["words"], scorers(), k, cell)


def postings(texts: DataFrame, words: Column, terms: DataFrame | None = None) -> DataFrame:
    """(id, term, weight) with weight ln(1 + times the term occurs).

    With ``terms`` (a column term) only those are counted: other words leave
    before the shuffle where the terms, whose number is checked, can be sent to
    every task.
    """
    t = texts.select("id", F.explode(words).alias("term")).filter("term <> ''")
    if terms is not None:
        asked = terms.select("term").distinct()
        few = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS
        t = t.join(F.broadcast(asked) if few else asked, "term", "left_semi")
    return t.groupBy("id", "term").agg(F.log1p(F.count(F.lit(1))).alias("weight"))


def prune_postings(post: DataFrame, k: int) -> DataFrame:
    """The k heaviest positive weights of each id; ties go to the smaller term."""
    w = W.partitionBy("id").orderBy(F.col("weight").desc(), F.col("term").asc())
    return post.filter("weight > 0").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def sparse_scores(query_terms: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, id, score): weighted term products, summed per pair that shares a term."""
    q = query_terms.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("_wq"))
    pairs = post.join(q, "term").withColumn("p", F.col("_wq") * F.col("weight"))
    return pairs.groupBy("query_id", "id").agg(F.round(F.sum("p"), 6).alias("score"))


def sparse_top_k(query_terms: DataFrame, post: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of ``sparse_scores``.

    Only documents that share a term are scored. A term that most documents
    hold makes a skewed key, which adaptive execution splits.
    """
    return top_k(sparse_scores(query_terms, post), k, ["query_id"])


def unit_norm_violations(vectors: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """Rows of (id, vector) whose norm is off 1 by more than ``tolerance``."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.withColumn("norm", norm).filter(F.abs(F.col("norm") - 1) > tolerance)
