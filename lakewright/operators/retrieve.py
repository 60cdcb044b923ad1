"""Hybrid retrieval: every leg over every language, fused, its head reranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import encode
from lakewright.operators import fusion, legs
from lakewright.plans.checkpoints import cut

WORDS = r"[ \t\n\r\f\x0B]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS, -1), lambda w: w != "")


def pools(queries: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """Ranked lists (query_id, pool, leg, lang, id, score, rank), ``depth`` of each leg and language.

    queries: query_id, text; docs: id, lang, text. The dense leg and late
    interaction see every text with a word, the sparse leg only those that
    share one. A null language is a pool of its own, named ``-``. Each leg is
    one scan of the documents; only its best rows are shuffled.
    """
    q = queries.select("query_id", words_of(F.col("text")).alias("words"))
    # Words and vectors of documents are many times their texts, so tasks make them of a few texts at a time.
    text = F.lower(F.coalesce("text", F.lit("")))
    d = lambda name: docs.select("id", F.coalesce("lang", F.lit("-")).alias("lang"), text.alias(name))
    vector, tokens = encode.dense_vector(F.col("words")), encode.token_vectors(F.col("words"))
    hits = {
        "dense": legs.dense_top_k(
            # Texts without a word go before they are encoded: a filter on the encoder's result would run it twice.
            q.filter(F.size("words") > 0).select("query_id", vector.alias("vector")),
            d("vector"), depth, cell="lang", encode=encode.dense_of_text,
        ),
        "late": legs.max_sim_top_k(
            q.select("query_id", tokens.alias("vectors")), d("vectors"), depth, encode.DIM, cell="lang", encode=encode.tokens_of_text
        ),
        "sparse": legs.lexical_top_k(q, d("words"), depth, cell="lang", split=encode.split),
    }
    out = None
    for leg, rows in hits.items():
        pool = F.concat(F.lit(f"{leg}/"), F.col("lang"))
        part = rows.select("query_id", pool.alias("pool"), F.lit(leg).alias("leg"), "lang", "id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def leg_diagnostics(pools: DataFrame) -> DataFrame:
    """(query_id, leg, hits, languages, best): what each leg gave to a query's pools."""
    return pools.groupBy("query_id", "leg").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("lang").alias("languages"), F.max("score").alias("best")
    )


def fused(queries: DataFrame, docs: DataFrame, *, top_k: int, rerank_depth: int) -> DataFrame:
    return fusion.rrf(pools(queries, docs, fusion.candidate_depth(top_k, rerank_depth)))


def overlap(queries: DataFrame, docs: DataFrame):
    """A reranker: head rows with ``rerank``; only texts of the heads are split into words."""
    asked = queries.select("query_id", words_of(F.col("text")).alias("_asked"))
    texts = docs.select("id", F.col("text").alias("_text"))

    def score(head: DataFrame) -> DataFrame:
        s = fusion.overlap_score(F.col("_asked"), words_of(F.col("_text")))
        return head.join(texts, "id").join(asked, "query_id").withColumn("rerank", F.round(s, 9))

    return score


def retrieve(queries: DataFrame, docs: DataFrame, *, top_k: int = 20, rerank_depth: int = 10, rerank=None) -> DataFrame:
    """(query_id, id, score, rank): pools of all legs and languages, fused, the head reranked.

    ``rerank`` maps head rows (query_id, id, ...) to the same rows with a column
    rerank; without one, the words in common decide. The fused rows, bounded by
    depth, legs and languages per query, are written once and read by head and
    tail.
    """
    rows = cut(fused(queries, docs, top_k=top_k, rerank_depth=rerank_depth).filter(F.col("rank") <= max(top_k, rerank_depth)))
    return fusion.rerank_head(rows, rerank or overlap(queries, docs), depth=rerank_depth, top_k=top_k)
