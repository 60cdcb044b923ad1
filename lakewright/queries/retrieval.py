"""Queries of the retrieval half: legs, fusion, reranking, agreement of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import encode
from lakewright.operators import acceptance, agreement, fusion, legs, retrieve
from lakewright.queries.tables import documents, read

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: each vector whose id is divisible by 100."""
    return vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


_DOT = "round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9)"


@_query(
    "dense_topk",
    f"""SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, {_DOT} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)) WHERE rank <= 20""",
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return legs.dense_top_k(_asked(v), v, 20)


def _halves(v: DataFrame) -> list[DataFrame]:
    """Two legs of different opinion: the first and the last 32 dimensions."""
    return [v.withColumn("vector", F.slice("vector", a, 32)) for a in (1, 33)]


def _pools(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """Ranked lists per query, leg and cell; cells are labels."""
    v = _vectors(spark, sf_dir)
    out = None
    for k, half in enumerate(_halves(v)):
        p = legs.dense_top_k(_asked(half), half, depth, cell="label")
        p = p.withColumn("pool", F.lit(k * 1000) + F.col("label").cast("int"))
        out = p if out is None else out.unionByName(p)
    return out


def _pool_sql(depth: int) -> str:
    leg = lambda k, a, b: (
        f"SELECT q.vec_id AS query_id, d.vec_id AS id, {k} * 1000 + d.label AS pool, "
        f"round(list_inner_product(q.embedding[{a}:{b}]::DOUBLE[], d.embedding[{a}:{b}]::DOUBLE[]), 9) AS score "
        "FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0"
    )
    return f"""scored AS ({leg(0, 1, 32)} UNION ALL {leg(1, 33, 64)}),
pools AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pool ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {depth}),
summed AS (SELECT query_id, id, list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / (60 + rank) ORDER BY pool)), lambda a, b: a + b) AS score FROM pools GROUP BY query_id, id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM summed)"""


@_query("rrf_fusion", f"WITH {_pool_sql(100)} SELECT query_id, id, round(score, 9) AS score, rank FROM fused WHERE rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(_pools(spark, sf_dir, 100)).filter("rank <= 20")
    return fused.withColumn("score", F.round("score", 9))


@_query("pool_ranks", f"WITH {_pool_sql(10)} SELECT query_id, pool, id, score, CAST(rank AS INTEGER) AS rank FROM pools")
def pool_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pools(spark, sf_dir, 10).select("query_id", "pool", "id", "score", "rank")


_TERMS = """words AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS term FROM documents),
post AS (SELECT id, term, ln(1 + count(*)) AS weight FROM words WHERE term <> '' GROUP BY id, term),
qwords AS (SELECT item_id AS id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS term FROM benchmark),
qterms AS (SELECT id AS query_id, term, ln(1 + count(*)) AS wq FROM qwords WHERE term <> '' GROUP BY id, term)"""
_SPARSE = """sparse AS (SELECT query_id, id, round(sum(wq * weight), 6) AS score FROM qterms JOIN post USING (term) GROUP BY query_id, id),
sparse_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sparse)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumnRenamed("doc_id", "id")


def _postings(spark: SparkSession, sf_dir: str, *, asked: bool) -> tuple[DataFrame, DataFrame]:
    """Postings of items and of documents, the latter of the items' words only where ``asked``."""
    words = retrieve.words_of(F.col("text"))
    items = legs.postings(_items(spark, sf_dir).withColumnRenamed("query_id", "id"), words)
    return items, legs.postings(_texts(spark, sf_dir), words, items if asked else None)


@_query("sparse_topk", f"WITH {_TERMS}, {_SPARSE} SELECT query_id, id, score, rank FROM sparse_ranked WHERE rank <= 20")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = retrieve.words_of(F.col("text")).alias("words")
    texts = _texts(spark, sf_dir).select("id", F.lower(F.coalesce("text", F.lit(""))).alias("words"))
    return legs.lexical_top_k(_items(spark, sf_dir).select("query_id", words), texts, 20, split=encode.split)


_PRUNED = f"""{_TERMS}, pruned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS r FROM post) WHERE r <= 100)"""


@_query(
    "sparse_prune_topk",
    f"WITH {_PRUNED}, {_SPARSE.replace('JOIN post', 'JOIN pruned')} SELECT query_id, id, score, rank FROM sparse_ranked WHERE rank <= 20",
)
def sparse_prune_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = _postings(spark, sf_dir, asked=False)
    return legs.sparse_top_k(q, legs.prune_postings(p, 100), 20)


@_query(
    "max_passage",
    f"""WITH {_TERMS}, {_SPARSE}, d AS (SELECT query_id, id // 10 AS doc_id, max(score) AS score FROM sparse GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10""",
)
def max_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of consecutive ids stand for the passages of one."""
    s = legs.sparse_scores(*_postings(spark, sf_dir, asked=True))
    best = fusion.max_passage(s, F.floor(F.col("id") / 10).cast("long"))
    return legs.top_k(best, 10, ["query_id"], id_="doc_id")


@_query(
    "maxsim_topk",
    """WITH tok AS (SELECT vec_id // 10 AS id, vec_id, embedding FROM embeddings),
best AS (SELECT q.id AS query_id, q.vec_id, d.id, max(round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9)) AS s
  FROM tok q JOIN tok d ON q.id % 10 = 0 GROUP BY q.id, q.vec_id, d.id),
summed AS (SELECT query_id, id, round(sum(s), 9) AS score FROM best GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM summed) WHERE rank <= 10""",
)
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors of consecutive ids stand for the token vectors of one document."""
    v = _vectors(spark, sf_dir).withColumn("id", F.floor(F.col("id") / 10).cast("long"))
    tokens = v.groupBy("id").agg(F.flatten(F.collect_list("vector")).alias("vectors"))
    asked = tokens.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vectors")
    return legs.max_sim_top_k(asked, tokens, 10, 64)


_HYBRID = f"""{_TERMS},
dt AS (SELECT id, coalesce(lang, '-') AS lang, term, count(*) AS c FROM words JOIN documents ON doc_id = id WHERE term <> '' GROUP BY ALL),
qt AS (SELECT id AS query_id, term, count(*) AS c FROM qwords WHERE term <> '' GROUP BY ALL),
vocab AS (SELECT term, list_transform(range(1, {encode.DIM + 1}), lambda j: instr('0123456789abcdef', substr(md5(term), CAST(j AS INTEGER), 1)) - 8.5::DOUBLE) AS raw
  FROM (SELECT term FROM dt UNION SELECT term FROM qt)),
unit AS (SELECT term, list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) AS v FROM vocab),
dsum AS (SELECT id, lang, list(x ORDER BY j) AS v FROM (SELECT id, lang, j, sum(c * raw[j]) AS x FROM dt JOIN vocab USING (term), range(1, {encode.DIM + 1}) t(j) GROUP BY ALL) GROUP BY ALL),
qsum AS (SELECT query_id, list(x ORDER BY j) AS v FROM (SELECT query_id, j, sum(c * raw[j]) AS x FROM qt JOIN vocab USING (term), range(1, {encode.DIM + 1}) t(j) GROUP BY ALL) GROUP BY ALL),
dense AS (SELECT query_id, id, lang, round(list_inner_product(q.v, d.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(d.v, d.v)), 9) AS score FROM qsum q, dsum d),
near AS (SELECT a.term AS qterm, b.term, round(list_inner_product(a.v, b.v), 9) AS s FROM unit a, unit b WHERE a.term IN (SELECT term FROM qt) AND b.term IN (SELECT term FROM dt)),
best AS (SELECT qterm, id, lang, max(s) AS s FROM near JOIN dt USING (term) GROUP BY ALL),
late AS (SELECT query_id, id, lang, round(sum(c * s), 9) AS score FROM qt JOIN best ON qterm = qt.term GROUP BY ALL),
sparse AS (SELECT query_id, id, lang, round(sum(ln(1 + qt.c) * ln(1 + dt.c)), 6) AS score FROM qt JOIN dt USING (term) GROUP BY ALL),
hits AS (SELECT 'dense' AS leg, * FROM dense UNION ALL SELECT 'late', * FROM late UNION ALL SELECT 'sparse', * FROM sparse),
pools AS (SELECT * FROM (SELECT *, leg || '/' || lang AS pool, CAST(row_number() OVER (PARTITION BY query_id, leg, lang ORDER BY score DESC, id) AS INTEGER) AS rank FROM hits) WHERE rank <= 20),
summed AS (SELECT query_id, id, list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / (60 + rank) ORDER BY pool)), lambda a, b: a + b) AS score FROM pools GROUP BY query_id, id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM summed)"""


@_query("hybrid_pools", f"WITH {_HYBRID} SELECT query_id, pool, id, score, rank FROM pools")
def hybrid_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.pools(_items(spark, sf_dir), _texts(spark, sf_dir), 20).select("query_id", "pool", "id", "score", "rank")


@_query(
    "leg_diagnostics",
    f"WITH {_HYBRID} SELECT query_id, leg, count(*) AS hits, count(DISTINCT lang) AS languages, max(score) AS best FROM pools GROUP BY ALL",
)
def leg_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = retrieve.pools(_items(spark, sf_dir), _texts(spark, sf_dir), 20)
    return retrieve.leg_diagnostics(p)


@_query("hybrid_retrieve", f"WITH {_HYBRID} SELECT query_id, id, round(score, 9) AS score, rank FROM fused WHERE rank <= 20")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieve.fused(_items(spark, sf_dir), _texts(spark, sf_dir), top_k=20, rerank_depth=10)
    return rows.filter("rank <= 20").withColumn("score", F.round("score", 9))


@_query(
    "rerank_head_tail",
    f"""WITH {_HYBRID},
dw AS (SELECT doc_id AS id, list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS w FROM documents),
qw AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')), lambda x: x <> '') AS w FROM benchmark),
both_ AS (SELECT f.query_id, f.id, f.rank AS place, f.score, CASE WHEN f.rank <= 10 THEN round(ln((len(list_intersect(qw.w, dw.w)) + 0.5) / (len(qw.w) + 1)), 9) END AS re
  FROM fused f JOIN dw ON dw.id = f.id JOIN qw ON qw.query_id = f.query_id WHERE f.rank <= 20)
SELECT query_id, id, round(coalesce(re, score), 9) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY re IS NULL, re DESC, CASE WHEN re IS NOT NULL THEN id END, place) AS INTEGER) AS rank FROM both_""",
)
def rerank_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.retrieve(_items(spark, sf_dir), _texts(spark, sf_dir), top_k=20, rerank_depth=10)
    return out.withColumn("score", F.round("score", 9))


@_query(
    "unit_norms",
    "SELECT label, count(*) AS n, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS off FROM embeddings GROUP BY label",
)
def unit_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    off = legs.unit_norm_violations(v).groupBy("label").agg(F.count(F.lit(1)).alias("off"))
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(off, "label", "left").select("label", "n", F.coalesce("off", F.lit(0).cast("long")).alias("off"))


def _two_lists(spark: SparkSession, sf_dir: str, k: int = 20) -> list[DataFrame]:
    return [legs.dense_top_k(_asked(h), h, k).select("query_id", "id", "rank") for h in _halves(_vectors(spark, sf_dir))]


_TWO = """scored AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_inner_product(q.embedding[1:32]::DOUBLE[], d.embedding[1:32]::DOUBLE[]), 9) AS sa,
  round(list_inner_product(q.embedding[33:64]::DOUBLE[], d.embedding[33:64]::DOUBLE[]), 9) AS sb FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
a AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sa DESC, id) AS rank FROM scored) WHERE rank <= 20),
b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sb DESC, id) AS rank FROM scored) WHERE rank <= 20),
la AS (SELECT query_id, list(id ORDER BY rank) AS xs FROM a GROUP BY query_id), lb AS (SELECT query_id, list(id ORDER BY rank) AS ys FROM b GROUP BY query_id)"""


def _as_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_lists(spark, sf_dir)
    lists = lambda df, n: df.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(n)
    )
    return lists(a, "xs").join(lists(b, "ys"), "query_id")


@_query(
    "jaccard_pairs",
    f"WITH {_TWO} SELECT query_id, round(len(list_intersect(xs, ys)) / len(list_distinct(list_concat(xs, ys))), 9) AS jaccard FROM la JOIN lb USING (query_id)",
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lists(spark, sf_dir).select("query_id", F.round(agreement.jaccard(F.col("xs"), F.col("ys")), 9).alias("jaccard"))


@_query(
    "rbo_pairs",
    f"""WITH {_TWO}, d AS (SELECT query_id, xs, ys, unnest(range(1, 21)) AS d FROM la JOIN lb USING (query_id))
SELECT query_id, round(sum(pow(0.9, d - 1) * len(list_intersect(xs[1:d], ys[1:d])) / d) / sum(pow(0.9, d - 1)), 9) AS rbo FROM d GROUP BY query_id""",
)
def rbo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lists(spark, sf_dir).select("query_id", F.round(agreement.rbo(F.col("xs"), F.col("ys")), 9).alias("rbo"))


@_query(
    "kendall_pairs",
    f"""WITH {_TWO}, s AS (SELECT query_id, id, a.rank AS ra, b.rank AS rb FROM a JOIN b USING (query_id, id)),
n AS (SELECT query_id, count(*) AS shared FROM s GROUP BY query_id),
p AS (SELECT x.query_id, sum(sign(y.rb - x.rb)) AS c FROM s x JOIN s y ON x.query_id = y.query_id AND x.ra < y.ra GROUP BY x.query_id)
SELECT query_id, shared, round(CASE WHEN shared >= 2 THEN c / (shared * (shared - 1) / 2) END, 9) AS tau FROM n LEFT JOIN p USING (query_id)""",
)
def kendall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_lists(spark, sf_dir)
    return agreement.kendall_tau(a, b, ["query_id"]).withColumn("tau", F.round("tau", 9))


@_query(
    "self_retrieval",
    """WITH v AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 8) AS x, round(embedding[2]::DOUBLE * 8) AS y FROM embeddings),
s AS (SELECT q.id AS query_id, d.id, q.x * d.x + q.y * d.y AS score FROM v q, v d WHERE q.id % 100 < 10),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20),
g AS (SELECT query_id, min(rank) FILTER (id = query_id) AS own, max(score) - min(score) <= 1e-6 AS tied FROM r GROUP BY query_id)
SELECT query_id, coalesce(own = 1, false) AS found, coalesce(own > 1, true) AND tied AS excused, coalesce(own = 1, false) OR tied AS passed FROM g""",
)
def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coarse dimensions, not of unit length: some find themselves, some tie with copies, some lose to longer vectors."""
    coarse = F.transform(F.slice("vector", 1, 2), lambda x: F.round(x.cast("double") * 8))
    v = _vectors(spark, sf_dir).select("id", coarse.alias("vector"))
    asked = v.filter("id % 100 < 10").select(F.col("id").alias("query_id"), "vector")
    return acceptance.self_retrieval(legs.dense_top_k(asked, v, 20))
