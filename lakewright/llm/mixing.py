"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in equal blocks. Sources get blocks by the highest quotients
target / (2k - 1); each source's blocks are dealt to its shards the same way,
by the shard's words; a shard then serves its quota from its documents in
seeded order, as one run of blocks from a seeded start round the circle of
its words. So no block is listed one by one, and a shard of any length costs
a running sum.

Only the quotients that can decide anything are made: with n parties and H
blocks, the last block taken has a quotient between W/(2H+n) and W/(2H-n)
times two, so each party brings its certain blocks as a number and only the
doubtful ones as rows (about 2n rows in all, whatever H is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewright.llm.common import WORD, hex_long, table
from lakewright.plans.checkpoints import cut

#: Sources in code-point order weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
MAX_REPEATS = 3
BLOCK_WORDS = 16
#: Mean words of a shard over all sources; the number of shards follows the corpus.
SHARD_WORDS = 1_000_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """Targets of (source, source_size): shares by weight, capped, excess reshared.

    Resharing until nothing is above its cap ends where the capped sources are
    those with the smallest cap / weight; running sums over that order find
    them. One row per source, null last in code-point order.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    pick = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(pick, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    up_to = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc()).rowsBetween(
        W.unboundedPreceding, -1
    )
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
        .withColumn(
            "capped",
            F.col("cap") * (F.col("weights") - F.col("weight_before"))
            <= (F.col("total") - F.col("cap_before")) * F.col("weight"),
        )
    )
    held = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    free = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(0))
    ranked = ranked.withColumn("held", held).withColumn("free", free)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        ((F.col("total") - F.col("held")) * F.col("weight")).cast("double") / F.col("free")
    )
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, size: str, seats: str) -> DataFrame:
    """``parties`` with ``got`` (long): its share of the group's ``seats``.

    The ``seats`` rows with the highest quotients size / (2k - 1) win; ties go
    to the smaller party. Parties of size 0 get nothing.
    """
    w = W.partitionBy(*group)
    p = parties.withColumn("_w", F.sum(F.col(size).cast("double")).over(w)).withColumn(
        "_n", F.sum((F.col(size) > 0).cast("long")).over(w)
    )

    def edge(sign: int, slack: int) -> Column:
        at = F.col(size).cast("double") * (2 * F.col(seats) + sign * F.col("_n")) / (2 * F.col("_w")) + 0.5
        at = F.floor(at).cast("long") + slack
        return F.when(F.col(size) > 0, F.greatest(at, F.lit(0))).otherwise(F.lit(0)).cast("long")

    p = p.withColumn("_sure", edge(-1, -1)).withColumn("_most", edge(1, 1))
    p = p.withColumn("_open", F.col(seats) - F.sum("_sure").over(w))
    doubt = p.filter("_most > _sure").select(
        *group,
        party,
        "_open",
        F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"),
        F.col(size).cast("double").alias("_s"),
    )
    best = W.partitionBy(*group).orderBy((F.col("_s") / (2 * F.col("_k") - 1)).desc(), F.col(party).asc())
    won = (
        doubt.withColumn("_r", F.row_number().over(best))
        .filter("_r <= _open")
        .groupBy(*group, party)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return p.join(won, [*group, party], "left").select(
        *parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("got")
    )


def mix_sources(
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = (),
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): how many words the mix takes.

    Returns doc_id, source, ``keep``, size, source_size, target, taken,
    quota_blocks (of the row's shard). A null text has size 0 and is taken 0
    times; a null source is a source of its own, last in order; rows that
    repeat a doc_id are dealt with one by one; an empty table gives an empty
    result. Other columns of ``docs`` are ignored. Runs two small actions
    (source totals).
    """
    own = docs.select(
        "doc_id",
        "source",
        *keep,
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_src"),
        hex_long(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_h"),
        word_count(F.col("text")).alias("size"),
    )
    lean = cut(own.select("doc_id", "source", "_src", "_h", "size"))
    sources = cut(lean.groupBy("_src", "source").agg(F.sum("size").alias("source_size")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    shard = ((F.col("_h") / 7).cast("long") % F.lit(shards)).alias("_shard")
    targets = source_targets(sources.select("source", "source_size"), weights, max_repeats)
    targets = targets.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    seats = targets.withColumn("_all", F.lit(0)).withColumn("_seats", F.lit(total // block_words).cast("long"))
    seats = sainte_lague(seats, ["_all"], "rank", "target", "_seats")
    seats = seats.select("_src", "source_size", "target", F.col("got").alias("_seats"))
    lengths = lean.groupBy("_src", shard).agg(F.sum("size").alias("_len"))
    quotas = sainte_lague(lengths.join(seats, "_src"), ["_src"], "_shard", "_len", "_seats")
    start = hex_long(F.concat(F.lit(seed + "/"), "_src", F.lit("/"), F.col("_shard").cast("string")))
    quotas = quotas.select(
        "_src",
        "_shard",
        "source_size",
        "target",
        "_len",
        F.col("got").alias("quota_blocks"),
        F.least(F.col("got") * block_words, F.col("_len") * max_repeats).alias("_take"),
        (start % F.greatest(F.expr(f"(_len + {block_words - 1}) div {block_words}"), F.lit(1)) * block_words).alias(
            "_from"
        ),
    )
    rows = (own if keep else lean).withColumn("_shard", shard)
    line = W.partitionBy("_src", "_shard").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(line)).withColumn("_begin", F.col("_end") - F.col("size"))
    rows = rows.join(quotas, ["_src", "_shard"])
    rows = rows.withColumn("_full", F.when(F.col("_len") > 0, F.expr("_take div _len")).otherwise(F.lit(0)))
    rows = rows.withColumn("_rest", F.col("_take") - F.col("_full") * F.col("_len"))
    stop = F.col("_from") + F.col("_rest")
    ahead = F.greatest(F.least(F.col("_end"), stop) - F.greatest(F.col("_begin"), F.col("_from")), F.lit(0))
    round_again = F.greatest(F.least(F.col("_end"), stop - F.col("_len")) - F.col("_begin"), F.lit(0))
    return rows.select(
        "doc_id",
        "source",
        *keep,
        "size",
        "source_size",
        "target",
        (F.col("_full") * F.col("size") + ahead + round_again).cast("long").alias("taken"),
        "quota_blocks",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same by listing every block: each source's, then each shard's, by its quotient.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
    ('0x' || substring(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
t AS (SELECT CAST(sum(size) AS BIGINT) AS total, greatest(1, CAST(ceil(sum(size) / {SHARD_WORDS}.0) AS BIGINT)) AS shards FROM d),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY src, source),
w AS (SELECT *, (r - 1) % 3 + 1 AS weight, {MAX_REPEATS} * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS capb, coalesce(sum(weight) OVER p, 0) AS wb, sum(weight) OVER () AS wall
    FROM w WINDOW p AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT o.*, t.total, cap * (wall - wb) <= (t.total - capb) * weight AS capped FROM o, t),
g AS (SELECT src, source_size, r, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight AS DOUBLE)
    / sum(weight) FILTER (NOT capped) OVER () END AS target, total // {BLOCK_WORDS} AS seats FROM c),
q AS (SELECT src, r, target / (2 * k - 1) AS quotient, seats FROM g, LATERAL (SELECT unnest(range(1, seats + 1)) AS k) WHERE target > 0),
got AS (SELECT src, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, r) AS n FROM q) WHERE n <= seats GROUP BY src),
e AS (SELECT d.*, CAST(trunc(h / 7.0) AS BIGINT) % t.shards AS shard FROM d, t),
l AS (SELECT src, shard, CAST(sum(size) AS BIGINT) AS len FROM e GROUP BY src, shard),
ls AS (SELECT l.*, coalesce(got.seats, 0) AS seats FROM l LEFT JOIN got USING (src)),
lq AS (SELECT src, shard, len / (2 * k - 1) AS quotient, seats FROM ls, LATERAL (SELECT unnest(range(1, seats + 1)) AS k) WHERE len > 0),
lg AS (SELECT src, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY quotient DESC, shard) AS n FROM lq) WHERE n <= seats GROUP BY src, shard),
z AS (SELECT l.*, least(coalesce(quota, 0) * {BLOCK_WORDS}, {MAX_REPEATS} * len) AS take,
    ('0x' || substring(md5('{SEED}/' || src || '/' || shard), 1, 15))::BIGINT % greatest((len + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}, 1) * {BLOCK_WORDS} AS start
    FROM l LEFT JOIN lg USING (src, shard)),
x AS (SELECT e.doc_id, e.src, e.size, z.len, z.take, z.start, CAST(sum(e.size) OVER (PARTITION BY e.src, e.shard ORDER BY h, e.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS till
    FROM e JOIN z USING (src, shard)),
y AS (SELECT *, CASE WHEN len > 0 THEN take // len ELSE 0 END AS rounds, CASE WHEN len > 0 THEN take % len ELSE 0 END AS rest FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(rounds * size + greatest(least(till, start + rest) - greatest(till - size, start), 0) + greatest(least(till, start + rest - len) - (till - size), 0) AS BIGINT) AS taken
FROM y JOIN g USING (src)
"""
