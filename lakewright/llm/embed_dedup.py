"""Embedding near-duplicates by spherical k-means cells.

Equal vectors are one representative first. Within a label, a cell that holds
more than ``target`` vectors is split by spherical k-means fitted on a bounded
sample of it; each vector has one home cell and is also written to every cell
whose border is nearer than two linked vectors can be apart (0.374 for unit
vectors of cosine 0.93), so no link is lost. A smaller ``margin`` writes fewer
copies and may lose links across borders: for 0.25 a test lost 2 of 28,000. A
split that would write each vector more than ``most_copies`` times is not made:
tight or shapeless cells stay whole. Splitting repeats until no cell changes.

Inside a cell vectors are dealt into blocks, and pairs of blocks are compared
by matrix products in double precision. A task returns a number of links per
vector and spanning edges, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakewright.llm.common import table
from lakewright.operators.graph import connected_components
from lakewright.plans.checkpoints import cut

COSINE = 0.93
TARGET = 8_192
BLOCK = 2_048
MOST_COPIES = 3.0
MOST_CELLS = 64
SAMPLE_PER_CELL = 128
ROUNDS = 12
#: Rows of a cell that one task assigns to the new cells.
ASSIGN_ROWS = 20_000
LEVELS = 6


def unit(vectors) -> np.ndarray:
    m = np.array(list(vectors), dtype=np.float64)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k or fewer unit centroids; the start is spread by farthest points."""
    first = [0]
    near = x @ x[0]
    for _ in range(1, min(k, len(x))):
        j = int(np.argmin(near))
        first.append(j)
        near = np.maximum(near, x @ x[j])
    c = x[first].copy()
    for _ in range(rounds):
        home = np.argmax(x @ c.T, 1)
        s = np.zeros_like(c)
        np.add.at(s, home, x)
        norm = np.sqrt((s * s).sum(1, keepdims=True))
        new = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), c)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def near_cells(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row, and which cells it is written to."""
    sim = x @ c.T
    home = np.argmax(sim, 1)
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
    to_border = (sim[np.arange(len(x)), home][:, None] - sim) / gap[home]
    written = to_border <= margin
    written[np.arange(len(x)), home] = True
    return home, written


def _split(members: DataFrame, target: int, margin: float, most_copies: float) -> DataFrame | None:
    """One level of splitting; None where no cell is split."""
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > target)
    sizes = cut(
        sizes.select(
            "cell",
            "c",
            F.least(F.ceil(2 * F.col("c") / target), F.lit(MOST_CELLS)).cast("int").alias("k"),
            F.ceil(F.col("c") / ASSIGN_ROWS).cast("int").alias("parts"),
        )
    )
    if sizes.limit(1).count() == 0:
        return None
    order = W.partitionBy("cell").orderBy(F.xxhash64("rep"), "rep")
    sample = (
        members.join(sizes, "cell")
        .filter("splits")
        .withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= MOST_CELLS * SAMPLE_PER_CELL)
        .filter(F.col("at") <= F.col("k") * SAMPLE_PER_CELL)
        .select("cell", "k", "vec")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["vec"])
        c = spherical_kmeans(x, int(pdf["k"].iloc[0]))
        copies = near_cells(x, c, margin)[1].sum(1).mean()
        good = len(c) > 1 and copies <= min(most_copies, len(c) / 2)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "centroids": [c.ravel().tolist() if good else None]})

    fitted = cut(sample.groupBy("cell").applyInPandas(fit, "cell string, centroids array<double>"))
    good = fitted.filter("centroids is not null")
    if good.limit(1).count() == 0:
        return None
    spread = good.join(sizes, "cell").select(
        "cell", "centroids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    large = members.join(good.select("cell").join(sizes.select("cell", "parts"), "cell"), "cell").withColumn(
        "part", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int")
    )

    def assign(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["rep", "mult", "vec", "cell", "home", "splits"])
        x = unit(rows["vec"])
        c = np.array(cells["centroids"].iloc[0]).reshape(-1, x.shape[1])
        home, written = near_cells(x, c, margin)
        i, j = np.nonzero(written)
        out = rows.iloc[i][["rep", "mult", "vec"]].copy()
        out["cell"] = [f"{a}/{b}" for a, b in zip(rows["cell"].to_numpy()[i], j, strict=True)]
        out["home"] = rows["home"].to_numpy()[i] & (home[i] == j)
        out["splits"] = True
        return out

    schema = members.select("rep", "mult", "vec", "cell", "home", "splits").schema
    split = large.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(assign, schema)
    whole = members.join(good.select("cell"), "cell", "left_anti")
    refused = fitted.filter("centroids is null").select("cell", F.lit(True).alias("no"))
    whole = whole.join(refused, "cell", "left").withColumn("splits", F.col("splits") & F.col("no").isNull()).drop("no")
    return cut(whole.select(*schema.names).unionByName(split.select(*schema.names)))


def _compare(threshold: float):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        near, far = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        a, b = near["rep"].to_numpy(), far["rep"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": a, "links": np.zeros(len(a), np.int64), "root": a})
        y, mult = unit(far["vec"]), far["mult"].to_numpy()
        linked = np.zeros((len(a), len(b)), bool)
        x = unit(near["vec"])
        for at in range(0, len(a), 512):
            linked[at : at + 512] = x[at : at + 512] @ y.T >= threshold
        linked &= a[:, None] != b[None, :]
        count = linked @ mult
        ra, rb = a.copy(), b.copy()
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        sub = linked[np.ix_(rows, cols)]
        top = np.iinfo(np.int64).max
        while sub.size:
            na = np.minimum(ra[rows], np.where(sub, rb[cols][None, :], top).min(1))
            nb = np.minimum(rb[cols], np.where(sub, na[:, None], top).min(0))
            if (na == ra[rows]).all() and (nb == rb[cols]).all():
                break
            ra[rows], rb[cols] = na, nb
        return pd.DataFrame(
            {
                "rep": np.concatenate([a, b[cols]]),
                "links": np.concatenate([count, np.zeros(len(cols), np.int64)]).astype(np.int64),
                "root": np.concatenate([ra, rb[cols]]),
            }
        )

    return block


def near_duplicates(
    vectors: DataFrame,
    *,
    cosine: float = COSINE,
    target: int = TARGET,
    block: int = BLOCK,
    margin: float | None = None,
    most_copies: float = MOST_COPIES,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Vectors of one label link from ``cosine`` on. A null label, vector, vector
    component or vec_id, a zero vector and non-finite components link with
    nothing: 0 links, own component, kept. Vectors of different lengths in one
    label are not compared. Rows that repeat a vector count as vectors of their
    own. An empty table gives no rows; other columns are ignored. Runs actions.
    """
    margin = float(np.sqrt(2 - 2 * cosine)) + 1e-9 if margin is None else margin
    bad = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    zero = ~F.exists("embedding", lambda x: x != 0)
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    usable = usable & F.coalesce(~bad & ~zero, F.lit(False))
    name = F.concat_ws("|", F.col("label").cast("string"), F.size("embedding").cast("string"))
    own = vectors.select("vec_id", "label", "embedding").withColumn(
        "same", F.when(usable, F.md5(F.concat_ws("|", name, F.col("embedding").cast("string")).cast("binary")))
    )
    reps = (
        own.filter("same is not null")
        .groupBy("same")
        .agg(
            F.min("vec_id").cast("long").alias("rep"),
            F.count(F.lit(1)).alias("mult"),
            F.first("embedding").cast("array<double>").alias("vec"),
            F.first(name).alias("cell"),
        )
    )
    reps = cut(reps)
    members = reps.select("rep", "mult", "vec", "cell", F.lit(True).alias("home"), F.lit(True).alias("splits"))
    for _ in range(LEVELS):
        finer = _split(members, target, margin, most_copies)
        if finer is None:
            break
        members = finer
    sizes = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "cell").withColumn(
        "mine", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    near = dealt.filter("home").select("cell", F.col("mine").alias("i"), every.alias("j"), F.lit(0).alias("side"), "rep", "mult", "vec")
    far = dealt.select("cell", every.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"), "rep", "mult", "vec")
    found = cut(
        near.unionByName(far).groupBy("cell", "i", "j").applyInPandas(_compare(cosine), "rep long, links long, root long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("rep <> root"), "rep", "root").select(
        F.col("node").alias("rep"), "component"
    )
    by_rep = (
        reps.select("same", "rep", "mult")
        .join(links, "rep", "left")
        .join(comps, "rep", "left")
        .select(
            "same",
            (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = own.select("vec_id", "same").join(by_rep, "same", "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
