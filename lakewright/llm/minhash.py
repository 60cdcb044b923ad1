"""MinHash near-duplicates with tensored banding and exact confirmation.

Two small collections of sketches, A and B, are made per text; each sketch
joins ``ROWS`` minhashes. Every pair (A_i, B_j) is the key of one table, so
2 * SKETCHES sketches give SKETCHES^2 tables.

Copies with equal shingle sets are one representative before any table is
filled. A table's bucket yields one edge per member, to a pivot drawn for that
bucket, never all pairs; edges whose minhashes agree too seldom to be links
go. What hangs together is a group, and each group's shingle sets
are compared in blocks of bounded size by a search that visits a text once:
it compares it with the texts not yet reached, so a group of near copies costs
little more than one pass. Groups over one block are searched in two different
dealings into blocks, and then what either left outside the main component is
compared with every block. Links are confirmed on whole sets with integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import table
from lakewright.operators.graph import connected_components
from lakewright.plans.checkpoints import cut

#: Words of a shingle and least similarity in per cent, unless a contract says otherwise.
WORDS = 5
PERCENT = 80
ROWS = 2
SKETCHES = 8
MINHASHES = 2 * SKETCHES * ROWS
#: Shingles of a block (8 bytes each).
BLOCK_SHINGLES = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)
_A = np.frombuffer(
    b"".join(xxhash.xxh64_digest(f"minhash/{i}") for i in range(MINHASHES)), np.uint64
) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z count as a-z. Fewer words than a shingle make one shingle of all; no
    words make none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w))] if w else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = len(h) - words + 1
    s = h[:n].copy()
    for k in range(1, words):
        s *= _K
        s ^= s >> np.uint64(32)
        s += h[k : k + n]
    s *= _K
    s ^= s >> np.uint64(29)
    return np.unique(s)


def minhashes(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(MINHASHES, np.int32)
    best = None
    for at in range(0, len(s), 4096):
        low = (np.multiply.outer(_A, s[at : at + 4096]) >> np.uint64(32)).min(1)
        best = low if best is None else np.minimum(best, low)
    return best.astype(np.uint32).view(np.int32)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(s.tobytes())
    return ((d >> 64) ^ (1 << 63)) - (1 << 63), ((d & (2**64 - 1)) ^ (1 << 63)) - (1 << 63)


def linked_components(
    ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT
) -> np.ndarray:
    """For each text the smallest id its component holds, given components known so far.

    Texts of equal label are connected already. Exact: two texts in different
    components afterwards have no link.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    _, label = np.unique(labels, return_inverse=True)
    order = np.argsort(label, kind="stable")
    bounds = np.searchsorted(label[order], np.arange(label.max() + 2))
    waiting = np.ones(n, bool)
    left = n
    root = np.zeros(n, ids.dtype)
    index: tuple = (None, None, None, None)

    def build(nodes: np.ndarray) -> tuple:
        values = np.concatenate([sets[i] for i in nodes])
        owner = np.repeat(nodes, size[nodes])
        by = np.argsort(values, kind="stable")
        keys, first = np.unique(values[by], return_index=True)
        return len(nodes), keys, np.append(first, len(values)), owner[by]

    def links(p: int) -> np.ndarray:
        nonlocal index
        if index[0] is None or left * 2 < index[0]:
            index = build(np.flatnonzero(waiting))
        _, keys, first, owner = index
        at = np.searchsorted(keys, sets[p])
        at[at == len(keys)] = 0
        at = at[keys[at] == sets[p]]
        count = first[at + 1] - first[at]
        if not count.sum():
            return np.empty(0, np.int64)
        where = np.repeat(first[at] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        common = np.bincount(owner[where], minlength=n)
        return np.flatnonzero(waiting & (common > 0) & (100 * common >= percent * (size + size[p] - common)))

    for start in range(label.max() + 1):
        members = order[bounds[start] : bounds[start + 1]]
        if not waiting[members[0]]:
            continue
        waiting[members] = False
        left -= len(members)
        found, todo = [members], list(members)
        while todo and left:
            for q in links(todo.pop()):
                if waiting[q]:
                    more = order[bounds[label[q]] : bounds[label[q] + 1]]
                    waiting[more] = False
                    left -= len(more)
                    found.append(more)
                    todo.extend(more)
        everyone = np.concatenate(found)
        root[everyone] = ids[everyone].min()
    return root


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t (hash of the text) and the sketch of each row."""

    @F.pandas_udf("n long, h1 long, h2 long, mh array<int>")
    def sketch(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            s = shingles(t, words)
            rows.append((len(s), *set_digest(s), minhashes(s)))
        return pd.DataFrame(rows, columns=["n", "h1", "h2", "mh"])

    own = docs.select("doc_id", F.xxhash64("text").alias("t"), sketch("text").alias("s"))
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "t", "s.*")


def _once(rows: DataFrame, chosen: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``chosen`` (keys, c, ...) with the least ``value`` of the rows of its keys, one at least and c at most.

    Only where there may be several is anything aggregated, and many copies of
    one row meet as partial results, not in one task.
    """
    cols = chosen.columns
    joined = rows.select(*keys, value.alias("value")).join(chosen, keys)
    many = joined.filter("c > 1").groupBy(*cols).agg(F.min("value").alias("value"))
    return joined.filter("c = 1").select(*cols, "value").unionByName(many)


def _table_keys() -> Column:
    mh = lambda i: F.col("mh")[i]
    keys = []
    for i in range(SKETCHES):
        for j in range(SKETCHES):
            a = [mh(i * ROWS + k) for k in range(ROWS)]
            b = [mh((SKETCHES + j) * ROWS + k) for k in range(ROWS)]
            keys.append(F.xxhash64(F.lit(i * SKETCHES + j), *a, *b))
    return F.array(*keys)


def _search(rows: DataFrame, keys: list[str], words: int, percent: int) -> DataFrame:
    """(src, dst) spanning edges of the links inside each block of ``rows``."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node"])
        ids = pdf["node"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0]})
        root = linked_components(ids, [shingles(t, words) for t in pdf["text"]], pdf["label"].to_numpy(), percent)
        moved = root != ids
        return pd.DataFrame({"src": ids[moved], "dst": root[moved]})

    return rows.groupBy(*keys).applyInPandas(block, "src long, dst long")


def _components(docs: DataFrame, words: int, percent: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Every row's sketch (doc_id, t, n, h1, h2), and (h1, h2, n, c, doc, t, component) of each set.

    A node is a shingle set, whatever ids its c rows have; ``doc`` is the
    smallest of them, ``t`` the text hash of a row of that id, and
    ``component`` a node that all sets linked with it name.
    """
    rows = cut(_sketched(docs, words))
    named = rows.filter("n > 0 and doc_id is not null")
    nodes = cut(
        named.groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("doc_id", "t", "mh")).alias("m"), F.count(F.lit(1)).alias("c"))
        .select("h1", "h2", "n", "c", "m.*", F.monotonically_increasing_id().alias("node"))
    )
    in_tables = nodes.select("node", "h1", F.explode(_table_keys()).alias("key"))
    pivots = (
        in_tables.groupBy("key")
        .agg(F.min(F.struct(F.xxhash64("h1", "key").alias("o"), F.col("node").alias("pivot"))).alias("p"), F.count(F.lit(1)).alias("c"))
        .filter("c > 1")
        .select("key", "p.pivot")
    )
    pairs = in_tables.join(pivots, "key").filter("node <> pivot").select("node", "pivot").distinct()
    mine, other = nodes.select("node", "mh"), nodes.select(F.col("node").alias("pivot"), F.col("mh").alias("mh2"))
    same = F.aggregate(
        F.zip_with("mh", "mh2", lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    edges = pairs.join(mine, "node").join(other, "pivot").filter(same >= least_agreeing(percent)).select("node", "pivot")
    groups = connected_components(edges, "node", "pivot").select("node", F.col("component").alias("grp"))
    groups = groups.join(nodes.select("node", "n", "doc_id", "t", "c"), "node")
    blocks = groups.groupBy("grp").agg(F.ceil(F.sum("n") / block_shingles).cast("long").alias("blocks"))
    groups = cut(groups.join(blocks, "grp"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    cols = ["node", "grp", "doc_id", "t", "c", "label"]

    def dealt(seed: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks"))

    def searched(chosen: DataFrame, keys: list[str]) -> DataFrame:
        whole = _once(texts, chosen, ["doc_id", "t"], F.col("text")).withColumnRenamed("value", "text")
        return _search(whole, keys, words, percent)

    first = groups.withColumn("label", F.col("node")).select(*cols, dealt(1).alias("block"))
    links = cut(searched(first, ["grp", "block"]))
    large = groups.filter("blocks > 1")
    if large.limit(1).count():
        again = large.withColumn("label", F.col("node")).select(*cols, dealt(2).alias("block"))
        links = cut(links.unionByName(searched(again, ["grp", "block"])))
        known = connected_components(links).select("node", F.col("component").alias("label"))
        state = cut(large.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")))
        main = (
            state.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("grp")
            .agg(F.max(F.struct("k", "label")).alias("m")).select("grp", F.col("m.label").alias("main"))
        )
        minor = state.join(main, "grp").filter("label <> main").drop("main")
        parts = minor.groupBy("grp").agg(F.ceil(F.sum("n") / block_shingles).cast("long").alias("parts"))
        span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))
        few = minor.join(parts, "grp").select(*cols, part.alias("part"), span("blocks").alias("block"))
        many = state.join(parts, "grp").select(*cols, span("parts").alias("part"), dealt(1).alias("block"))
        links = cut(links.unionByName(searched(few.unionByName(many).distinct(), ["grp", "part", "block"])))
        final = connected_components(links)
    else:
        # Within one block a search names each component's root itself.
        final = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    sets = nodes.select("h1", "h2", "n", "c", "node", F.col("doc_id").alias("doc"), "t").join(final, "node", "left")
    return rows.drop("mh"), sets.withColumn("component", F.coalesce("component", "node"))


def least_agreeing(percent: int) -> int:
    """Of ``MINHASHES`` at least so many agree but for once in about 10^5 pairs of this similarity."""
    p = percent / 100
    return max(1, int(MINHASHES * p - 4.5 * (MINHASHES * p * (1 - p)) ** 0.5))


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of similarity
    ``percent`` or more; the rows of one doc_id reach each other, whatever
    their texts. A null or empty text has no shingles, links with nothing and
    is its own component; so is a row without doc_id, with a null component. An
    empty table gives no rows; other columns are ignored. Runs actions.

    The tables are made for 80 %: a pair of less similarity shares one with
    lower probability (0.57 at 40 %).
    """
    rows, sets = _components(docs, words, percent, block_shingles)
    lowest = sets.groupBy("component").agg(F.min("doc").alias("low"))
    by_set = cut(sets.join(lowest, "component").select("h1", "h2", "n", "component", "low"))
    # Ids whose rows hold several components join these.
    linked = rows.filter("n > 0 and doc_id is not null").select("doc_id", "h1", "h2", "n").distinct()
    several = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    across = linked.join(several, "doc_id").join(by_set, ["h1", "h2", "n"]).select("doc_id", "component", "low").distinct()
    hub = across.groupBy("doc_id").agg(F.min("component").alias("hub"))
    ties = cut(across.join(hub, "doc_id").select("component", "hub", "low"))
    if ties.limit(1).count():
        joined = connected_components(ties, "component", "hub")
        roots = joined.select(F.col("node").alias("component"), F.col("component").alias("root"))
        least = by_set.select("component", "low").distinct().join(roots, "component")
        least = least.groupBy("root").agg(F.min("low").alias("least"))
        tied = roots.join(least, "root").select("component", "least")
        by_set = by_set.join(tied, "component", "left").withColumn("low", F.coalesce("least", "low")).drop("least")
    out = rows.join(by_set.select("h1", "h2", "n", "low"), ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce(F.when(F.col("n") > 0, F.col("low")), "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates.

    It is the row of the smallest doc_id, then of the smallest text hash; here
    rows are near duplicates by their texts alone, so different texts of one
    doc_id all stay. Of rows with the same doc_id and text the least by the
    other columns stays. Rows without a doc_id stay, and rows without words
    stay, once per doc_id and text.
    """
    options = {"words": WORDS, "percent": PERCENT, "block_shingles": BLOCK_SHINGLES} | options
    rows, sets = _components(docs, **options)
    best = sets.groupBy("component").agg(F.min(F.struct(F.col("doc").alias("doc_id"), "t")).alias("m"), F.sum("c").alias("c"))
    blank = rows.filter("n = 0 and doc_id is not null").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("c"))
    stay = best.select("m.*", "c").unionByName(blank)
    cols = docs.columns
    keyed = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    )
    kept = _once(keyed, stay, ["doc_id", "t"], F.col("row")).select("value.*")
    return kept.unionByName(docs.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in cols])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
