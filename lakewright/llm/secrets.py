"""Secret scans: fixed patterns, and character Markov models for the rest.

Two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, are compared by log-likelihood ratio on every token
that could be a key. DataFrame functions only; the model is a table of at most
95 x 95 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import hex_long, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run of 16 or more hex digits, and of 14 or more after AKIA, is what is left
#: of the patterns above when shorter matches are dropped: both take whole runs.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"
#: A token that could be a key: 16 or more characters, not all of them separators.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[+/_=-]*+[A-Za-z0-9])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Of characters 33 to 126 each has its own state; all others share one.
STATES = 95
#: Labelled samples: so many random strings, and the words of so many documents.
RANDOM_STRINGS = 4_000
WORD_DOCS = 400
#: A token is a secret from this mean log-likelihood ratio per step on.
LLR = 0.4


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct(start, end, kind, found)> of the matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    none = F.lit([]).cast("array<struct<start:bigint,end:bigint,kind:string,found:string>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(
        F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found"))
    )
    out = F.aggregate(pairs, zero, step)["out"]
    if keep is not None:
        out = F.filter(out, keep)
    return F.when(text.rlike(pattern), out).otherwise(none)


def base_spans(text: Column) -> Column:
    long_value = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12
    return F.concat(
        spans(text, ASSIGN, "assign", long_value),
        spans(text, ACCESS_LONG, "access"),
        spans(text, HEX_LONG, "hex"),
    )


def _state(code: Column) -> Column:
    return F.when((code >= 33) & (code <= 126), code - 33).otherwise(F.lit(STATES - 1))


def _steps(strings: DataFrame) -> DataFrame:
    """(a, b) state pairs of the column ``s``."""
    codes = F.transform(F.split("s", ""), lambda c: _state(F.ascii(c)))
    pairs = F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return strings.filter(F.length("s") >= 2).select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def labelled_samples(docs: DataFrame, seed: str = "secrets") -> DataFrame:
    """(s, random): RANDOM_STRINGS keys in three alphabets; words of WORD_DOCS documents.

    The documents are those with the smallest hashes. Words with digits are
    left out, for they may be keys themselves.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    text = (
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 3 == 1, F.substring(b64, 1, 40))
        .otherwise(F.substring(F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")), 1, 32))
    )
    random = spark.range(RANDOM_STRINGS).select(text.alias("s"), F.lit(1).alias("random"))
    order = hex_long(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(order, "doc_id").limit(WORD_DOCS)
    words = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id", "left_semi")
        .select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_-]{4,}"), 0)).alias("s"))
    )
    return random.unionByName(words.select("s", F.lit(0).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios, row by row (STATES x STATES numbers).

    Add-half smoothing. What reaches the driver is one row per pair of states
    and label, 18,050 at most.
    """
    counts = {0: [[0.0] * STATES for _ in range(STATES)], 1: [[0.0] * STATES for _ in range(STATES)]}
    import math

    for label in (0, 1):
        for r in _steps(samples.filter(F.col("random") == label)).groupBy("a", "b").count().collect():
            counts[label][r["a"]][r["b"]] = float(r["count"])
    table_ = []
    for a in range(STATES):
        total = {k: sum(counts[k][a]) + 0.5 * STATES for k in (0, 1)}
        for b in range(STATES):
            p1, p0 = ((counts[k][a][b] + 0.5) / total[k] for k in (1, 0))
            table_.append(round(math.log(p1 / p0), 6))
    return table_


def llr(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per step of a token of two characters or more."""
    numbers = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: _state(F.ascii(c)))
    n = F.length(token) - 1
    scores = F.zip_with(
        F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.element_at(numbers, a * STATES + b + 1)
    )
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / n


def scan(docs: DataFrame, model: list[float], threshold: float = LLR) -> DataFrame:
    """doc_id, base, spans: arrays of struct(start, end, kind, found), sorted.

    ``base`` holds what the fixed patterns find; ``spans`` also the tokens that
    the models call random and that touch no base span. Sorted by start, then
    by kind in the order of KINDS. A null text is empty; repeated rows are
    scanned alike; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", base_spans(text).alias("base"), spans(text, TOKEN, "markov").alias("tokens"))
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    own = own.withColumn("tokens", F.filter("tokens", lambda t: free(t) & (llr(t["found"], model) >= threshold)))
    kind = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    by_start = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("o"), kind(s).alias("k"), s.alias("s")))),
        lambda x: x["s"],
    )
    return own.select("doc_id", by_start(F.col("base")).alias("base"), by_start(F.concat("base", "tokens")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, train(labelled_samples(docs)))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
