"""URL filters by rules and, where no rule fits, by link-graph propagation.

Trust flows along host edges from the hosts that rules allow, distrust flows
against them from the hosts that rules block (personalised PageRank, one joint
iteration). A host is blocked when distrust makes up at least a set share of
both. DataFrame functions only.

Host edges are absolute links in pages, and an edge both ways between a host
and its parent domain (a.b.c and b.c), for a site vouches for its subdomains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import lower_ascii, table
from lakewright.plans.checkpoints import cut

#: (host, path, verdict) of the registered query. Fixed values.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING = 0.85
#: What may still move of either side's mass when propagation ends; DAMPING^k of it moves in round k.
TOLERANCE = 0.01
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Rounds between checkpoints.
CUT_EVERY = 5
#: Block where distrust / (trust + distrust) reaches this.
BLOCK_SHARE = 0.6
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def longest_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        mine = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, mine).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of distinct host links of pages (host, html), loops left out.

    Null or empty hosts and null html have no links; repeated pages count once;
    an empty table gives no rows. Relative links stay on their host.
    """
    seen = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))
    links = pages.filter(F.col("html").rlike(LINK)).select(
        F.col("host").alias("src"), F.explode(F.transform(seen, lower_ascii)).alias("dst")
    )
    # Every host under its parent domains, down to two labels.
    labels = F.split("host", r"\.")
    n = F.size(labels)
    name = lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")
    steps = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(name(i).alias("host"), name(i + 1).alias("up")))
    whole = pages.select("host").distinct().filter((n >= 3) & ~F.exists(labels, lambda x: x == ""))
    tiers = whole.select(F.explode(steps).alias("s")).select("s.*").distinct()
    down = tiers.select(F.col("host").alias("src"), F.col("up").alias("dst"))
    back = tiers.select(F.col("up").alias("src"), F.col("host").alias("dst"))
    return links.unionByName(down).unionByName(back).filter("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad): row counts per host.

    Each side's scores sum to at most 1. Hosts that nothing reaches are absent.
    """
    edges = cut(edges)
    outs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    ins = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    ahead = edges.join(outs, "src").select("src", "dst", (1 / F.col("n")).alias("wt"), F.lit(0.0).alias("wd"))
    against = edges.join(ins, "dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("wt"), (1 / F.col("n")).alias("wd")
    )
    flow = cut(ahead.unionByName(against))
    both = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    good, bad = (both["g"] or 0), (both["b"] or 0)
    start = cut(
        seeds.select(
            "host",
            (F.col("good") / F.lit(max(good, 1))).alias("trust"),
            (F.col("bad") / F.lit(max(bad, 1))).alias("distrust"),
        ).filter("trust > 0 or distrust > 0")
    )
    rank = start
    for k in range(rounds):
        came = flow.join(rank.withColumnRenamed("host", "src"), "src").select(
            F.col("dst").alias("host"),
            (F.col("trust") * F.col("wt") * damping).alias("trust"),
            (F.col("distrust") * F.col("wd") * damping).alias("distrust"),
        )
        home = start.select(
            "host",
            (F.col("trust") * (1 - damping)).alias("trust"),
            (F.col("distrust") * (1 - damping)).alias("distrust"),
        )
        rank = came.unionByName(home).groupBy("host").agg(
            F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")
        )
        if k % CUT_EVERY == CUT_EVERY - 1 or k == rounds - 1:
            rank = cut(rank)
    return rank


def judge_urls(
    pages: DataFrame, rules=RULES, *, rounds: int = ROUNDS, block_share: float = BLOCK_SHARE
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row (page_id, url, html).

    The longest rule that fits decides; else the host's share of distrust,
    rounded to 9 digits so that the order of sums can't tip it. A null url or
    one without ``://`` has an empty host and path and is allowed, as is any
    host that neither seed reaches. Repeated rows are judged alike; an empty
    table gives no rows; null html has no links. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = own.select("page_id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("r"))
    seeds = judged.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("r.verdict") == "allow").alias("good"), F.count_if(F.col("r.verdict") == "block").alias("bad")
    )
    scores = propagate(host_edges(own.select("host", "html")), seeds, rounds=rounds)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    scores = scores.withColumn("by_host", F.when(share >= block_share, "block").otherwise("allow"))
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", "by_host", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")
