import re

import pytest
from pyspark.sql import functions as F

from lakewright.llm import url_filter as U

PAGES = "page_id long, url string, html string"


def judge(spark, rows, **kw):
    return {r["page_id"]: r for r in U.judge_urls(spark.createDataFrame(rows, PAGES), **kw).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "com/en/", "block"),
        ("http://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("https://m.example.net/de/8", "m.example.net", "/de/8", "example.net/de/8", "block"),
        ("https://m.example.net/de/9#f", "m.example.net", "/de/9", "net/de/", "allow"),
        ("x://y://z/en/", "y:", "//z/en/", None, None),
        ("http://Ärger.org?q=/es/", "Ärger.org", "", None, None),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judge(spark, [(1, url, None)], rounds=1)[1]
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert verdict is None or r["verdict"] == verdict


def by_hand(edges, seeds, damping, rounds):
    outs, ins = {}, {}
    for a, b in edges:
        outs[a] = outs.get(a, 0) + 1
        ins[b] = ins.get(b, 0) + 1
    start = [{h: s[k] / max(1, sum(x[k] for x in seeds.values())) for h, s in seeds.items()} for k in (0, 1)]
    rank = [dict(s) for s in start]
    for _ in range(rounds):
        new = [{h: (1 - damping) * v for h, v in s.items()} for s in start]
        for a, b in edges:
            new[0][b] = new[0].get(b, 0) + damping * rank[0].get(a, 0) / outs[a]
            new[1][a] = new[1].get(a, 0) + damping * rank[1].get(b, 0) / ins[b]
        rank = new
    return rank


def test_propagation_follows_the_hand_computation(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "d"), ("d", "a")]
    seeds = {"a": (3, 0), "d": (0, 2), "e": (1, 1)}
    got = U.propagate(
        spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good int, bad int"),
        rounds=5,
    )
    trust, distrust = by_hand(edges, seeds, U.DAMPING, 5)
    for r in got.collect():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0))


def test_links_decide_where_no_rule_fits(spark):
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [
        (1, "http://bad.org/es/1", ""),
        (2, "http://farm.info/1", link("bad.org")),
        (3, "http://good.net/de/1", link("friend.info")),
        (4, "http://friend.info/1", None),
        (5, "http://alone.info/1", ""),
    ]
    got = {k: r["verdict"] for k, r in judge(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_edges(spark):
    rows = [(1, "http://a.com/en/1", "<a href=x>")] * 3 + [(None, None, None)]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("trust", F.lit(1))
    out = U.judge_urls(df, rounds=2).collect()
    assert sorted(r["verdict"] for r in out) == ["allow", "block", "block", "block"]
    assert U.judge_urls(df.filter("false"), rounds=1).count() == 0


def test_deep_hosts_reach_their_domain(spark):
    df = spark.createDataFrame([(1, "http://a.b.c.d.e.example.org/x", None), (2, "http://example.org/es/1", None), (3, "http://a..org/", None)], "page_id long, url string, html string")
    host, path = U.host_and_path(F.col("url"))
    edges = {(r["src"], r["dst"]) for r in U.host_edges(df.select(host.alias("host"), "html")).collect()}
    chain = ["a.b.c.d.e.example.org", "b.c.d.e.example.org", "c.d.e.example.org", "d.e.example.org", "e.example.org", "example.org"]
    assert edges == {p for x, y in zip(chain, chain[1:]) for p in ((x, y), (y, x))}
    assert {r["page_id"]: r["verdict"] for r in U.judge_urls(df).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_query_matches_brute_force(spark, sf_dir):
    """Rules and the whole propagation again in plain Python, on every page."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    links = re.compile(U.LINK)
    edges, good, bad, judged = set(), {}, {}, {}
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    for page, url, html in rows:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fit = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged[page] = (host, path, max(fit)[1:] if fit else None)
        if host and fit:
            side = good if max(fit)[2] == "allow" else bad
            side[host] = side.get(host, 0) + 1
        edges |= {(host, lower(x)) for x in links.findall(html or "")}
        parts = host.split(".")
        for i in range(len(parts) - 2 if all(parts) else 0):
            a, b = ".".join(parts[i:]), ".".join(parts[i + 1 :])
            edges |= {(a, b), (b, a)}
    edges = {(a, b) for a, b in edges if a and b and a != b}
    scores = by_hand(edges, {h: (good.get(h, 0), bad.get(h, 0)) for h in {*good, *bad}}, U.DAMPING, U.ROUNDS)
    got = {r["page_id"]: r for r in U.query(spark, sf_dir).collect()}
    assert set(got) == set(judged)
    for page, (host, path, rule) in judged.items():
        r = got[page]
        trust, distrust = (s.get(host, 0.0) for s in scores)
        by_host = "block" if trust + distrust > 0 and round(distrust / (trust + distrust), 9) >= U.BLOCK_SHARE else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule[0], rule[1] if rule else by_host)
