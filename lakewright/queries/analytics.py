"""Queries of series, statistics, integrity, counters and the relational baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import agreement, evidence, integrity, ordered, rounds
from lakewright.queries.tables import EVIDENCE, answers, nuggets, read

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_NOVEL = f"""{EVIDENCE}, n AS (SELECT topic_id, origin_round AS round, count(*) AS novelty FROM nuggets GROUP BY ALL),
sp AS (SELECT topic_id, unnest(range(0, max(round) + 1)) AS round FROM n GROUP BY topic_id),
series AS (SELECT topic_id, round, coalesce(novelty, 0) AS novelty FROM sp LEFT JOIN n USING (topic_id, round))"""


@_query("novelty", f"WITH {_NOVEL} SELECT topic_id, CAST(round AS INTEGER) AS round, novelty FROM series")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.novelty(nuggets(spark, sf_dir))


@_query(
    "saturation",
    f"""WITH {_NOVEL} SELECT topic_id, CAST(round AS INTEGER) AS round, novelty, count(*) OVER w = 2 AND max(novelty) OVER w <= 1 AS saturated
FROM series WINDOW w AS (PARTITION BY topic_id ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.saturation(rounds.novelty(nuggets(spark, sf_dir)))


_SIZES = f"""{EVIDENCE}, sizes AS (SELECT topic_id, origin_round AS round, sum(count(*)) OVER (PARTITION BY topic_id ORDER BY origin_round) AS size FROM nuggets GROUP BY topic_id, origin_round)"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nuggets(spark, sf_dir).groupBy("topic_id", F.col("origin_round").alias("round")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("topic_id", "round", ordered.running(F.col("n"), ["topic_id"], ["round"]).alias("size"))


@_query(
    "carry_forward",
    f"""WITH {_SIZES}, sp AS (SELECT topic_id, unnest(range(0, 9)) AS round FROM (SELECT DISTINCT topic_id FROM sizes))
SELECT topic_id, CAST(round AS INTEGER) AS round, CAST(last_value(size IGNORE NULLS) OVER (PARTITION BY topic_id ORDER BY round ROWS UNBOUNDED PRECEDING) AS BIGINT) AS size, size IS NULL AS gap
FROM sp LEFT JOIN sizes USING (topic_id, round)""",
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.carry_forward(_sizes(spark, sf_dir), 8)


@_query(
    "bank_growth",
    f"""WITH {_SIZES} SELECT topic_id, round, CAST(size AS BIGINT) AS size, CAST(size - lag(size) OVER w AS BIGINT) AS change, coalesce(size - lag(size) OVER w < 0, false) AS shrank
FROM sizes WINDOW w AS (PARTITION BY topic_id ORDER BY round)""",
)
def bank_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.growth(_sizes(spark, sf_dir))


@_query(
    "claims_per_round",
    f"""WITH {EVIDENCE} SELECT n.topic_id, n.origin_round AS round, count(a.nugget_id) AS claims, count(*) FILTER (a.flag = 'A') AS accepted
FROM nuggets n LEFT JOIN answers a USING (nugget_id) GROUP BY ALL""",
)
def claims_per_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).select("nugget_id", "flag", F.lit(1).alias("one"))
    j = nuggets(spark, sf_dir).join(a, "nugget_id", "left")
    return j.groupBy("topic_id", F.col("origin_round").alias("round")).agg(F.count("one").alias("claims"), F.count_if(F.col("flag") == "A").alias("accepted"))


@_query(
    "citations_histogram",
    f"""WITH {EVIDENCE}, s AS (SELECT nugget_id, count(DISTINCT doc_id) AS docs FROM answers GROUP BY nugget_id) SELECT docs, count(*) AS nuggets FROM s GROUP BY docs""",
)
def citations_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = answers(spark, sf_dir).groupBy("nugget_id").agg(F.count_distinct("doc_id").alias("docs"))
    return s.groupBy("docs").agg(F.count(F.lit(1)).alias("nuggets"))


@_query(
    "quartiles_exclusive",
    """WITH v AS (SELECT event_type, list(value ORDER BY value) AS v, avg(value) AS mean, count(*) AS n FROM events GROUP BY event_type),
q AS (SELECT event_type, n, mean, v, i, greatest(least(i * (n + 1) // 4, n - 1), 1) AS j, i * (n + 1) - 4 * greatest(least(i * (n + 1) // 4, n - 1), 1) AS d FROM v, range(1, 4) t(i)),
x AS (SELECT event_type, n, mean, i, (v[j] * (4 - d) + v[j + 1] * d) / 4 AS q FROM q)
SELECT event_type, n, round(mean, 6) AS mean, round(max(q) FILTER (i = 1), 6) AS q1, round(max(q) FILTER (i = 2), 6) AS q2, round(max(q) FILTER (i = 3), 6) AS q3 FROM x GROUP BY event_type, n, mean""",
)
def quartiles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = agreement.exclusive_quartiles(read(spark, sf_dir, "events"), "value", ["event_type"])
    return q.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q1", "q2", "q3")])


@_query(
    "summary_linear",
    """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
  min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type""",
)
def summary_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = agreement.summary(read(spark, sf_dir, "events"), "value", ["event_type"])
    return s.select("event_type", "n", "lo", "hi", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3", "mean")])


@_query(
    "upper_median",
    "SELECT user_id, count(*) AS n, list(value ORDER BY value)[count(*) // 2 + 1] AS median FROM events GROUP BY user_id",
)
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.upper_median(read(spark, sf_dir, "events"), "value", ["user_id"])


@_query(
    "kde_curve",
    """WITH s AS (SELECT count(value) AS n, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) * pow(count(value), -0.2) AS h FROM events),
g AS (SELECT i * (200.0::DOUBLE / 40) AS x FROM range(0, 41) t(i)),
c AS (SELECT value AS v, count(*) AS c FROM events GROUP BY value)
SELECT x, round(sum(c * (exp(-pow((x - v) / h, 2) / 2) + exp(-pow((x + v) / h, 2) / 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM g, c, s GROUP BY x""",
)
def kde_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = agreement.kde(read(spark, sf_dir, "events"), "value", points=41, hi=200.0)
    return k.withColumn("density", F.round("density", 9))


_RUN = """r AS (SELECT user_id AS topic_id, event_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events),
l AS (SELECT event_id AS doc_id, event_type AS lang FROM events)"""


@_query(
    "language_mix",
    f"""WITH {_RUN}, x AS (SELECT cut, r.*, l.lang FROM r JOIN l USING (doc_id), (VALUES (5), (20), (60)) c(cut)),
n AS (SELECT cut, lang, count(*) AS n FROM x WHERE rank <= cut GROUP BY ALL),
d AS (SELECT cut, count(*) FILTER (d >= cut) AS topics FROM (SELECT cut, topic_id, max(rank) AS d FROM x GROUP BY ALL) GROUP BY cut)
SELECT cut, lang, n, round(100 * n / sum(n) OVER (PARTITION BY cut), 6) AS share, topics FROM n JOIN d USING (cut)""",
)
def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakewright.operators.legs import top_k

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("topic_id"), F.col("event_id").alias("doc_id"), "value", F.col("event_type").alias("lang"))
    run = top_k(e, 2**31 - 1, ["topic_id"], "value", "doc_id").select("topic_id", "doc_id", "rank")
    return agreement.language_mix(run, e.select("doc_id", "lang"), [5, 20, 60])


@_query(
    "set_agreement",
    """WITH s AS (SELECT user_id, list(DISTINCT CAST(value AS INTEGER)) FILTER (event_type = 'view') AS a, list(DISTINCT CAST(value AS INTEGER)) FILTER (event_type = 'click') AS b,
  list(DISTINCT CAST(value AS INTEGER)) FILTER (event_type = 'error') AS c FROM events GROUP BY user_id)
SELECT user_id, round(len(list_intersect(list_intersect(a, b), c)) / len(list_distinct(list_concat(list_concat(a, b), c))), 9) AS three_way,
  round(len(list_filter(a, lambda x: NOT list_contains(b, x) AND NOT list_contains(c, x))) / len(a), 9) AS unique_share FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""",
)
def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("v", F.bround("value", 0).cast("int"))
    lists = [F.collect_set(F.when(F.col("event_type") == t, F.col("v"))).alias(n) for t, n in (("view", "a"), ("click", "b"), ("error", "c"))]
    s = e.groupBy("user_id").agg(*lists).filter("size(a) > 0 and size(b) > 0 and size(c) > 0")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return s.select("user_id", F.round(agreement.three_way(a, b, c), 9).alias("three_way"), F.round(agreement.unique_share(a, b, c), 9).alias("unique_share"))


@_query(
    "asof_document",
    """SELECT e.event_id, e.user_id, o.o_orderkey AS order_id FROM events e ASOF LEFT JOIN
(SELECT o_custkey, o_orderdate + INTERVAL 22 YEAR AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.t""",
)
def asof_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last order, orders moved 22 years on."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.add_months("o_orderdate", 264).cast("timestamp").alias("t"), F.col("o_orderkey").alias("order_id")
    )
    return ordered.as_of(e, o, by="user_id", at="ts", start="t", value="order_id").drop("ts")


@_query(
    "interpolated",
    """WITH r AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
a AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS xa, last_value(v IGNORE NULLS) OVER b AS ya,
  first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS xb, first_value(v IGNORE NULLS) OVER f AS yb FROM r
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, ya + (yb - ya) / nullif(xb - xa, 0) * (event_id - xa)), 6) AS filled FROM a""",
)
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return ordered.interpolate(e, ["user_id"], "event_id", "v").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@_query(
    "set_digest",
    "SELECT o_orderstatus, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || chr(10), '' ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY o_orderstatus",
)
def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.set_digest(read(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus"])


@_query(
    "set_equality",
    """WITH l AS (SELECT l_orderkey AS id FROM lineitem), r AS (SELECT o_orderkey AS id FROM orders),
n AS (SELECT id, count(*) FILTER (s = 0) AS l, count(*) FILTER (s = 1) AS r FROM (SELECT id, 0 AS s FROM l UNION ALL SELECT id, 1 FROM r) GROUP BY id)
SELECT side, count(*) AS n FROM (SELECT CASE WHEN r = 0 THEN 'left only' WHEN l = 0 THEN 'right only' WHEN l > 1 OR r > 1 THEN 'twice' END AS side FROM n) WHERE side IS NOT NULL GROUP BY side""",
)
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    right = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return integrity.set_difference(left, right, "id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "metrics_counters",
    """SELECT event_type AS metric, '{"k":"' || (CAST(json_extract(props, '$.k') AS INTEGER) % 4) || '","u":"' || (user_id % 3) || '"}' AS slice_key, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY ALL""",
)
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 4
    slices = F.create_map(F.lit("u"), (F.col("user_id") % 3).cast("string"), F.lit("k"), k.cast("string"))
    return integrity.counters(read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), slices.alias("slices"), "value"))


@_query(
    "metrics_cube",
    """SELECT event_type, CAST(user_id % 3 AS BIGINT) AS u, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, CAST(user_id % 3 AS BIGINT))""",
)
def metrics_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: every slice combination of the counters in one pass."""
    e = read(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 3)
    return e.cube("event_type", "u").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_query(
    "stale_leases",
    """SELECT user_id AS owner, max(ts) AS last_beat, round(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)), 3) AS age_s,
  epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) > 43200 AS stale FROM events GROUP BY user_id""",
)
def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), "ts")
    return integrity.stale_leases(beats, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 43200)


@_query(
    "first_writer",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
)
def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.first_writer(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@_query(
    "hash_sample",
    "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('s1' || event_id), event_id) AS r FROM events) WHERE r <= 20",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.hash_sample(read(spark, sf_dir, "events"), ["event_type"], "event_id", 20, "s1").select("event_type", "event_id")


@_query("finite_check", "SELECT count(*) AS n, count(*) FILTER (event_id % 10 < 3) AS bad FROM events")
def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values made not a number or infinite by the remainder of their event."""
    kind, lit = F.col("event_id") % 10, lambda x: F.lit(float(x))
    broken = F.when(kind == 0, lit("nan")).when(kind == 1, lit("inf")).when(kind == 2, lit("-inf")).otherwise(F.col("value"))
    e = read(spark, sf_dir, "events").withColumn("value", broken)
    bad = integrity.finite_violations(e, ["value"]).agg(F.count(F.lit(1)).alias("bad"))
    return e.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bad))


@_query(
    "star_join_agg",
    """SELECT r_name, n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""",
)
def star_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n, r = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return j.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), revenue.alias("revenue"))


@_query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 9) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.to_timestamp(F.lit("1999-09-02 00:00:00")))
    charge = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2)
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("quantity"), charge.alias("charge"), F.round(F.avg("l_discount"), 9).alias("discount"), F.count(F.lit(1)).alias("n")
    )


@_query(
    "semi_anti",
    """SELECT c_mktsegment, count(*) FILTER (e) AS with_orders, count(*) FILTER (NOT e) AS without_orders
FROM (SELECT *, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS e FROM customer) GROUP BY c_mktsegment""",
)
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda how, name: c.join(o, "c_custkey", how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias(name))
    j = n("left_semi", "with_orders").join(n("left_anti", "without_orders"), "c_mktsegment", "full")
    return j.select("c_mktsegment", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("with_orders", "without_orders")])


@_query(
    "run_starts",
    """SELECT l_suppkey, l_orderkey, ordinal FROM (SELECT l_suppkey, l_orderkey, row_number() OVER w - 1 AS ordinal, lag(l_orderkey) OVER w AS before
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)) WHERE before IS DISTINCT FROM l_orderkey""",
)
def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of each order begin in a supplier's list."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return ordered.run_starts(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_orderkey")


@_query(
    "part_slices",
    """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
bounds AS (SELECT o_orderstatus, i AS slice, i * n // 7 AS first, (i + 1) * n // 7 AS stop FROM (SELECT DISTINCT o_orderstatus, n FROM r), range(7) t(i))
SELECT r.o_orderstatus, o_orderkey, slice FROM r JOIN bounds b ON b.o_orderstatus = r.o_orderstatus AND place >= first AND place < stop""",
)
def part_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a status in seven contiguous slices."""
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return ordered.slices(rows, ["o_orderstatus"], ["o_orderkey"], 7)


@_query(
    "sequence_mismatch",
    """WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal FROM documents),
b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal FROM documents WHERE n_chars > 100 OR lang = 'en')
SELECT lang, min(ordinal) AS ordinal FROM a FULL JOIN b USING (lang, ordinal) WHERE a.doc_id IS DISTINCT FROM b.doc_id GROUP BY lang""",
)
def sequence_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each language against the ids without short documents, which all languages but one lose."""
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    order = lambda d: ordered.parts(d.select("lang", "doc_id"), ["lang"], ["doc_id"], 1_000).withColumn("ordinal", F.col("ordinal").cast("long"))
    return integrity.first_mismatch(order(docs), order(docs.filter("n_chars > 100 or lang = 'en'")), ["lang"], "ordinal", "doc_id")


@_query("vital_nuggets", f"WITH {EVIDENCE} SELECT nugget_id, coalesce(weight >= 0.5, false) AS vital FROM nuggets")
def vital_nuggets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nuggets(spark, sf_dir).select("nugget_id", evidence.vital(F.col("weight"), 0.5).alias("vital"))


@_query("topic_gaps", "SELECT c_custkey AS topic_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def topic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as topics that no finished order covers."""
    topics = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic_id"))
    run = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("topic_id"))
    return evidence.uncovered(topics, run)
