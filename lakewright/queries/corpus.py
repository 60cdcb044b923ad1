"""Queries of the corpus half: chrome, paragraphs, spans, units, renderings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.operators import acceptance, boilerplate, folds, ordered, segment, translation
from lakewright.plans.checkpoints import cut
from lakewright.plans.grouped import fold_groups
from lakewright.queries.tables import documents, lines, read

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rx(*patterns: str) -> str:
    alternatives = "|".join(f"(?:{p})" for p in patterns)
    quoted = alternatives.replace("'", "''").replace(r"\w", r"\pL\pN_")
    return f"regexp_matches(line, '{quoted}', 'i')"


_LINES = "l AS (SELECT doc_id, i - 1 AS line_no, trim(string_split(text, chr(10))[i], ' ') AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@_query(
    "boilerplate_flags",
    f"""WITH {_LINES}
SELECT doc_id, line_no,
  len(p) >= 3 AND len(list_filter(p, lambda x: length(x) > 30)) = 0 AND gate AS nav_breadcrumb,
  gate AND ({_rx(*boilerplate.COOKIE)}) AS cookie_consent,
  gate AND ({_rx(*boilerplate.SHARE)}) AS social_share,
  gate AND ({_rx(*boilerplate.BYLINE)}) AS dateline_byline,
  gate AND ({_rx(boilerplate.RESERVED)} OR ({_rx(boilerplate.COPYRIGHT)} AND {_rx(boilerplate.YEAR)})) AS copyright_footer,
  gate AND ({_rx(*boilerplate.READ_MORE)}) AS read_more_pagination
FROM (SELECT *, length(line) BETWEEN 1 AND 120 AS gate,
  list_filter(list_transform(regexp_split_to_array(line, '[›»>]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM l)""",
)
def boilerplate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.flag_lines(lines(spark, sf_dir)).drop("line", "is_chrome")


_KEY = "lower(regexp_replace(regexp_replace(line, '^[\\s•·※＊*#▪◦●○►▶▲»›>+|=\\-–—]+', ''), '[\\s:：;；.。，,、…·•|<>›»←→+=\\-–—]+$', ''))"


@_query(
    "chrome_mining",
    f"""WITH {_LINES} SELECT chrome_key, count(DISTINCT doc_id) AS documents, count(*) AS occurrences
FROM (SELECT doc_id, {_KEY} AS chrome_key FROM l WHERE length(line) BETWEEN 1 AND 120) WHERE chrome_key <> ''
GROUP BY chrome_key HAVING count(DISTINCT doc_id) >= 5""",
)
def chrome_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.mine_chrome(lines(spark, sf_dir), 5)


def _spine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paras = segment.paragraphs(documents(spark, sf_dir), mode="line", strip=None)
    return paras, segment.sentences(paras)


_PARAS = """paras AS (SELECT doc_id, lang, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents)"""
_SPINE = f"""{_PARAS},
px AS (SELECT doc_id, lang, i - 1 AS paragraph_index, ps[i] AS para,
  coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x) + 1)), 0) AS base
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM paras)),
sx AS (SELECT doc_id, lang, paragraph_index, base, j, segs[j] AS seg,
  coalesce(list_sum(list_transform(segs[1:j-1], lambda x: length(x))), 0) AS off
  FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS j
    FROM (SELECT *, regexp_extract_all(para, '[^.!?]*[.!?]+|[^.!?]+$') AS segs FROM px))),
sp AS (SELECT doc_id, lang, paragraph_index, trim(seg) AS sentence,
  CAST(base + off + length(seg) - length(ltrim(seg)) AS INTEGER) AS start FROM sx WHERE trim(seg) <> ''),
spine AS (SELECT *, CAST(start + length(sentence) AS INTEGER) AS "end",
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS sentence_index,
  CAST(len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')) AS INTEGER) AS token_count FROM sp)"""


@_query(
    "paragraphs",
    f"""WITH {_PARAS} SELECT doc_id, CAST(len(ps) AS INTEGER) AS n_paragraphs, CAST(length(array_to_string(ps, ' ')) AS INTEGER) AS n_chars,
  md5(array_to_string(ps, ' ')) AS text_md5 FROM paras""",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _spine(spark, sf_dir)[0]
    return p.select(
        "doc_id", F.size("paragraphs").alias("n_paragraphs"), F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@_query(
    "sentence_spans",
    f"""WITH {_SPINE} SELECT doc_id || '#s' || sentence_index AS sentence_id, doc_id, sentence_index, lang, start, "end", paragraph_index, token_count,
  md5(sentence) AS sentence_md5 FROM spine""",
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spine(spark, sf_dir)[1]
    return s.withColumn("sentence_md5", F.md5(F.col("sentence").cast("binary"))).drop("sentence")


@_query(
    "span_violations",
    f"""WITH {_SPINE}
SELECT doc_id, sentence_index, CASE doc_id % 4 WHEN 0 THEN 'index not dense' WHEN 1 THEN 'text is not the slice' WHEN 2 THEN 'spans overlap' ELSE 'no document' END AS violation
FROM spine WHERE CASE doc_id % 4 WHEN 0 THEN sentence_index > 2 WHEN 3 THEN true ELSE sentence_index = 1 END""",
)
def span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans damaged by the remainder of their document: one lost, one text changed, one moved, or no text to cut."""
    paras, spine = _spine(spark, sf_dir)
    kind, second = F.col("doc_id") % 4, F.col("sentence_index") == 1
    bad = spine.filter(~((kind == 0) & (F.col("sentence_index") == 2)))
    bad = bad.withColumn("sentence", F.when((kind == 1) & second, F.concat("sentence", F.lit("x"))).otherwise(F.col("sentence")))
    bad = bad.withColumn("start", F.when((kind == 2) & second, F.lit(0)).otherwise(F.col("start")))
    return segment.span_violations(bad, paras.filter(kind != 3))


def _fake_translation(joined):
    """Stand-in for translation: vowels change case; every third unit (by length) loses its marker."""
    drop = F.length(joined) % 3 == 0
    return F.translate(F.when(drop, F.replace(joined, F.lit(T.MARKER), F.lit("-"))).otherwise(joined), "aeiou", "AEIOU")


_UNITS = f"""{_SPINE},
units AS (SELECT doc_id, lang, head, CAST(count(*) AS INTEGER) AS n, CAST(sum(token_count) AS INTEGER) AS token_count,
  string_agg(sentence, ' § ' ORDER BY sentence_index) AS joined
  FROM (SELECT *, CASE WHEN lang = 'en' THEN sentence_index ELSE sentence_index // 2 * 2 END AS head FROM spine)
  GROUP BY doc_id, lang, head),
raw AS (SELECT doc_id, lang, head, n, token_count, CASE WHEN lang = 'en' THEN joined
  ELSE translate(CASE WHEN length(joined) % 3 = 0 THEN replace(joined, '§', '-') ELSE joined END, 'aeiou', 'AEIOU') END AS text_raw FROM units),
cut AS (SELECT *, list_transform(string_split(text_raw, '§'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS parts FROM raw),
told AS (SELECT *, n > 1 AND NOT (len(parts) = n AND len(list_filter(parts, lambda x: x = '')) = 0) AS fused FROM cut),
member AS (SELECT t.doc_id, t.lang, t.head, t.n, t.fused, t.text_raw, t.parts, t.token_count AS unit_tokens,
  s.sentence_index, s.start, s."end", s.paragraph_index, s.token_count
  FROM told t JOIN spine s ON s.doc_id = t.doc_id AND s.sentence_index >= t.head AND s.sentence_index < t.head + t.n),
slots AS (SELECT *, CASE WHEN fused THEN head ELSE sentence_index END AS slot,
  CASE WHEN n = 1 AND lang = 'en' THEN text_raw
    WHEN n = 1 OR fused THEN trim(regexp_replace(replace(text_raw, '§', ' '), '\\s+', ' ', 'g'))
    ELSE parts[sentence_index - head + 1] END AS text FROM member),
final AS (SELECT doc_id, lang, slot, min(start) AS start, max("end") AS "end", arg_min(paragraph_index, sentence_index) AS paragraph_index,
  CASE WHEN bool_or(fused) THEN max(unit_tokens) ELSE max(token_count) END AS token_count, min(text) AS text, bool_or(fused) AS fused,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot) - 1 AS INTEGER) AS final_index
  FROM slots GROUP BY doc_id, lang, slot)"""


def _reconciled(spark: SparkSession, sf_dir: str):
    spine = _spine(spark, sf_dir)[1]
    raw = translation.translate_units(translation.units_of(spine), _fake_translation)
    return raw, spine, *translation.reconcile(raw, spine)


@_query(
    "translation_units",
    f"""WITH {_UNITS} SELECT doc_id, lang, head, n, token_count, md5(text_raw) AS raw_md5 FROM raw""",
)
def translation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _reconciled(spark, sf_dir)[0]
    return raw.withColumn("raw_md5", F.md5(F.col("text_raw").cast("binary"))).drop("text_raw", "members")


@_query(
    "merge_map",
    f"""WITH {_UNITS} SELECT doc_id, sentence_index, CAST(head AS INTEGER) AS head FROM member WHERE lang <> 'en'""",
)
def merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.merge_map(_reconciled(spark, sf_dir)[0])


@_query(
    "unit_heads",
    f"""WITH {_UNITS} SELECT DISTINCT doc_id, CAST(head AS INTEGER) AS sentence_index FROM member WHERE lang <> 'en'""",
)
def unit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.unit_heads(merge_map(spark, sf_dir)).select("doc_id", "sentence_index")


@_query(
    "merge_map_violations",
    f"""WITH {_UNITS}, m AS (SELECT * FROM member WHERE lang <> 'en')
SELECT doc_id, CAST(0 AS INTEGER) AS sentence_index, 'no unit' AS violation FROM m WHERE doc_id % 4 = 0 AND sentence_index = 0
UNION ALL SELECT doc_id, CAST(0 AS INTEGER), 'not a run from its head' FROM m WHERE doc_id % 4 = 0 AND sentence_index = 1
UNION ALL SELECT doc_id, CAST(0 AS INTEGER), 'in two units' FROM m WHERE doc_id % 4 = 1 AND sentence_index = 0
UNION ALL SELECT doc_id, CAST(-1 AS INTEGER), 'not of the spine' FROM m WHERE doc_id % 4 = 2 AND sentence_index = 0""",
)
def merge_map_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps damaged by the remainder of their document: the first row lost, told twice, or one row of no sentence."""
    m, kind = merge_map(spark, sf_dir), F.col("doc_id") % 4
    first = m.filter("sentence_index = 0")
    stray = first.filter(kind == 2).select("doc_id", F.lit(-1).alias("sentence_index"), F.lit(-1).alias("head"))
    bad = m.filter(~((kind == 0) & (F.col("sentence_index") == 0))).unionByName(first.filter(kind == 1)).unionByName(stray)
    return translation.merge_map_violations(bad, _spine(spark, sf_dir)[1])


@_query(
    "split_back",
    f"""WITH {_UNITS} SELECT doc_id, head, n, fused, CASE WHEN n > 1 AND NOT fused THEN md5(array_to_string(parts, '|')) END AS parts_md5 FROM told""",
)
def split_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _reconciled(spark, sf_dir)[0]
    parts = F.when(F.col("n") > 1, T.split_translation(F.col("text_raw"), F.col("n")))
    return raw.select(
        "doc_id", "head", "n", ((F.col("n") > 1) & parts.isNull()).alias("fused"), F.md5(F.array_join(parts, "|").cast("binary")).alias("parts_md5")
    )


@_query(
    "reconcile_final",
    f"""WITH {_UNITS} SELECT doc_id, lang, start, "end", paragraph_index, token_count, md5(text) AS text_md5, fused, final_index FROM final""",
)
def reconcile_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = _reconciled(spark, sf_dir)[2]
    return final.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@_query(
    "reconcile_remap",
    f"""WITH {_UNITS} SELECT s.doc_id, s.doc_id || '#s' || s.sentence_index AS sentence_id, s.doc_id || '#s' || f.final_index AS final_sentence_id, s.fused
FROM slots s JOIN final f USING (doc_id, slot)""",
)
def reconcile_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)[3]


@_query(
    "reconcile_violations",
    f"""WITH {_UNITS} SELECT doc_id, 'units do not tile' AS violation, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT doc_id FROM spine) WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'marker in text', count(*) FROM final WHERE doc_id % 3 = 1 AND lang <> 'en' GROUP BY doc_id""",
)
def reconcile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage by the remainder of the document: its first unit lost, or a marker left in every text."""
    raw, spine, final, _ = _reconciled(spark, sf_dir)
    kind = F.col("doc_id") % 3
    raw = raw.filter(~((kind == 0) & (F.col("head") == 0)))
    final = final.withColumn("text", F.when(kind == 1, F.concat("text", F.lit(T.MARKER))).otherwise(F.col("text")))
    return translation.reconcile_violations(final, raw, spine).groupBy("doc_id", "violation").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "len_max",
    f"""WITH {_UNITS} SELECT doc_id, final_index, "end" - start AS len_original, CAST(length(text) AS INTEGER) AS len_translated,
  CAST(greatest("end" - start, length(text)) AS INTEGER) AS len_max FROM final""",
)
def len_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = _spine(spark, sf_dir)[0]
    final = _reconciled(spark, sf_dir)[2].withColumnRenamed("text", "translated")
    j = final.join(paras.select("doc_id", F.col("text").alias("whole")), "doc_id")
    j = j.withColumn("original", F.substr("whole", F.col("start") + 1, F.col("end") - F.col("start")))
    out = translation.length_maxima(j, {"original": "original", "translated": "translated"})
    return out.select("doc_id", "final_index", "len_original", "len_translated", "len_max")


@_query(
    "typed_absence",
    f"""WITH {_UNITS} SELECT lang, count(*) AS missing FROM final WHERE lang <> 'en' AND fused GROUP BY lang""",
)
def typed_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that would lack a translation if fused ones had none."""
    final = _reconciled(spark, sf_dir)[2]
    holes = final.withColumn("text", F.when(~F.col("fused"), F.col("text")))
    return translation.typed_absence(holes, "text").groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))


_PASSAGES = """pas AS (SELECT doc_id, lang, CAST(final_index // 3 AS INTEGER) AS k, min(final_index) AS first, max(final_index) AS last FROM final GROUP BY ALL)"""


def _threes(final: DataFrame) -> DataFrame:
    """Passages of three sentences each, so that SQL can follow."""
    k = F.floor(F.col("final_index") / 3).cast("int")
    p = final.groupBy("doc_id", k.alias("k")).agg(F.min("final_index").alias("first"), F.max("final_index").alias("last"))
    return p.select(T.mint(F.col("doc_id"), "p", F.col("k")).alias("passage_id"), "doc_id", "first", "last")


@_query(
    "render_passages",
    f"""WITH {_UNITS}, {_PASSAGES},
doc AS (SELECT doc_id, array_to_string(ps, ' ') AS whole FROM paras)
SELECT p.doc_id || '#p' || p.k AS passage_id, p.doc_id, p.lang, md5(substring(any_value(d.whole), min(f.start) + 1, max(f."end") - min(f.start))) AS original_md5,
  md5(string_agg(f.text, ' ' ORDER BY f.final_index)) AS rendered_md5, count(*) AS members
FROM pas p JOIN final f ON f.doc_id = p.doc_id AND f.final_index BETWEEN p.first AND p.last JOIN doc d ON d.doc_id = p.doc_id
GROUP BY p.doc_id, p.k, p.lang""",
)
def render_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final sentences are written once: passages and renderings both read them."""
    paras = _spine(spark, sf_dir)[0]
    final = cut(_reconciled(spark, sf_dir)[2])
    own = final.select("doc_id", F.col("final_index").alias("sentence_index"), "lang", "start", "end", F.col("text").alias("translation"))
    out = translation.render_passages(_threes(final), own, paras)
    return out.select(
        "passage_id", "doc_id", "lang", F.md5(F.col("original").cast("binary")).alias("original_md5"),
        F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"), F.size("spans").cast("long").alias("members"),
    )


@_query(
    "released_native",
    f"""WITH {_SPINE},
m AS (SELECT doc_id, sentence_index // 3 AS k, sentence_index, sentence, start, lag("end") OVER (PARTITION BY doc_id, sentence_index // 3 ORDER BY sentence_index) AS before FROM spine)
SELECT doc_id || '#p' || k AS passage_id, md5(string_agg(CASE WHEN start > before THEN ' ' ELSE '' END || sentence, '' ORDER BY sentence_index)) AS text_md5
FROM m GROUP BY doc_id, k""",
)
def released_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spine(spark, sf_dir)[1]
    k = F.floor(F.col("sentence_index") / 3).cast("int")
    m = s.select(T.mint(F.col("doc_id"), "p", k).alias("passage_id"), F.col("sentence_index").alias("pos"), "start", "end", F.col("sentence").alias("text"))
    return translation.released_native(m).select("passage_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query("units_merged")
def units_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras, spine = _spine(spark, sf_dir)
    return folds.merge_units(spine, paras, min_tokens=16, cap=76.8)


_PACKED = f"""{_SPINE},
doc_ AS (SELECT doc_id, any_value(lang) AS lang, list(token_count ORDER BY sentence_index) AS counts, list(paragraph_index ORDER BY sentence_index) AS paras, count(*) AS n FROM spine GROUP BY doc_id),
ready AS (SELECT *, list_prepend(0, list_transform(range(1, n + 1), lambda k: CAST(list_sum(counts[1:k]) AS BIGINT))) AS total,
  list_filter(range(0, n), lambda k: counts[k + 1] > 128) AS large, list_filter(range(1, n), lambda k: paras[k + 1] <> paras[k]) AS turns FROM doc_),
walk AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS lo, 0::BIGINT AS fresh, NULL::BIGINT AS first, NULL::BIGINT AS last FROM ready UNION ALL
  SELECT doc_id, k + 1, CASE WHEN big THEN fresh + 1
      WHEN stop < n AND counts[stop] <= 128 - counts[stop + 1]
        THEN greatest(lo, least(stop - 1, len(list_filter(total, lambda x: x < total[stop + 1] - least(19.2, 128 - counts[stop + 1])))))
      ELSE stop END,
    CASE WHEN big THEN fresh + 1 ELSE stop END, CASE WHEN big THEN fresh ELSE lo END, CASE WHEN big THEN fresh ELSE stop - 1 END
  FROM (SELECT *, counts[fresh + 1] > 128 AS big,
      least(len(list_filter(total, lambda x: x <= total[lo + 1] + 128)) - 1,
        coalesce(list_filter(large, lambda x: x >= fresh)[1], n),
        coalesce(list_filter(turns, lambda x: x >= greatest(fresh + 1, len(list_filter(total, lambda y: y < total[lo + 1] + 76.8))))[1], n)) AS stop
    FROM walk JOIN ready USING (doc_id) WHERE fresh < n)),
packed AS (SELECT doc_id || '#p' || (k - 1) AS passage_id, doc_id, lang, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last,
  CAST(total[last + 2] - total[first + 1] AS INTEGER) AS token_count, first = last AND counts[first + 1] > 128 AS is_oversized
  FROM walk JOIN ready USING (doc_id) WHERE k > 0)"""


@_query("passages_packed", f"WITH RECURSIVE {_PACKED} SELECT * FROM packed")
def passages_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.pack_passages(_spine(spark, sf_dir)[1], budget=128, overlap=0.15, min_fill=0.6)


@_query(
    "passage_violations",
    f"""WITH RECURSIVE {_PACKED},
kept AS (SELECT * FROM packed WHERE NOT (doc_id % 3 = 1 AND passage_id LIKE '%#p0')),
covered AS (SELECT doc_id, unnest(range(first, last + 1)) AS sentence_index FROM kept)
SELECT passage_id AS id, 'token sum' AS violation FROM kept WHERE doc_id % 3 = 0
UNION ALL SELECT passage_id, 'orphan member' FROM kept k WHERE doc_id % 3 = 2 AND last + 1 = (SELECT count(*) FROM spine s WHERE s.doc_id = k.doc_id)
UNION ALL SELECT s.doc_id || '#s' || s.sentence_index, 'not in a passage' FROM spine s ANTI JOIN covered c ON c.doc_id = s.doc_id AND c.sentence_index = s.sentence_index""",
)
def passage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages damaged by the remainder of their document: a wrong count, the first one lost, one sentence too many."""
    spine = _spine(spark, sf_dir)[1]
    kind = F.col("doc_id") % 3
    p = folds.pack_passages(spine, budget=128, overlap=0.15, min_fill=0.6).filter(~((kind == 1) & F.col("passage_id").endswith("#p0")))
    end = spine.groupBy("doc_id").agg((F.count(F.lit(1)) - 1).alias("_end"))
    p = p.join(end, "doc_id").withColumn("token_count", F.when(kind == 0, F.col("token_count") + 1).otherwise(F.col("token_count")))
    p = p.withColumn("last", F.when((kind == 2) & (F.col("last") == F.col("_end")), F.col("last") + 1).otherwise(F.col("last")))
    return folds.passage_violations(p, spine, 128)


@_query(
    "length_buckets",
    f"""WITH RECURSIVE {_SPINE},
o AS (SELECT doc_id, sentence_index AS id, token_count AS n, row_number() OVER (PARTITION BY doc_id ORDER BY token_count, sentence_index) AS i FROM spine),
f AS (SELECT doc_id, id, n, i, 0 AS batch, n AS used, 1 AS members FROM o WHERE i = 1 UNION ALL
  SELECT o.doc_id, o.id, o.n, o.i, batch + (full_::INT), CASE WHEN full_ THEN o.n ELSE used + o.n END, CASE WHEN full_ THEN 1 ELSE members + 1 END
  FROM (SELECT f.doc_id, f.i AS at, batch, used, members, used + p.n > 64 OR members = 8 AS full_ FROM f JOIN o p ON p.doc_id = f.doc_id AND p.i = f.i + 1) f
  JOIN o ON o.doc_id = f.doc_id AND o.i = f.at + 1)
SELECT doc_id, id, n, batch FROM f""",
)
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spine(spark, sf_dir)[1]
    items = s.select("doc_id", F.col("sentence_index").alias("id"), F.col("token_count").alias("n"))
    return folds.length_batches(items, "doc_id", "n", budget=64, most=8)


@_query(
    "text_kernel",
    """SELECT doc_id, string_split(doc_id || '#s3', '#')[1] AS owner, CAST(regexp_extract(doc_id || '#p17', '#[a-z](\\d+)$', 1) AS INTEGER) AS ordinal,
  CASE WHEN instr(text, '?') > 0 THEN md5(trim(substring(text, 1, instr(text, '?')))) ELSE md5('') END AS question_md5,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words,
  md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key_md5 FROM documents""",
)
def text_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    md5 = lambda c: F.md5(c.cast("binary"))
    return d.select(
        "doc_id",
        T.doc_id_of(T.mint(F.col("doc_id"), "s", F.lit(3))).alias("owner"),
        T.ordinal_of(T.mint(F.col("doc_id"), "p", F.lit(17))).alias("ordinal"),
        md5(T.question_of(F.col("text"))).alias("question_md5"),
        T.word_count(F.col("text")).alias("words"),
        md5(T.cluster_key(F.col("text"))).alias("key_md5"),
    )


@_query(
    "normal_forms",
    "SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5, nfc_normalize(text) = text AS is_nfc FROM documents",
)
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("n", T.nfc("text"))
    return d.select("doc_id", F.md5(F.col("n").cast("binary")).alias("nfc_md5"), (F.col("n") == F.col("text")).alias("is_nfc"))


@_query(
    "part_ordinals",
    """SELECT lang, doc_id, CAST(o AS INTEGER) AS ordinal, CAST(o // 64 AS INTEGER) AS part, CAST(o % 64 AS INTEGER) AS place
FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS o FROM documents)""",
)
def part_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("lang", "doc_id", F.length("text").alias("n"))
    return ordered.parts(d, ["lang"], ["n", "doc_id"], 64).drop("n")


@_query(
    "shard_cuts",
    """WITH RECURSIVE o AS (SELECT lang, doc_id, CAST(strlen(text) AS INTEGER) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
f AS (SELECT lang, doc_id, size, i, 0 AS shard, size AS used FROM o WHERE i = 1 UNION ALL
  SELECT o.lang, o.doc_id, o.size, o.i, CASE WHEN used > 0 AND used + o.size > 200000 THEN shard + 1 ELSE shard END,
    CASE WHEN used > 0 AND used + o.size > 200000 THEN o.size ELSE used + o.size END
  FROM f JOIN o ON o.lang = f.lang AND o.i = f.i + 1)
SELECT lang, doc_id, size, shard FROM f""",
)
def shard_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language cut into shards of at most 200,000 bytes, in order of doc_id."""
    d = documents(spark, sf_dir).select("lang", "doc_id", F.octet_length("text").alias("size"))

    def fold(g):
        return g | {"shard": folds.cut_shards(g["size"], 200_000)}

    return fold_groups(d, ["lang"], ["doc_id"], fold, "lang string, doc_id long, size int, shard int")


@_query(
    "language_counts",
    "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
)
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@_query(
    "page_titles",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_p,
  CAST(len(list_filter(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), '[›»>|]'), lambda x: trim(x) <> '')) AS INTEGER) AS crumbs FROM pages""",
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, sf_dir, "pages").select(
        "page_id", title.alias("title"), F.regexp_count("html", F.lit("<p>")).alias("n_p"),
        F.size(F.filter(F.split(title, "[›»>|]", -1), lambda x: F.trim(x) != "")).alias("crumbs"),
    )


@_query(
    "paragraph_edges",
    f"""WITH {_SPINE} SELECT doc_id, sentence_index, paragraph_index IS DISTINCT FROM lag(paragraph_index) OVER w AS opens, paragraph_index IS DISTINCT FROM lead(paragraph_index) OVER w AS closes
FROM spine WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_index)""",
)
def paragraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = acceptance.paragraph_edges(_spine(spark, sf_dir)[1])
    return e.select("doc_id", "sentence_index", "opens", "closes")


@_query(
    "truncated_tokens",
    """WITH t AS (SELECT doc_id, list_concat(list_concat(['<x>'], list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')), ['</s>']) AS t FROM documents)
SELECT doc_id, CAST(least(len(t), 64) AS INTEGER) AS n, md5(array_to_string(CASE WHEN len(t) <= 64 THEN t ELSE list_concat(t[1:63], t[len(t):len(t)]) END, ' ')) AS tokens_md5 FROM t""",
)
def truncated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    tokens = acceptance.truncated(F.concat(F.array(F.lit("<x>")), words, F.array(F.lit("</s>"))), 64)
    return documents(spark, sf_dir).select("doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens_md5"))
