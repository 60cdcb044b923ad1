"""Readers: corpora, topics, runs, reports, release files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DOCUMENT = "id string, text string, url string, date string"
TOPIC = "topic_id string, collection_id string, title string, problem_statement string, background string, limit int"


def language_of(path: Column, names: dict[str, str]) -> Column:
    """The language whose file-name part is in ``path``; an error for any other file."""
    out = F.raise_error(F.concat(F.lit("no language for file "), path))
    for part, lang in names.items():
        out = F.when(F.substring_index(path, "/", -1).contains(part), F.lit(lang)).otherwise(out)
    return out


def read_corpus(spark: SparkSession, paths: str | list[str], names: dict[str, str]) -> DataFrame:
    """Gzip JSON lines of documents, language from the file name."""
    raw = spark.read.schema(RAW_DOCUMENT).json(paths)
    return raw.withColumn("lang", language_of(F.input_file_name(), names))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def split_objects(text: str) -> list[str]:
    """The JSON objects of a text that holds them one after the other, with or without separators."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while True:
        at = re.compile(r"\s*").match(text, at).end()
        if at >= len(text):
            return out
        value, end = decoder.raw_decode(text, at)
        if not isinstance(value, dict):
            raise ValueError(f"not an object at character {at}")
        out.append(text[at:end])
        at = end


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics as JSON lines or as concatenated objects; a topic without a title is an error."""
    split = F.udf(split_objects, T.ArrayType(T.StringType()))
    raw = spark.read.text(path, wholetext=True).select(F.explode(split("value")).alias("o"))
    t = raw.select(F.from_json("o", TOPIC).alias("t")).select("t.*")
    checked = F.when(F.coalesce(F.trim("title"), F.lit("")) != "", F.col("title")).otherwise(
        F.raise_error(F.concat(F.lit("topic without title: "), F.coalesce("topic_id", F.lit("?"))))
    )
    return t.withColumn("title", checked)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, doc_id, rank, score, tag) of a six-column run; another number of columns is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("p", parts)
    ok = F.when(F.size("p") == 6, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a run line: "), F.col("value"))))
    p = lines.withColumn("p", ok)
    return p.select(
        F.col("p")[0].alias("topic_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("rank"),
        F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("tag"),
    )


def single_tag_violations(run: DataFrame) -> DataFrame:
    """One row with the tags of a run that has more than one."""
    return run.agg(F.array_sort(F.collect_set("tag")).alias("tags")).filter(F.size("tags") > 1)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(topic_id, doc_id, position): distinct cited documents of reports, by first use."""
    schema = "topic_id string, responses array<struct<text:string,citations:map<string,double>>>"
    r = spark.read.schema(schema).json(path).select("topic_id", F.posexplode("responses").alias("position", "r"))
    c = r.select("topic_id", "position", F.explode(F.map_keys("r.citations")).alias("doc_id"))
    return c.groupBy("topic_id", "doc_id").agg(F.min("position").alias("position"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def footer_report(df: DataFrame, by: str, key: str) -> DataFrame:
    """(by, rows, first, last): counts and key range per group, from column statistics where they serve."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))


def key_range(df: DataFrame, key: str, lo, hi) -> DataFrame:
    """Rows with lo <= key < hi; on sorted files the scan skips row groups by their statistics."""
    return df.filter((F.col(key) >= lo) & (F.col(key) < hi))
