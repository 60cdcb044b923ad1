"""Writers: Parquet and JSON tables, runs, reports, tables by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.text import fixed9
from lakewright.operators.evidence import trec_rows


def finite(df: DataFrame) -> DataFrame:
    """``df`` whose doubles and floats raise an error when they are not finite."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            c = F.col(name)
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            df = df.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(c))
    return df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = finite(df).write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines; with ``order`` globally sorted over files in name order."""
    out = finite(df)
    if order:
        out = out.orderBy(*order)
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_run(ranked: DataFrame, path: str, tag: str, mode: str = "errorifexists") -> None:
    """A six-column run of (topic_id, doc_id, rank, score), in order of topic and rank."""
    lines = trec_rows(ranked.orderBy("topic_id", "rank"), tag, fixed9("score"))
    lines.write.mode(mode).text(path)


def report_rows(responses: DataFrame) -> DataFrame:
    """(topic_id, json) of responses (topic_id, position, sentence, docs), references sorted and distinct."""
    citation = F.transform("docs", lambda d: d.cast("string"))
    r = responses.select("topic_id", "position", F.struct(F.col("sentence").alias("text"), citation.alias("citations")).alias("r"))
    g = r.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "r"))), lambda x: x["r"]).alias("responses")
    )
    refs: Column = F.array_sort(F.array_distinct(F.flatten(F.transform("responses", lambda x: x["citations"]))))
    return g.select("topic_id", F.to_json(F.struct("topic_id", "responses", refs.alias("references"))).alias("json"))


def save_by_id(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A bucketed, sorted table: joins on ``key`` with tables of as many buckets shuffle nothing."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def publish_sentences(sentences: DataFrame, docs: DataFrame) -> DataFrame:
    """Released sentences: spans renamed, text cut from the document."""
    j = sentences.drop("text").join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    cut = F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start"))
    return j.withColumn("text", cut).withColumnsRenamed({"start": "char_start", "end": "char_end"}).drop("_t")
