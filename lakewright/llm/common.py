"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.spread import spread

#: A word, wherever an operator counts words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of labelled documents whose crc32 remainder is this are never learned from.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: Column) -> Column:
    """True for the rows kept for measuring; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == HELD_OUT


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_long(text: Column) -> Column:
    """The first 15 hex digits of an md5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def spare(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of it."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name
