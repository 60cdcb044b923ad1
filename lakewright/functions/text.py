"""Column helpers for identifiers, text and translation markers.

Offsets are code points everywhere. ``trim`` of Spark strips blanks only, so
Unicode white space is stripped by ``utrim``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

MARKER = "§"
#: Unicode's white space: what ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def doc_id_of(ref: Column) -> Column:
    """``doc#p3`` or ``doc#s3`` -> ``doc``."""
    return F.substring_index(ref, "#", 1)


def mint(owner: Column, kind: str, ordinal: Column) -> Column:
    """``owner#<kind><ordinal>``: p passages, s sentences, n nuggets."""
    return F.concat(owner.cast("string"), F.lit(f"#{kind}"), ordinal.cast("string"))


def ordinal_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"#[a-z](\d+)$", 1).cast("int")


def utrim(text: Column) -> Column:
    """Looks at the ends only, where a regular expression would try every blank."""
    return F.btrim(text, F.lit(WHITE))


def lead_of(text: Column) -> Column:
    """How many characters of white space the text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(WHITE)))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return utrim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(IntegerType())
def nfkc_len(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else len(unicodedata.normalize("NFKC", s))).astype("Int32")


@F.pandas_udf(StringType())
def fixed9(x: pd.Series) -> pd.Series:
    """``%.9f`` with exact halves to even, as C prints them."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.9f}")


def word_count(text: Column) -> Column:
    """Words between white space: the token count where no tokenizer is plugged in."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("int")


def cluster_key(text: Column) -> Column:
    """What makes two answers the same: case, white space and format characters don't count."""
    return F.lower(collapse(F.regexp_replace(text, r"\p{Cf}", "")))


def question_of(text: Column) -> Column:
    """The text up to its first question mark; empty without one."""
    at = F.instr(text, "?")
    return F.when(at > 0, utrim(F.substr(text, F.lit(1), at))).otherwise(F.lit(""))


def join_constituents(texts: Column) -> Column:
    return F.array_join(texts, f" {MARKER} ")


def scrub_markers(text: Column) -> Column:
    return collapse(F.replace(text, F.lit(MARKER), F.lit(" ")))


def split_translation(text: Column, n: Column) -> Column:
    """The n marked segments, scrubbed; null unless exactly n and none is empty."""
    parts = F.transform(F.split(text, MARKER, -1), scrub_markers)
    return F.when((F.size(parts) == n) & F.forall(parts, lambda x: x != ""), parts)


def query_strings(queries: Column) -> Column:
    """Trimmed, without empty ones, each once, in first order."""
    return F.array_distinct(F.filter(F.transform(queries, utrim), lambda q: q != ""))


def chinese_script(text: Column, simplified: str, traditional: str) -> Column:
    """``Hans`` or ``Hant`` by the marker characters counted; ties are Hans."""
    count = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    return F.when(count(traditional) > count(simplified), "Hant").otherwise("Hans")


def clamp_weight(w: Column) -> Column:
    finite = ~(F.isnan(w) | (F.abs(w) == float("inf")))
    return F.when(finite, F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
