"""Deterministic stand-ins for text encoders, run on Arrow batches as a model would be."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of a vector.
DIM = 16


#: What parts words, of which none is empty.
WORD = re.compile(r"[^ \t\n\r\f\x0B]+")


def split(text: str) -> list[str]:
    return WORD.findall(text)


@lru_cache(maxsize=100_000)
def _digest(word: str) -> bytes:
    return md5(word.encode()).digest()[: DIM // 2]


def word_vectors(words) -> np.ndarray:
    """A row per word: the leading hex digits of its MD5 digest, centred."""
    pairs = np.frombuffer(b"".join(map(_digest, words)), np.uint8).reshape(-1, DIM // 2)
    return np.stack([pairs >> 4, pairs & 15], axis=2).reshape(-1, DIM) - 7.5


def dense(words) -> np.ndarray | None:
    """Unit vector of the summed word vectors; None without a word."""
    if words is None or not len(words):
        return None
    v = word_vectors(words).sum(axis=0)
    return v / (np.sqrt(v @ v) or 1.0)


def tokens(words) -> np.ndarray:
    """Unit vectors of the words, end to end; empty where there is none."""
    m = word_vectors(() if words is None else words)
    return (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).ravel()


def dense_of_text(text: str) -> np.ndarray | None:
    return dense(split(text))


def tokens_of_text(text: str) -> np.ndarray:
    """Of each distinct word."""
    return tokens(dict.fromkeys(split(text)))


def dense_vector(words: Column) -> Column:
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(dense)

    return F.pandas_udf(encode, "array<double>")(words)


def token_vectors(words: Column) -> Column:
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(tokens)

    return F.pandas_udf(encode, "array<double>")(words)
