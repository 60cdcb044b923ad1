"""Folds over many small groups without a call, a frame and a batch for each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: Rows gathered before a batch is handed back.
OUT_ROWS = 10_000


def fold_groups(
    df: DataFrame, by: list[str], order: list[str], fold: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """``fold`` of each group's columns, sorted by ``order``, as rows of ``schema``.

    One shuffle on ``by``; each task streams its sorted rows and holds one group
    at a time. Null whole numbers reach ``fold`` as None.
    """
    cols = df.columns
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]

    whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}

    def values(column: pd.Series) -> list:
        # Whole numbers with nulls come as floats.
        if column.name in whole and column.hasnans:
            return [None if pd.isna(x) else int(x) for x in column.tolist()]
        return column.tolist()

    def run(batches):
        key, held = None, {c: [] for c in cols}
        out: dict[str, list] = {n: [] for n in names}

        def close() -> None:
            if key is not None:
                for n, column in fold(held).items():
                    out[n].extend(column)

        for pdf in batches:
            columns = {c: values(pdf[c]) for c in cols}
            keys = list(zip(*(columns[k] for k in by), strict=True))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != key:
                    close()
                    key, held = keys[start], {c: [] for c in cols}
                for c in cols:
                    held[c].extend(columns[c][start:end])
                start = end
            if len(out[names[0]]) >= OUT_ROWS:
                yield pd.DataFrame(out)
                out = {n: [] for n in names}
        close()
        if out[names[0]]:
            yield pd.DataFrame(out)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
