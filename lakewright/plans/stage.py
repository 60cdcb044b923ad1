"""Extension points: stages with their own checks, and pluggable models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions.text import word_count


class Stage(Protocol):
    """A step from tables to a table, and the rows that break its promises."""

    name: str

    def build(self, tables: dict[str, DataFrame]) -> DataFrame: ...

    def violations(self, tables: dict[str, DataFrame], out: DataFrame) -> DataFrame: ...


class ViolationsFound(Exception):
    """A stage's output broke one of its promises."""


def run_stages(stages: list[Stage], tables: dict[str, DataFrame], save: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Builds, saves and checks stages in order; stops at the first with violations."""
    tables = dict(tables)
    for stage in stages:
        tables[stage.name] = save(stage.name, stage.build(tables))
        bad = stage.violations(tables, tables[stage.name]).limit(3).collect()
        if bad:
            raise ViolationsFound(f"{stage.name}: {bad}")
    return tables


@dataclass(frozen=True)
class Models:
    """Columns for what models would do. The defaults are deterministic stand-ins."""

    count_tokens: Callable[[Column], Column] = word_count
    translate: Callable[[Column], Column] = field(default=lambda c: F.translate(c, "aeiou", "AEIOU"))
    judge: Callable[[Column, Column], Column] = field(
        default=lambda question, text: F.size(F.array_intersect(F.split(F.lower(question), " "), F.split(F.lower(text), " "))) >= 2
    )


def expand_seeds(cells: DataFrame, seeds: int) -> DataFrame:
    """``cells`` once per seed, seed from 0."""
    return cells.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))


def nodes_done(cells: DataFrame) -> DataFrame:
    """(node, done): a node is done when all its cells (node, done) are."""
    return cells.groupBy("node").agg(F.bool_and("done").alias("done"))
