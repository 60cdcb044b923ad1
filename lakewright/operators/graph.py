"""Connected components by repeated contraction.

Each round every node points at its smallest neighbour, pointer doubling
turns the pointers into stars, and the edges are rewritten between star
centres. The edge set shrinks geometrically, so the first round carries the
cost. No edge list, label table or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.plans.checkpoints import cut


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer doubling over (node, parent) until each parent is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = cut(
            parents.join(up, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                (F.col("grand").isNotNull() & (F.col("grand") != F.col("parent"))).alias("moved"),
            )
        )
        moved = step.filter("moved").limit(1).count()
        parents = step.select("node", "parent")
        if not moved:
            return parents


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component = smallest node.

    Self-loops make their node appear as a component of its own. Null ends
    are ignored. Runs actions (one checkpoint per contraction step).
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("parent"))
        roots = _flatten(cut(first))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("component"))
        else:
            r = roots.select(F.col("node").alias("component"), "parent")
            labels = cut(
                labels.join(r, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            )
        ru = roots.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        rv = roots.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        e = cut(
            e.filter("u <> v")
            .join(ru, "u")
            .join(rv, "v")
            .filter("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct()
        )
        if e.limit(1).count() == 0:
            return labels
