"""Small scans over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly where its scan has fewer partitions than there are cores.

    Meant for a table as read: a file of one row group is one task, however
    much is computed per row. At a size where the scan already has a task per
    core, nothing is added. Looks at the plan only; runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of the tables that a partition of ``parts_of`` stands for.
PART_BYTES = 8 << 20


def parts_of(*tables: DataFrame) -> int:
    """How many partitions keep a task's share the same at any size of the tables, as read; runs nothing."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
