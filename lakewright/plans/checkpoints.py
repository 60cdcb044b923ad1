"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent, a session on one machine (``local[...]``)
    gets a temporary folder; any other is refused, for its executors would not
    share one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lakewright-ckpt-")
    sc.setCheckpointDir(named)


#: Bits of the size that Spark gives a table of which it knows nothing.
UNKNOWN_BITS = 63


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (an action).

    Spark keeps its estimate of the size, a join's being the product of both
    sides. In a loop the number's length doubles with every join, until the
    driver's memory and time go into multiplying it, so an estimate beyond what
    an unknown size counts as becomes unknown.

    The shuffle files it was made from go at once; else they stay until the
    driver happens to collect its garbage, the sum of all steps on disk.
    """
    ensure_checkpoint_dir(df.sparkSession)
    session, jvm = df.sparkSession._jsparkSession, df.sparkSession._jvm
    dataset, execution = jvm.org.apache.spark.sql.classic.Dataset, jvm.org.apache.spark.sql.execution
    removed = getattr(getattr(execution, "RemoveShuffleFiles$"), "MODULE$")
    own = dataset.ofRows(session, df._jdf.queryExecution().commandExecuted(), removed)
    out = type(df)(own.checkpoint(True), df.sparkSession)
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes().bit_length() <= UNKNOWN_BITS:
        return out
    nothing = jvm.scala.Option.empty()
    plan = execution.LogicalRDD(
        plan.output(),
        plan.rdd(),
        plan.outputPartitioning(),
        plan.outputOrdering(),
        plan.isStreaming(),
        plan.stream(),
        session,
        nothing,
        nothing,
    )
    return type(out)(dataset.ofRows(session, plan), df.sparkSession)
