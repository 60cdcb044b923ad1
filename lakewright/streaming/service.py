"""Streams: requests answered from a folder, liveness, first writers, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "request_id string, rendering string, queries array<string>, top_k int"


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """JSON requests as their files arrive; each file is taken once."""
    return spark.readStream.schema(REQUEST).json(folder)


def answer_requests(
    requests: DataFrame, answer: Callable[[DataFrame], DataFrame], replies: str, checkpoint: str, *, rendering: str
) -> StreamingQuery:
    """Answers each batch by ``answer`` and appends replies keyed by request_id.

    Requests for another rendering are answered with an error row. A batch
    that is run again after a failure overwrites its own folder, so replies
    appear once.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.dropDuplicates(["request_id"])
        right = df.filter(F.col("rendering") == rendering)
        wrong = df.filter(~F.coalesce(F.col("rendering") == rendering, F.lit(False)))
        good = answer(right).withColumn("error", F.lit(None).cast("string"))
        bad = wrong.select("request_id", F.concat(F.lit("rendering is not "), F.lit(rendering)).alias("error"))
        good.unionByName(bad, allowMissingColumns=True).write.mode("overwrite").parquet(f"{replies}/batch={number}")

    return (
        requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def first_writers(rows: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row per key within the watermark; later ones are dropped."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def event_windows(events: DataFrame, *, width: str, slide: str | None, late: str) -> DataFrame:
    """An extension: counts and sums per event-time window and type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total"
    )


def beats(events: DataFrame, owner: str) -> DataFrame:
    """(owner, last_beat) kept up to date; use with outputMode('update')."""
    return events.groupBy(F.col(owner).alias("owner")).agg(F.max("ts").alias("last_beat"))
