"""Matrices that grow: streams of ``(i, j, v)`` increments, summed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate(deltas: DataFrame) -> DataFrame:
    """The sum of all increments so far, for output mode ``update`` or ``complete``."""
    return deltas.groupBy("i", "j").agg(F.sum("v").alias("v"))


def accumulate_windows(deltas: DataFrame, time_col: str, width: str, late: str) -> DataFrame:
    """A matrix for each window of time, closed ``late`` after its end."""
    return deltas.withWatermark(time_col, late).groupBy(F.window(time_col, width), "i", "j").agg(F.sum("v").alias("v"))


def fold(deltas: DataFrame, folder: str) -> DataFrame:
    """The sum of all that a stream holds now; ``folder`` is shared and keeps one table of sums per batch.

    A batch that is run again after a failure replaces its table, so nothing counts twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        accumulate(batch).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    writer = deltas.writeStream.foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress")
    writer.start().awaitTermination()
    spark = deltas.sparkSession
    return accumulate(spark.read.schema("i long, j long, v double").parquet(f"{folder}/sums/batch=*"))
