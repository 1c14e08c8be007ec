"""Iteration: each round's table is written to the shared checkpoint folder, so lost executors cost one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SingularMatrix(ZeroDivisionError):
    """A system without a unique solution, or a factor without a pivot."""


class NotPositiveDefinite(ValueError):
    """A matrix that has no Cholesky factor."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ijvory-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def afresh(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written, in a folder for each value of ``by``, and read again, without the size that Spark estimates for it.

    A checkpoint keeps that estimate, and a table that is joined to itself round after round squares it each time.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it can be grouped together with a table that it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


#: Rows for which a large table has a partition of its own.
DEALT = 250_000


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` into so many partitions; as it is if the session shuffles into as many."""
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, dealt out by ``keys`` so that a task's share stays the same however many there are."""
    return spread(df, -(-rows // DEALT), *keys)
