"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of a side that may be broadcast; beyond either Spark shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    A temporary one is set only where that is unset and the master is local.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ijvory-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows for which a settled table has a partition of its own.
PART_ROWS = 50_000


def parts_for(rows: int) -> int:
    """Partitions for so many rows: a table of few rows in hundreds of partitions makes as many files in each exchange."""
    return max(1, -(-rows // PART_ROWS))


def held(df: DataFrame, hint: bool = False) -> tuple[DataFrame, int]:
    """``cut``, read in as many partitions as its rows call for, and the number of rows; with ``hint``, like ``small``.

    Rows and bytes are counted while they are written: each job of its own, and each stage of it, costs the driver blocks of memory.
    """
    seen, counts = Observation(), [F.count(F.lit(1)).alias("n"), F.sum(_width(df) if hint else F.lit(0)).alias("size")]
    done = cut(df.observe(seen, *counts))
    # nothing is observed of a plan that is found to be empty before it runs
    found = seen.get or done.agg(*counts).first().asDict()
    few = done.coalesce(parts_for(found["n"]))
    fits = hint and found["n"] <= BROADCAST_ROWS and (found["size"] or 0) <= BROADCAST_BYTES
    return F.broadcast(few) if fits else few, found["n"]


def _width(df: DataFrame) -> Column:
    """The bytes of a row, about."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.col(f"`{name}`"))), F.lit(0))
        else:
            width = width + 16
    return width


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and their bytes, both counted, are within the bounds, else as it is."""
    n, width = df.agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and width <= size else df


def ascii_lower(text):
    """``text`` with A-Z in lower case and all else as it was; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), LOWER.upper(), LOWER)


def content(text):
    """A digest of ``text`` that tells rows of one id apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def let(value, body):
    """``body(value)``, with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: int = 1, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about ``limit`` bytes of text (or one longer text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    whole = ends // limit
    edges = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)

