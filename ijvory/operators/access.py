"""Reading, inserting and assigning entries. Matrices are values: each function returns a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ijvory.operators.rounds import dealt


def insert(a: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` appended; duplicates add up when they are summed."""
    return a.unionByName(more)


def value(a: DataFrame, i: int, j: int) -> DataFrame:
    """One row ``v``: the sum of the entries of a cell, zero if it has none."""
    return a.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def column(a: DataFrame, j: int) -> DataFrame:
    """``(i, v)``, duplicates summed."""
    return a.where(F.col("j") == j).groupBy("i").agg(F.sum("v").alias("v"))


def elements(a: DataFrame, start: int, end: int) -> DataFrame:
    """Entries ``start`` to ``end`` (exclusive) by column, then row."""
    return a.orderBy("j", "i").offset(start).limit(end - start)


def assign(a: DataFrame, patch: DataFrame) -> DataFrame:
    """``a`` with the cells of ``patch`` replaced or added; zeros are stored."""
    return a.join(patch.select("i", "j"), ["i", "j"], "left_anti").unionByName(patch)


def assign_at(a: DataFrame, rows: DataFrame, cols: DataFrame, c: DataFrame, many: int = 0) -> DataFrame:
    """Entry (k, l) of ``c`` put at (rows[k], cols[l]); rows and cols are ``(k, at)``.

    Only stored entries of ``c`` are put; where an index repeats, the last one wins. ``many``: about how many entries A and ``c`` have, if many.
    """
    placed = c.join(rows.select(F.col("k").alias("i"), F.col("at").alias("ti")), "i").join(cols.select(F.col("k").alias("j"), F.col("at").alias("tj")), "j")
    last = dealt(placed, many, "ti", "tj").groupBy("ti", "tj").agg(F.max_by("v", F.struct("i", "j")).alias("v"))
    return assign(dealt(a, many, "i", "j"), last.select(F.col("ti").alias("i"), F.col("tj").alias("j"), "v"))


def update(a: DataFrame, patch: DataFrame, op) -> DataFrame:
    """``op(old, new)`` in the cells of ``patch``; a missing old value is zero."""
    new = patch.select("i", "j", F.col("v").alias("w"), F.lit(True).alias("hit"))
    both = a.join(new, ["i", "j"], "full_outer")
    old: Column = F.coalesce("v", F.lit(0.0))
    return both.select("i", "j", F.when(F.col("hit"), op(old, F.col("w"))).otherwise(old).alias("v"))


def numbered(a: DataFrame) -> DataFrame:
    """Each column's entries numbered from 0 by row."""
    return a.withColumn("at", F.row_number().over(Window.partitionBy("j").orderBy("i")) - 1)
