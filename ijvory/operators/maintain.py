"""Canonical form, filters and order of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ijvory.functions.columns import is_number


def sum_duplicates(a: DataFrame) -> DataFrame:
    """One entry for each cell; entries that cancel stay as zeros."""
    return a.groupBy("i", "j").agg(F.sum("v").alias("v"))


def dropzeros(a: DataFrame) -> DataFrame:
    return a.where("v <> 0")


def to_canonical(a: DataFrame) -> DataFrame:
    """No duplicates and no zeros."""
    return dropzeros(sum_duplicates(a))


def keep(a: DataFrame, predicate: Column) -> DataFrame:
    """The entries for which a predicate on i, j and v holds."""
    return a.where(predicate)


def droptol(a: DataFrame, tol: float = 1e-15) -> DataFrame:
    """Entries larger than ``tol`` by absolute value; NaN goes."""
    return a.where((F.abs("v") > tol) & is_number(F.col("v")))


def band(a: DataFrame, lower: int, upper: int) -> DataFrame:
    """Entries with lower <= j - i <= upper."""
    if lower > upper:
        raise ValueError("the lower diagonal is above the upper one")
    return a.where((F.col("j") - F.col("i")).between(lower, upper))


def tril(a: DataFrame) -> DataFrame:
    return a.where("i >= j")


def triu(a: DataFrame) -> DataFrame:
    return a.where("i <= j")


def ordered(a: DataFrame) -> DataFrame:
    """Entries by column, then row."""
    return a.orderBy("j", "i")


def column_pointers(a: DataFrame, ncols: int) -> DataFrame:
    """``(j, p)`` for j = 0 .. ncols: entries in the columns before j.

    Columns are few against entries; the running sum is over counts by column.
    """
    counts = a.groupBy("j").agg(F.count("*").alias("n"))
    all_cols = a.sparkSession.range(ncols + 1).withColumnRenamed("id", "j").join(counts, "j", "left")
    before = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    return all_cols.select("j", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))


def faults(a: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """One row: entries out of bounds, stored zeros, and duplicates."""
    out = (F.col("i") < 0) | (F.col("i") >= nrows) | (F.col("j") < 0) | (F.col("j") >= ncols)
    cells = a.groupBy("i", "j").agg(F.count("*").alias("n"), F.count_if(F.col("v") == 0).alias("z"))
    return cells.agg(
        F.coalesce(F.sum(F.when(out, F.col("n")).otherwise(0)), F.lit(0)).alias("out_of_bounds"),
        F.coalesce(F.sum("z"), F.lit(0)).alias("zeros"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )
