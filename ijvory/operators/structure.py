"""Predicates on the structure of a matrix, sums and norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.functions.columns import is_number


def _dense(spark, n: int, sparse: DataFrame, fill: float = 0.0) -> DataFrame:
    """``(i, v)`` for every i below n."""
    return spark.range(n).withColumnRenamed("id", "i").join(sparse, "i", "left").select("i", F.coalesce("v", F.lit(fill)).alias("v"))


def is_symmetric(a: DataFrame) -> DataFrame:
    """One row ``flag`` for a square matrix without duplicates: equal to its transpose, NaN to nothing."""
    t = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    odd = a.join(t, ["i", "j"], "full_outer").where((F.coalesce("v", F.lit(0.0)) != F.coalesce("w", F.lit(0.0))) | F.isnan(F.coalesce("v", F.lit(0.0))))
    return odd.agg((F.count("*") == 0).alias("flag"))


def is_triangular(a: DataFrame) -> DataFrame:
    """One row ``kind``: 1 upper (a diagonal matrix too), -1 lower, 0 neither, by stored entries."""
    seen = a.agg(F.coalesce(F.bool_and(F.col("i") <= F.col("j")), F.lit(True)).alias("u"), F.coalesce(F.bool_and(F.col("i") >= F.col("j")), F.lit(True)).alias("l"))
    return seen.select(F.when(F.col("u"), 1).when(F.col("l"), -1).otherwise(0).alias("kind"))


def structural_symmetry(a: DataFrame) -> DataFrame:
    """One row ``v``: the share of entries off the diagonal whose mirror is stored; NaN without any."""
    off = a.where("i <> j").select("i", "j").distinct()
    pair = off.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count("*").alias("n"))
    sums = pair.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("n") == 2, 2).otherwise(0)), F.lit(0)).alias("both"))
    return sums.select(F.when(F.col("all") > 0, F.try_divide(F.col("both").cast("double"), F.col("all"))).otherwise(F.lit(float("nan"))).alias("v"))


def diagonal(a: DataFrame, nrows: int, ncols: int, k: int = 0) -> DataFrame:
    """``(i, v)``: the k-th diagonal, of min(nrows, ncols) - |k| places counted from its start."""
    n = max(0, min(nrows, ncols) - abs(k))
    own = a.where(F.col("j") - F.col("i") == k).groupBy(F.least("i", "j").alias("i")).agg(F.sum("v").alias("v"))
    return _dense(a.sparkSession, n, own)


def norm1(a: DataFrame) -> DataFrame:
    """One row ``v``: the largest sum of absolute values of a column; NaN columns are passed over."""
    sums = a.groupBy("j").agg(F.sum(F.abs("v")).alias("v")).where(is_number(F.col("v")))
    return sums.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


def fronorm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))


def row_sums(a: DataFrame, nrows: int) -> DataFrame:
    return _dense(a.sparkSession, nrows, a.groupBy("i").agg(F.sum("v").alias("v")))


def col_sums(a: DataFrame, ncols: int) -> DataFrame:
    return _dense(a.sparkSession, ncols, a.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("v")))


def col_lengths(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.count("*").alias("n"))


def diag_distance(a: DataFrame, ncols: int) -> DataFrame:
    """``(j, d)``: how far above the diagonal each column of a square matrix begins."""
    first = a.groupBy("j").agg(F.min("i").alias("first"))
    cols = a.sparkSession.range(ncols).withColumnRenamed("id", "j").join(first, "j", "left")
    return cols.select("j", (F.col("j") - F.least(F.coalesce("first", "j"), "j")).alias("d"))


def profile_and_bandwidth(a: DataFrame, ncols: int) -> DataFrame:
    return diag_distance(a, ncols).agg(F.sum("d").alias("profile"), F.max("d").alias("bandwidth"))


def leftmost(a: DataFrame, nrows: int) -> DataFrame:
    """``(i, j)``: the first column of each row, -1 for an empty one."""
    rows = a.sparkSession.range(nrows).withColumnRenamed("id", "i").join(a.groupBy("i").agg(F.min("j").alias("j")), "i", "left")
    return rows.select("i", F.coalesce("j", F.lit(-1)).alias("j"))
