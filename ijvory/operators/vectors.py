"""Vectors ``(i, v)`` and permutations ``(k, at)``: entry k of the result comes from ``at``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ijvory.functions.columns import EPSILON, larger_first


def norm(x: DataFrame, order: float) -> DataFrame:
    """One row ``v``: the norm of order 0 (nonzeros), 1, 2, infinity or any other p; 0 if empty."""
    size = F.abs("v")
    if order == 0:
        out = F.count_if(size > EPSILON).cast("double")
    elif order == 1:
        out = F.sum(size)
    elif order == 2:
        out = F.sqrt(F.sum(F.col("v") * F.col("v")))
    elif order == float("inf"):
        out = F.max(size)
    else:
        out = F.pow(F.sum(F.pow(size, F.lit(order))), F.lit(1 / order))
    return x.agg(F.coalesce(out, F.lit(0.0)).alias("v"))


def inv_permute(p: DataFrame) -> DataFrame:
    return p.select(F.col("at").alias("k"), F.col("k").alias("at"))


def pvec(p: DataFrame, b: DataFrame) -> DataFrame:
    """x[k] = b[p[k]]."""
    return p.join(b, F.col("at") == F.col("i")).select(F.col("k").alias("i"), "v")


def ipvec(p: DataFrame, b: DataFrame) -> DataFrame:
    """x[p[k]] = b[k]."""
    return pvec(inv_permute(p), b)


def randperm(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Seed 0 is the identity, -1 the reverse, others shuffle; seeds below -1 are an error."""
    if seed < -1:
        raise ValueError("seed below -1")
    ids = spark.range(n)
    if seed == 0:
        return ids.select(F.col("id").alias("k"), F.col("id").alias("at"))
    if seed == -1:
        return ids.select(F.col("id").alias("k"), (n - 1 - F.col("id")).alias("at"))
    k = F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1
    return ids.select(k.cast("long").alias("k"), F.col("id").alias("at"))


def argmaxabs(x: DataFrame) -> DataFrame:
    """One row ``i``: where the largest absolute value is, the first of equals."""
    return x.agg(F.max_by("i", larger_first(F.col("v"), F.col("i"))).alias("i"))


def householder(x: DataFrame) -> DataFrame:
    """One row ``(beta, s)`` of the reflection that takes x to (s, 0, ...): s = -sign(x0) |x|, beta = (s - x0) / s."""
    sums = x.agg(F.coalesce(F.max(F.when(F.col("i") == 0, F.col("v"))), F.lit(0.0)).alias("x0"), F.coalesce(F.sum(F.when(F.col("i") > 0, F.col("v") * F.col("v"))), F.lit(0.0)).alias("tail"))
    s = F.when(F.col("x0") >= 0, -F.sqrt(F.col("x0") * F.col("x0") + F.col("tail"))).otherwise(F.sqrt(F.col("x0") * F.col("x0") + F.col("tail")))
    still = F.col("tail") == 0
    sized = sums.select("x0", "tail", F.when(still, F.col("x0")).otherwise(s).alias("s"))
    return sized.select(F.when(still, F.lit(0.0)).otherwise(F.try_divide(F.col("s") - F.col("x0"), F.col("s"))).alias("beta"), "s")
