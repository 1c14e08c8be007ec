"""Triangular systems, solved level by level: all unknowns of a level at once, by a join and a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.functions.columns import quotient
from ijvory.operators.graphs import peel_triangular, reach, topological_levels
from ijvory.operators.rounds import apart, settle
from ijvory.operators.shape import transpose


def solve(t: DataFrame, b: DataFrame) -> DataFrame:
    """x of T x = b as ``(i, k, v)`` for right sides ``(i, k, v)``; T is lower or upper triangular.

    The order follows from T's pattern alone, so a permuted triangle with its
    diagonal in place is solved as well. A zero on the diagonal gives infinite
    or NaN values, as in floating point.
    """
    levels = settle(topological_levels(t.select("i", "j")))
    last = levels.agg(F.max("level")).first()[0]
    diag = t.where("i = j").groupBy("i").agg(F.sum("v").alias("d"))
    off = settle(t.where("i <> j").join(levels.select(F.col("node").alias("j"), F.col("level").alias("at")), "j").select("i", "j", "v", "at"))
    rest = settle(b.select("i", "k", "v").join(levels.select(F.col("node").alias("i"), "level"), "i"))
    out = None
    for level in range((last if last is not None else -1) + 1):
        now = rest.where(F.col("level") == level).groupBy("i", "k").agg(F.sum("v").alias("v"))
        x = settle(now.join(diag, "i", "left").select("i", "k", quotient(F.col("v"), F.coalesce("d", F.lit(0.0))).alias("v")))
        out = x if out is None else out.unionByName(x)
        y = x.select(F.col("i").alias("j"), "k", F.col("v").alias("x"))
        moved = off.where(F.col("at") == level).join(y, "j").select("i", "k", (-F.col("v") * F.col("x")).alias("v"))
        moved = moved.join(levels.select(F.col("node").alias("i"), "level"), "i").select("i", "k", "v", "level")
        rest = settle(rest.where(F.col("level") > level).select("i", "k", "v", "level").unionByName(moved))
    return out if out is not None else b.select("i", "k", "v").limit(0)


def solve_transposed(t: DataFrame, b: DataFrame) -> DataFrame:
    """x of Tᵀ x = b."""
    return solve(transpose(t), b)


def lower_diagonals(a: DataFrame) -> DataFrame:
    """``(i, j)``: the last column of each row, the diagonal of a row-permuted lower triangle."""
    return a.groupBy("i").agg(F.max("j").alias("j"))


def upper_diagonals(a: DataFrame) -> DataFrame:
    """``(i, j)``: the first column of each row, the diagonal of a row-permuted upper triangle."""
    return a.groupBy("i").agg(F.min("j").alias("j"))


def solve_row_permuted(a: DataFrame, b: DataFrame, lower: bool = True) -> DataFrame:
    """x of A x = b where A's rows are those of a triangle in another order."""
    diag = settle((lower_diagonals if lower else upper_diagonals)(a))
    n = diag.count()
    if diag.select("j").distinct().count() != n:
        raise ValueError("not a row-permuted triangle")
    move = diag.select("i", F.col("j").alias("to"))
    rows = a.join(move, "i").select(F.col("to").alias("i"), "j", "v")
    return solve(rows, b.join(move, "i").select(F.col("to").alias("i"), "k", "v"))


def solve_column_permuted(a: DataFrame, b: DataFrame, lower: bool = True) -> DataFrame:
    """x of A x = b where A's columns are those of a triangle in another order."""
    diag = settle(a.groupBy("j").agg((F.min if lower else F.max)("i").alias("to")))
    if diag.select("to").distinct().count() != diag.count():
        raise ValueError("not a column-permuted triangle")
    cols = a.join(diag, "j").select("i", F.col("to").alias("j"), "v")
    return solve(cols, b).join(diag.select(F.col("to").alias("i"), "j"), "i").select(F.col("j").alias("i"), "k", "v")


def triangular_order(a: DataFrame) -> DataFrame:
    """``(k, i, j)``: the orders of rows and columns that make A a lower triangle; row i has its diagonal in column j. An error if there are none."""
    from ijvory.operators.orderings import before

    pairs = settle(peel_triangular(a))
    size = max(a.agg(F.count_distinct("i"), F.count_distinct("j")).first())
    if pairs.count() != size:
        raise ValueError("not a permuted triangle")
    return before(pairs, ["round", "i"], F.lit(1).cast("long"), "k").select("k", "i", "j")


def solve_permuted(a: DataFrame, b: DataFrame) -> DataFrame:
    """x of A x = b where A's rows and columns are those of a triangle, lower or upper, in other orders."""
    move = settle(triangular_order(a)).select("i", F.col("j").alias("to"))
    rows = a.join(move, "i").select(F.col("to").alias("i"), "j", "v")
    return solve(rows, b.join(move, "i").select(F.col("to").alias("i"), "k", "v"))


def solve_sparse(t: DataFrame, b: DataFrame) -> DataFrame:
    """x of T x = b for a right side of few entries: only the columns that these reach are read, and only their rows are solved for.

    The pattern of T decides, so entries that cancel are zeros that are stored.
    """
    live = settle(reach(t.select("i", "j"), b.where("v <> 0").select(F.col("i").alias("node"))))
    part = t.join(live.select(F.col("node").alias("j")), "j", "left_semi")
    return solve(apart(settle(part)), b)
