"""Elementwise operations, stacking, slicing and permuting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators.maintain import dropzeros, sum_duplicates
from ijvory.operators.rounds import dealt


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scalar(a: DataFrame, c: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * F.lit(float(c)))


def add_scaled(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0, rows: int = 0) -> DataFrame:
    """alpha A + beta B; entries that cancel stay. ``rows``: about how many entries both have, for a table of many."""
    return sum_duplicates(dealt(scalar(a, alpha).unionByName(scalar(b, beta)), rows, "i", "j"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add_scaled(a, b, 1.0, -1.0)


def scale_rows_cols(a: DataFrame, r: DataFrame, c: DataFrame) -> DataFrame:
    """diag(r) A diag(c) for vectors ``(i, v)`` that have all indices."""
    r, c = r.select("i", F.col("v").alias("r")), c.select(F.col("i").alias("j"), F.col("v").alias("c"))
    return a.join(r, "i").join(c, "j").select("i", "j", (F.col("r") * F.col("v") * F.col("c")).alias("v"))


def shifted(a: DataFrame, down: int = 0, right: int = 0) -> DataFrame:
    """Empty rows above and empty columns to the left."""
    return a.select((F.col("i") + down).alias("i"), (F.col("j") + right).alias("j"), "v")


def hstack(a: DataFrame, b: DataFrame, ncols_a: int) -> DataFrame:
    return a.unionByName(shifted(b, right=ncols_a))


def vstack(a: DataFrame, b: DataFrame, nrows_a: int) -> DataFrame:
    return dropzeros(a.unionByName(shifted(b, down=nrows_a)))


def window(a: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Rows i0 to i1 and columns j0 to j1, ends exclusive, counted anew."""
    if not (0 <= i0 <= i1 and 0 <= j0 <= j1):
        raise ValueError("bad range")
    inside = (F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1)
    return shifted(a.where(inside), -i0, -j0)


def index(a: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """C(k, l) = A(rows[k], cols[l]) for ``(k, at)`` relations; indices may repeat; zeros go."""
    rows, cols = rows.select(F.col("k").alias("ti"), F.col("at").alias("i")), cols.select(F.col("k").alias("tj"), F.col("at").alias("j"))
    return dropzeros(a.join(rows, "i").join(cols, "j").select(F.col("ti").alias("i"), F.col("tj").alias("j"), "v"))


def permute(a: DataFrame, p: DataFrame | None = None, q: DataFrame | None = None) -> DataFrame:
    """P A Q: row k of the result is row p[k], column l is column q[l]; None leaves the order."""
    if p is not None:
        a = a.join(p.select(F.col("k").alias("ti"), F.col("at").alias("i")), "i").select(F.col("ti").alias("i"), "j", "v")
    if q is not None:
        a = a.join(q.select(F.col("k").alias("tj"), F.col("at").alias("j")), "j").select("i", F.col("tj").alias("j"), "v")
    return a


def permute_transpose(a: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """P Aᵀ Q."""
    return permute(transpose(a), p, q)


def symperm(a: DataFrame, p: DataFrame) -> DataFrame:
    """The upper triangle of P A Pᵀ from the upper triangle of A."""
    both = permute(a.where("i <= j"), p, p)
    return both.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")


def make_symmetric(a: DataFrame) -> DataFrame:
    """A and the mirror of its entries off the diagonal."""
    return sum_duplicates(a.unionByName(transpose(a.where("i <> j"))))


def augment(a: DataFrame, nrows: int) -> DataFrame:
    """[[I, A], [Aᵀ, 0]] for a matrix of nrows rows."""
    eye = a.sparkSession.range(nrows).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return eye.unionByName(shifted(a, right=nrows)).unionByName(shifted(transpose(a), down=nrows))
