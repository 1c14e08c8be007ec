"""Solving one large system with joins and sums, and the choice of how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators import factors, triangular
from ijvory.operators.products import add_vectors, spmv, spmv_t, vecdot
from ijvory.operators.rounds import settle
from ijvory.operators.structure import is_symmetric, is_triangular


def conjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-12, most: int = 200, normal: bool = False) -> DataFrame:
    """x of A x = b as ``(i, v)`` for a positive definite A; with ``normal``, of least squares for any A.

    Each step is one product with A (two with ``normal``); only scalars reach the driver. An error
    if the residual is not within ``tol`` after ``most`` steps.
    """
    a = settle(a)
    times = (lambda x: spmv_t(a, spmv(a, x))) if normal else (lambda x: spmv(a, x))
    r = settle(spmv_t(a, b) if normal else b.select("i", "v"))
    scalar = lambda x, y: vecdot(x, y).first()["v"]
    p, x = r, settle(r.withColumn("v", F.lit(0.0)))
    size = first = scalar(r, r)
    for _ in range(most):
        if size <= tol * tol * first or size == 0:
            break
        ap = settle(times(p))
        curve = scalar(p, ap)
        if curve <= 0:
            raise ValueError("not positive definite")
        step = size / curve
        x, r = settle(add_vectors(x, p, 1.0, step)), settle(add_vectors(r, ap, 1.0, -step))
        new = scalar(r, r)
        p, size = settle(add_vectors(r, p, 1.0, new / size)), new
    else:
        raise ArithmeticError(f"no convergence in {most} steps")
    return x


def choose(a: DataFrame) -> str:
    """How ``solve`` treats a matrix: triangular, definite (perhaps) or general. One row of statistics decides."""
    m, n, zero, low, high = a.agg(
        F.max("i") + 1, F.max("j") + 1, F.max("i") + 1 - F.count_if((F.col("i") == F.col("j")) & (F.col("v") != 0)),
        F.min(F.when(F.col("i") == F.col("j"), F.col("v"))), F.max(F.when(F.col("i") == F.col("j"), F.col("v"))),
    ).first()
    if m != n:
        return "general"
    if zero == 0 and is_triangular(a).first()["kind"]:
        return "triangular"
    if zero == 0 and low * high > 0 and is_symmetric(a).first()["flag"]:
        return "definite" if low > 0 else "negative"
    return "general"


def solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """x of A x = b as ``(i, v)``: triangles by level, symmetric matrices of one sign by gradients, other square ones by LU with pivots.

    Where gradients do not converge or meet no definite matrix, LU takes over; a singular matrix is
    an error. What is not square is solved by least squares on the normal equations, which
    raise an error if they do not converge.
    """
    kind = choose(a)
    if kind == "triangular":
        return triangular.solve(a, b.withColumn("k", F.lit(0))).select("i", "v")
    if kind in ("definite", "negative"):
        sign = 1.0 if kind == "definite" else -1.0
        try:
            return conjugate_gradient(a.withColumn("v", F.col("v") * sign), b.withColumn("v", F.col("v") * sign))
        except (ValueError, ArithmeticError):
            pass  # indefinite after all, or ill-conditioned
    m, n = a.agg(F.max("i"), F.max("j")).first()
    return factors.lu_solve(a, b.select("i", "v"), refine=1) if m == n else conjugate_gradient(a, b, normal=True)
