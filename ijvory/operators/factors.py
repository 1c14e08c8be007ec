"""Factors of one large matrix, by the rounds of ``elimination``: LU, Cholesky, their incomplete forms, updates and solves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators.elimination import Factors, eliminate, least_degree_diagonals, threshold_pivots
from ijvory.operators.products import add_vectors, spmv
from ijvory.operators.rounds import NotPositiveDefinite, SingularMatrix, afresh, settle
from ijvory.operators.structure import norm1


def _one_relation(factors: Factors) -> DataFrame:
    """``(i, j, v)``: U on and above the diagonal, the unit lower L below it, of an elimination in the given order."""
    pivots, lower, upper = factors.parts()
    diag = pivots.select("i", "j", F.col("d").alias("v"))
    return diag.unionByName(lower.select("i", F.col("p").alias("j"), "v")).unionByName(upper.select(F.col("p").alias("i"), "j", "v"))


def lu_no_pivots(a: DataFrame) -> DataFrame:
    """Complete L and U without pivoting, in one relation. A pivot of zero is an error."""
    return _one_relation(eliminate(a))


def incomplete_lu(a: DataFrame, pattern: DataFrame | None = None) -> DataFrame:
    """The same on ``pattern`` (A's own if None); other updates are left out."""
    return _one_relation(eliminate(a, pattern=settle((a if pattern is None else pattern).select("i", "j").distinct())))


def incomplete_lu_threshold(a: DataFrame, drop_tol: float, tol: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pivots, L and U as ``lu``; entries of U of at most ``drop_tol``, and multipliers of at most that, are left out."""
    if drop_tol < 0:
        raise ValueError("drop_tol is negative")

    def drop(next_to: DataFrame) -> DataFrame:
        size = F.abs(F.col("v") / F.col("d")) if "p" in next_to.columns else F.abs("v")
        return next_to.where(size > drop_tol)

    return _with_steps(eliminate(a, threshold_pivots(tol), drop=drop))


def _with_steps(factors: Factors) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ijvory.operators.orderings import before

    pivots, lower, upper = factors.parts()
    pivots = settle(before(pivots, ["round", "place", "i"], F.lit(1).cast("long"), "k").select("k", "i", "j", "d"))
    at = pivots.select(F.col("i").alias("p"), "k")
    low = lower.join(at, "p").select("i", F.col("k").alias("j"), "v").unionByName(pivots.select("i", F.col("k").alias("j"), F.lit(1.0).alias("v")))
    up = upper.join(at, "p").select(F.col("k").alias("i"), "j", "v").unionByName(pivots.select(F.col("k").alias("i"), "j", F.col("d").alias("v")))
    return pivots, low, up


def lu(a: DataFrame, tol: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pivots ``(k, i, j, d)``, L ``(i, k)`` and U ``(k, j)`` as matrices with A = L U, for a matrix of any shape and rank.

    Step k takes row i and column j. Pivots have ``tol`` of their column's largest entry or more;
    there are as many as the rank. L's rows and U's columns are those of A, not permuted.
    """
    return _with_steps(eliminate(a, threshold_pivots(tol)))


def lower_of(factors: DataFrame) -> DataFrame:
    """The unit lower factor of one relation."""
    diag = factors.where("i = j").select("i", "j", F.lit(1.0).alias("v"))
    return factors.where("i > j").unionByName(diag)


def upper_of(factors: DataFrame) -> DataFrame:
    return factors.where("i <= j")


def _rooted(factors: DataFrame) -> DataFrame:
    """L with L Lᵀ = A from the factors of a symmetric matrix."""
    pivots = settle(factors.where("i = j").select("j", F.col("v").alias("d")))
    if not pivots.where("d <= 0").isEmpty():
        raise NotPositiveDefinite("not positive definite")
    return lower_of(factors).join(pivots, "j").select("i", "j", (F.col("v") * F.sqrt("d")).alias("v"))


def _mirrored(a: DataFrame) -> DataFrame:
    upper = a.where("i <= j")
    return upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def _definite(a: DataFrame, **more) -> DataFrame:
    try:
        return settle(_rooted(settle(_one_relation(eliminate(_mirrored(a), definite=True, **more)))))
    except SingularMatrix:
        raise NotPositiveDefinite("not positive definite") from None


def cholesky(a: DataFrame) -> DataFrame:
    """L with L Lᵀ = A; only the upper triangle is read; an error if A is not positive definite."""
    return _definite(a)


def cholesky_ordered(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An order ``(k, at)`` of little fill, and L with L Lᵀ = A; only the upper triangle is read.

    L keeps A's numbers: column ``at`` has no entry in a row that comes before it in the order. The
    order is found while the pivots are taken, those of least degree first, so it holds
    for patterns of any kind; an error if A is not positive definite.
    """
    from ijvory.operators.orderings import before

    try:
        pivots, lower, _ = eliminate(_mirrored(a), least_degree_diagonals, definite=True).parts()
    except SingularMatrix:
        raise NotPositiveDefinite("not positive definite") from None
    pivots = settle(before(pivots, ["round", "place", "i"], F.lit(1).cast("long"), "k").select("k", "i", "d"))
    if not pivots.where("d <= 0").isEmpty():
        raise NotPositiveDefinite("not positive definite")
    scaled = lower.join(pivots.select(F.col("i").alias("p"), "d"), "p").select("i", F.col("p").alias("j"), (F.col("v") * F.sqrt("d")).alias("v"))
    diag = pivots.select("i", F.col("i").alias("j"), F.sqrt("d").alias("v"))
    return pivots.select("k", F.col("i").alias("at")), afresh(diag.unionByName(scaled))


def incomplete_cholesky(a: DataFrame) -> DataFrame:
    """L on the pattern of A's lower triangle, L Lᵀ equal to A there; only the upper triangle is read."""
    both = _mirrored(a)
    return _definite(a, pattern=settle(both.select("i", "j").distinct()))


def incomplete_cholesky_threshold(a: DataFrame, drop_tol: float) -> DataFrame:
    """L without its entries of at most ``drop_tol`` times their row's diagonal in A; only the upper triangle is read."""
    if drop_tol < 0:
        raise ValueError("drop_tol is negative")
    diag = settle(a.where("i = j").groupBy("i").agg(F.abs(F.sum("v")).alias("own")).select(F.col("i").alias("far"), "own"))

    def drop(next_to: DataFrame) -> DataFrame:
        # the row of the factor is that of the end that is not the pivot
        far = F.col("i") if "p" in next_to.columns else F.col("j")
        names = next_to.columns
        return next_to.withColumn("far", far).join(diag, "far").where(F.abs("v") / F.sqrt(F.abs("d")) > drop_tol * F.col("own")).select(names)

    return _definite(a, drop=drop)


def cholesky_update(lower: DataFrame, w: DataFrame, sign: float = 1.0) -> DataFrame:
    """The factor of L Lᵀ + sign w wᵀ for a vector ``(i, v)``, sign 1 or -1.

    Walks the path of the elimination tree from w's first entry: one column of L and what is left of
    w change at each node, and nothing else is read. Where w has entries that the column does
    not have, the column fills up. An error if the result is not positive definite.
    """
    rest = settle(w.where("v <> 0").groupBy("i").agg(F.sum("v").alias("v")))
    lower, beta, done = settle(lower), 1.0, []
    while True:
        first = rest.where("v <> 0").agg(F.min_by(F.struct("i", "v"), "i").alias("x")).first()["x"]
        if first is None:
            break
        j = first["i"]
        column = lower.where(F.col("j") == j)
        d = column.where("i = j").first()
        if d is None or d["v"] == 0:
            raise SingularMatrix("no diagonal entry")
        alpha = first["v"] / d["v"]
        square = beta * beta + sign * alpha * alpha
        if square <= 0:
            raise NotPositiveDefinite("not positive definite")
        new = square**0.5
        scale, gain = (beta / new, alpha / (new * beta)) if sign > 0 else (new / beta, -alpha / (new * beta))
        both = column.select("i", F.col("v").alias("l")).join(rest.select("i", F.col("v").alias("w")), "i", "full_outer")
        both = settle(both.select("i", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("w", F.lit(0.0)).alias("w")))
        left = F.col("w") - alpha * F.col("l")
        value = scale * F.col("l") + gain * (F.col("w") if sign > 0 else F.when(F.col("i") == j, 0.0).otherwise(left))
        done.append((j, both.select("i", F.lit(j).alias("j"), value.alias("v"))))
        rest = settle(both.where(F.col("i") > j).select("i", left.alias("v")))
        beta = new
    if not done:
        return lower
    out = lower.where(~F.col("j").isin([j for j, _ in done]))
    for _, column in done:
        out = out.unionByName(column)
    return out


# Solving with factors; right sides are ``(i, k, v)`` or ``(i, v)``.


def _sides(b: DataFrame) -> tuple[DataFrame, bool]:
    return (b, False) if "k" in b.columns else (b.withColumn("k", F.lit(0)), True)


def _solved(factors: Factors, b: DataFrame) -> DataFrame:
    b, single = _sides(b)
    x = factors.solve(b)
    return x.drop("k") if single else x


def chol_solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """x of A x = b for a positive definite A, of which only the upper triangle is read; an error if it is not. The order of pivots is one of little fill."""
    return _solved(eliminate(_mirrored(a), least_degree_diagonals, definite=True), b)


def lu_solve(a: DataFrame, b: DataFrame, tol: float = 1.0, refine: int = 0) -> DataFrame:
    """x of A x = b for a square A, pivots chosen by size; ``refine`` steps solve for the residual again. An error if A is singular."""
    a = settle(a)
    factors = eliminate(a, threshold_pivots(tol))
    b, single = _sides(b)
    x = factors.solve(b)
    for _ in range(refine):
        ax = a.join(x.select(F.col("i").alias("j"), "k", F.col("v").alias("x")), "j").select("i", "k", (-F.col("v") * F.col("x")).alias("v"))
        more = factors.solve(b.select("i", "k", "v").unionByName(ax))
        x = settle(x.unionByName(more).groupBy("i", "k").agg(F.sum("v").alias("v")))
    return x.drop("k") if single else x


def plan_lu(a: DataFrame, tol: float = 1.0) -> Factors:
    """The factors of a matrix, kept: to ``solve`` with them, and to ``refactor`` others of its pattern."""
    return eliminate(a, threshold_pivots(tol))


def plan_cholesky(a: DataFrame) -> Factors:
    """The same for a positive definite matrix, of which only the upper triangle is read, in an order of little fill."""
    return eliminate(_mirrored(a), least_degree_diagonals, definite=True)


def refactor(plan: Factors, a: DataFrame) -> Factors:
    """The factors of a matrix whose cells are all cells of the plan's, by the plan's pivots: nothing is chosen or ordered again.

    A pivot that is zero now, or not positive for a Cholesky plan, is an error, and so is a cell that the plan lacks.
    """
    return eliminate(_mirrored(a) if plan.definite else a, definite=plan.definite, plan=plan)


def solve_with(plan: Factors, b: DataFrame) -> DataFrame:
    """x of A x = b for kept factors."""
    return _solved(plan, b)


def lu_solve_transposed(a: DataFrame, b: DataFrame, tol: float = 1.0) -> DataFrame:
    """x of Aᵀ x = b, from the factors of A."""
    return _solved(eliminate(a, threshold_pivots(tol)).transposed(), b)


def inverse_norm1(a: DataFrame, n: int, steps: int = 5) -> float:
    """An estimate from below of the 1-norm of the inverse of an n x n matrix: the largest column that a few solves with A and Aᵀ lead to."""
    if n == 0:
        raise ValueError("an empty matrix has no inverse")
    factors = eliminate(a, threshold_pivots())
    back, at, best = factors.transposed(), None, 0.0
    x = a.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(1.0 / n).alias("v"))
    for _ in range(steps):
        y = settle(_solved(factors, x))
        size = y.agg(F.sum(F.abs("v"))).first()[0] or 0.0
        if size <= best and at is not None:
            break
        best = max(best, size)
        sign = y.select("i", F.when(F.col("v") < 0, -1.0).otherwise(1.0).alias("v"))
        z = settle(_solved(back, sign))
        top = z.agg(F.max_by(F.struct("i", "v"), F.struct(F.abs("v"), -F.col("i"))).alias("x")).first()["x"]
        if top["i"] == at:
            break
        at = top["i"]
        x = a.sparkSession.range(at, at + 1).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    return best


def condition1(a: DataFrame, n: int) -> float:
    """An estimate of the condition number in the 1-norm; infinite for a singular matrix."""
    a = settle(a)
    try:
        return norm1(a).first()["v"] * inverse_norm1(a, n)
    except SingularMatrix:
        return float("inf")


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """``(i, v)``: b - A x for single right sides."""
    return add_vectors(b, spmv(a, x), 1.0, -1.0)
