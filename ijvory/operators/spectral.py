"""The second eigenvector of a graph's Laplacian, by inverse iteration on a small subspace."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators.elimination import eliminate, least_degree_diagonals
from ijvory.operators.orderings import numbered
from ijvory.operators.products import spmm
from ijvory.operators.rounds import settle

#: Vectors that are iterated together; solves of a step, whose results all take part in the choice of the next vectors; the shift that makes the Laplacian definite, relative to its largest entry.
VECTORS, SOLVES, SHIFT = 8, 3, 1e-6


def laplacian(graph: DataFrame) -> DataFrame:
    """Degrees less weights for a symmetric ``(i, j, v)``; its diagonal does not count, the signs of its values neither."""
    off = graph.where("i <> j").select("i", "j", F.abs("v").alias("v"))
    degree = off.groupBy("i").agg(F.sum("v").alias("v"))
    return off.select("i", "j", (-F.col("v")).alias("v")).unionByName(degree.select("i", F.col("i").alias("j"), "v"))


def fiedler(graph: DataFrame, tol: float = 1e-9, most: int = 60) -> tuple[float, DataFrame]:
    """The second smallest eigenvalue of the Laplacian and its vector ``(i, v)`` of norm 1.

    ``graph`` is symmetric; every node that it has counts. The Laplacian, shifted a little, is factored once;
    each step solves for a few vectors at once, and for the solutions, takes the constant vector out of them, and
    finds the best ones of the span of all, so that eigenvalues which lie close together take few steps as well, of which only a few products reach the driver. The sign makes the
    largest entry positive, of equals that of the smallest node. An error if it does not converge.
    """
    lap = settle(laplacian(graph))
    top, n = lap.agg(F.max("v"), F.count_distinct("i")).first()
    if n < 2:
        raise ValueError("a graph has at least two nodes")
    width = min(VECTORS, n - 1)
    diag = lap.where("i = j").select("i", "j", F.lit(SHIFT * top).alias("v"))
    factors = eliminate(lap.unionByName(diag), least_degree_diagonals, definite=True)
    each = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k")
    # a hash of the node for chance, with mean zero after the first step
    x = lap.select("i").distinct().select("i", each).select("i", "k", (F.xxhash64("i", "k") / float(1 << 63)).alias("v"))
    value, x = None, settle(_best(settle(x), lap, n, width)[1])
    for _ in range(most):
        tried = []
        for turn in range(SOLVES):
            y = settle(factors.solve(x))
            # the shift lets the solves blow up what rounding leaves of the constant vector
            mean = y.groupBy("k").agg((F.sum("v") / n).alias("mean"))
            x = settle(y.join(F.broadcast(mean), "k").select("i", "k", (F.col("v") - F.col("mean")).alias("v")))
            tried.append(x.select("i", (F.col("k") + turn * width).alias("k"), "v"))
        every = tried[0]
        for y in tried[1:]:
            every = every.unionByName(y)
        values, x = _best(settle(every), lap, n, SOLVES * width)
        x = settle(x.where(F.col("k") < width))
        before, value = value, values[0]
        if before is not None and abs(before - value) <= tol * max(abs(value), SHIFT * top):
            break
    else:
        raise ArithmeticError(f"no convergence in {most} steps")
    x = settle(x.where("k = 0").select("i", "v"))
    sign = x.agg(F.max_by("v", F.struct(F.round(F.abs("v"), 9), -F.col("i")))).first()[0]
    return max(value, 0.0), settle(x.withColumn("v", F.col("v") * (1.0 if sign > 0 else -1.0)))


def _best(x: DataFrame, lap: DataFrame, n: int, width: int) -> tuple[np.ndarray, DataFrame]:
    """Ritz values, and the orthonormal vectors of the span of ``(i, k, v)`` that go with them, the constant vector taken out."""
    own = x.select("i", F.col("k").alias("a"), F.col("v").alias("u"))
    # products with the vectors, with the Laplacian's images of them, and with ones, all in one job
    sides = x.select("i", F.col("k").alias("b"), F.col("v").alias("t"), F.lit(0).alias("kind")).unionByName(
        spmm(lap, x).select("i", F.col("k").alias("b"), F.col("v").alias("t"), F.lit(1).alias("kind"))
    ).unionByName(x.select("i").distinct().select("i", F.lit(0).alias("b"), F.lit(1.0).alias("t"), F.lit(2).alias("kind")))
    dots = np.zeros((3, width, width))
    for r in own.join(sides, "i").groupBy("kind", "a", "b").agg(F.sum(F.col("u") * F.col("t")).alias("s")).collect():
        dots[r["kind"], r["a"], r["b"]] = r["s"]
    sums = dots[2, :, 0]
    # the constant vector is in the Laplacian's kernel, so taking it out changes the first products alone
    gram, form = (dots[0] + dots[0].T) / 2 - np.outer(sums, sums) / n, (dots[1] + dots[1].T) / 2
    # columns of very different lengths count alike
    length = np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
    size, turn = np.linalg.eigh(gram / np.outer(length, length))
    kept = size > 1e-14 * size.max()
    basis = turn[:, kept] / np.sqrt(size[kept]) / length[:, None]
    values, vectors = np.linalg.eigh(basis.T @ form @ basis)
    mix = basis @ vectors
    listed = lambda row: F.array(*[F.lit(float(v)) for v in row])
    cell, mean = F.array(*[listed(row) for row in mix]), listed(sums / n)
    new = x.select("i", F.posexplode(F.element_at(cell, F.col("k") + 1)).alias("to", "w"), (F.col("v") - F.element_at(mean, F.col("k") + 1)).alias("v"))
    return values, new.groupBy("i", F.col("to").alias("k")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def fiedler_order(graph: DataFrame) -> DataFrame:
    """The nodes ``(k, at)`` in the order of the second eigenvector."""
    _, x = fiedler(graph)
    return numbered(x.select(F.round("v", 12).alias("v"), F.col("i").alias("node")), ["v", "node"])
