"""What can be said of a factorisation before it is done: orders, trees, counts and places of the factors' entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators.graphs import graph_of_sum
from ijvory.operators.orderings import before
from ijvory.operators.rounds import settle
from ijvory.operators.trees import column_counts, etree, householder_counts


@dataclass
class Symbolic:
    """``columns (node, parent, n, start)``: for each column its parent in the tree, its entries and where they start; ``entries`` in all.

    Nodes are numbered by the order that was asked for; ``start`` counts them column by column.
    """

    columns: DataFrame
    entries: int


def _started(columns: DataFrame) -> Symbolic:
    columns = settle(before(columns, ["node"], F.col("n"), "start").select("node", "parent", "n", "start"))
    return Symbolic(columns, int(columns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))


def symbolic_cholesky(a: DataFrame, n: int, order: DataFrame | None = None) -> Symbolic:
    """The columns of L for a symmetric pattern of which the upper triangle is read, in its own order or ``order (k, at)``."""
    cells = a.where("i <= j").select("i", "j")
    if order is not None:
        x, y = (order.select(F.col("at").alias(c), F.col("k").alias(f"{c}2")) for c in "ij")
        cells = cells.join(x, "i").join(y, "j").select(F.least("i2", "j2").alias("i"), F.greatest("i2", "j2").alias("j"))
    both = settle(cells.unionByName(cells.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    tree = settle(etree(both, n))
    return _started(tree.join(column_counts(both, tree), "node"))


def symbolic_qr(a: DataFrame, m: int, n: int) -> tuple[Symbolic, Symbolic, int]:
    """The Householder vectors and the rows of R of an m x n pattern, and how many rows there are with those that have to be added."""
    found = settle(householder_counts(a, n))
    added = found.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]
    return _started(found.withColumn("n", F.col("v"))), _started(found.withColumn("n", F.col("r"))), m + int(added)


def lu_bounds(a: DataFrame, m: int, n: int, normal: bool = True) -> tuple[int, int]:
    """Entries that L and U have at most: by the QR factors for any choice of pivots (``normal``), or by Cholesky of A + Aᵀ for pivots on the diagonal."""
    if normal:
        v, r, _ = symbolic_qr(a, m, n)
        return v.entries, r.entries
    one = symbolic_cholesky(graph_of_sum(a).unionByName(a.sparkSession.range(n).selectExpr("id as i", "id as j")), n)
    return one.entries, one.entries
