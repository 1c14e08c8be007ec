"""Registered queries on matrices with real fill: factors, least squares, block forms and orders, with their DuckDB SQL.

GRID: the positive definite Laplacian + I of a k x k grid of parts, edges weighted by size.
SKEW: GRID with its lower half weakened and one row in 97 times 1e16, a general matrix.
OL: quantity by order (rows) and line number (columns), a tall one. EM: the embeddings, dense and tall.
FLOW: quantity by the nations of customer and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ijvory.operators import dissection, factors, graphs, maintain, orthogonal, products, shape, spectral, structure, trees, triangular, vectors
from ijvory.operators.rounds import dealt, settle
from ijvory.plans import block_form, symbolic
from ijvory.workloads import FILL, KNOWN, NET, RING, S, network, parts_vector, query, ramp, reverse, ring, rounded, table


def _side(spark, sf_dir) -> int:
    return int(table(spark, sf_dir, "part").count() ** 0.5)


def grid_edges(spark, sf_dir) -> tuple[DataFrame, int]:
    """Edges ``(i, j, w)``, i < j, and the number of nodes."""
    k = _side(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i"), (F.col("p_size") + 1.0).alias("w")).where(F.col("i") < k * k)
    right = part.where(F.col("i") % k < k - 1).select("i", (F.col("i") + 1).alias("j"), "w")
    return right.unionByName(part.where(F.col("i") < k * (k - 1)).select("i", (F.col("i") + k).alias("j"), "w")), k * k


def grid(spark, sf_dir) -> DataFrame:
    edges, n = grid_edges(spark, sf_dir)
    both = shape.make_symmetric(edges.select("i", "j", (-F.col("w")).alias("v")))
    degree = both.groupBy("i").agg(F.sum("v").alias("d"))
    diag = spark.range(n).join(degree, F.col("id") == F.col("i"), "left").select(F.col("id").alias("i"), F.col("id").alias("j"), (1.0 - F.coalesce("d", F.lit(0.0))).alias("v"))
    return both.unionByName(diag)


def _heavy():
    """A factor of 1e16 for some rows, 1 for the others."""
    return F.when(F.col("i") % 97 == 5, 1e16).otherwise(1.0)


def skew(spark, sf_dir) -> DataFrame:
    weak = F.when(F.col("i") > F.col("j"), 0.5).otherwise(1.0)
    return grid(spark, sf_dir).select("i", "j", (F.col("v") * weak * _heavy()).alias("v"))


def sevens(spark, n: int) -> DataFrame:
    """The vector 1, 2, .. 7, 1, 2, .."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7 + 1.0).alias("v"))


def order_lines(spark, sf_dir) -> DataFrame:
    """OL, duplicates summed."""
    t = table(spark, sf_dir, "lineitem")
    cells = t.select(F.col("l_orderkey").cast("long").alias("i"), (F.col("l_linenumber") - 1).cast("long").alias("j"), F.col("l_quantity").alias("v"))
    return maintain.sum_duplicates(dealt(cells, t.count(), "i"))


def order_priorities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i"), (F.col("o_orderkey") % 11 + 1.0).alias("v"))


def embeddings(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return t.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def flow(spark, sf_dir) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return maintain.sum_duplicates(both.select(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j"), F.col("l_quantity").alias("v")))


K = "(SELECT floor(sqrt(count(*)))::BIGINT FROM part)"
GEDGES = f"""SELECT p_partkey i, p_partkey + 1 j, p_size + 1.0 w FROM part WHERE p_partkey < {K} * {K} AND p_partkey % {K} < {K} - 1
  UNION ALL SELECT p_partkey, p_partkey + {K}, p_size + 1.0 FROM part WHERE p_partkey < {K} * ({K} - 1)"""
GRID = f"""SELECT i, j, v FROM (WITH e AS ({GEDGES}), b AS (SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e)
  SELECT i::BIGINT i, j::BIGINT j, -w::DOUBLE v FROM b UNION ALL SELECT k, k, (1 + coalesce((SELECT sum(w) FROM b WHERE b.i = k), 0))::DOUBLE FROM range({K} * {K}) t(k))"""
SEVENS = f"SELECT k::BIGINT i, (k % 7 + 1)::DOUBLE v FROM range({K} * {K}) t(k)"
OL = "SELECT l_orderkey i, l_linenumber - 1 j, sum(l_quantity)::DOUBLE v FROM lineitem GROUP BY 1, 2"
OB = "SELECT o_orderkey i, (o_orderkey % 11 + 1)::DOUBLE v FROM orders"
EMB = "SELECT vec_id i, (k - 1)::BIGINT j, embedding[k]::DOUBLE v FROM embeddings, range(1, 65) t(k)"
FLOW = """SELECT c_nationkey i, s_nationkey j, sum(l_quantity)::DOUBLE v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""


def normal_equations(a: str, b: str, n: int) -> str:
    """Tables ``eq``, the normal equations of a(i, j, v) and b(i, v) as a list of rows, and ``gj``, their Gauss-Jordan elimination; ``z(j, x)`` is the solution."""
    return f"""
  m0 AS (SELECT * FROM ({a})), b0 AS (SELECT * FROM ({b})),
  g AS (SELECT x.j AS p, y.j AS q, sum(x.v * y.v) AS v FROM m0 x JOIN m0 y USING (i) GROUP BY 1, 2 UNION ALL SELECT x.j, {n}, sum(x.v * y.v) FROM m0 x JOIN b0 y USING (i) GROUP BY 1),
  rows_ AS (SELECT p, list(coalesce(v, 0.0) ORDER BY q) AS r FROM (SELECT p, q FROM range({n}) s(p), range({n} + 1) t(q)) LEFT JOIN g USING (p, q) GROUP BY p),
  gj(k, m) AS (SELECT 0, list(r ORDER BY p) FROM rows_
    UNION ALL SELECT k + 1, list_transform(m, lambda r, pos: CASE WHEN pos = k + 1 THEN list_transform(r, lambda e: e / r[k + 1])
      ELSE list_transform(r, lambda e, c: e - r[k + 1] / m[k + 1][k + 1] * m[k + 1][c]) END) FROM gj WHERE k < {n}),
  z AS (SELECT (c - 1)::BIGINT AS j, m[c][{n} + 1] AS x FROM gj, range(1, {n} + 1) t(c) WHERE k = {n})"""


# Cholesky, LU and their solves


@query(SEVENS)
def chol_solve_grid(spark, sf_dir):
    """x of GRID x = b by Cholesky, pivots of least degree first."""
    a = grid(spark, sf_dir)
    return rounded(factors.chol_solve(a, products.spmv(a, sevens(spark, _side(spark, sf_dir) ** 2))))


@query(f"SELECT i, j, v FROM ({GRID})")
def chol_ordered_reconstruct(spark, sf_dir):
    """L Lᵀ of GRID in an order of little fill; fill that cancels is dropped."""
    order, low = factors.cholesky_ordered(grid(spark, sf_dir))
    # columns by their steps, so that those of a front lie together
    low = low.join(order.select("k", F.col("at").alias("j")), "j").select("i", F.col("k").alias("j"), "v")
    return maintain.dropzeros(rounded(products.gram(low)))


@query(SEVENS)
def lu_solve_skew(spark, sf_dir):
    """x of SKEW x = b by LU with pivots by size, refined once."""
    a = skew(spark, sf_dir)
    return rounded(factors.lu_solve(a, products.spmv(a, sevens(spark, _side(spark, sf_dir) ** 2)), refine=1))


@query(SEVENS)
def lu_tsolve_skew(spark, sf_dir):
    """x of Dᵀ x = b for GRID with its lower half weakened."""
    weak = F.when(F.col("i") > F.col("j"), 0.5).otherwise(1.0)
    a = grid(spark, sf_dir).withColumn("v", F.col("v") * weak)
    return rounded(factors.lu_solve_transposed(a, products.spmv_t(a, sevens(spark, _side(spark, sf_dir) ** 2))))


@query(f"SELECT i, j, round(v * CASE WHEN i > j THEN 0.5 ELSE 1 END, 6) v FROM ({GRID})")
def lu_pivots_reconstruct(spark, sf_dir):
    """L U of SKEW with pivots by size, its rows scaled back."""
    _, low, up = factors.lu(skew(spark, sf_dir))
    found = products.spgemm_near(low, up).select("i", "j", (F.col("v") / _heavy()).alias("v"))
    return maintain.dropzeros(rounded(found))


@query(f"SELECT i, j, round(v, 4) v FROM ({FLOW}) UNION ALL SELECT i + 25, j, round(2 * v, 4) FROM ({FLOW})")
def lu_rectangular_reconstruct(spark, sf_dir):
    """L U of FLOW on top of twice FLOW: 50 x 25, of rank 25 at most."""
    a = flow(spark, sf_dir)
    _, low, up = factors.lu(shape.vstack(a, a.withColumn("v", 2 * F.col("v")), 25))
    return maintain.dropzeros(rounded(products.spgemm(low, up), 4))


@query(f"SELECT i, j, v FROM ({NET})")
def icholt_reconstruct(spark, sf_dir):
    """L Lᵀ of NET where no entry is small enough to drop."""
    low = factors.incomplete_cholesky_threshold(network(spark, sf_dir), 1e-9)
    return maintain.dropzeros(rounded(products.spgemm(low, shape.transpose(low))))


@query(f"SELECT i, j, v FROM ({NET})")
def ilutp_reconstruct(spark, sf_dir):
    """L U of NET with pivots by size where no entry is small enough to drop."""
    _, low, up = factors.incomplete_lu_threshold(network(spark, sf_dir), 1e-9)
    return maintain.dropzeros(rounded(products.spgemm(low, up)))


@query(f"SELECT 1.0::DOUBLE AS inverse_norm, round((SELECT max(s) FROM (SELECT sum(abs(v)) s FROM ({GRID}) GROUP BY j)), 6) AS condition")
def condition_grid(spark, sf_dir):
    """The 1-norm of GRID's inverse, which has no negative entry and row sums of one, and GRID's condition."""
    a, n = settle(grid(spark, sf_dir)), _side(spark, sf_dir) ** 2
    inverse = factors.inverse_norm1(a, n)
    return structure.norm1(a).select(F.round(F.lit(inverse), 6).alias("inverse_norm"), F.round(F.col("v") * inverse, 6).alias("condition"))


@query(SEVENS)
def rechol_solve(spark, sf_dir):
    """x of A x = b for GRID + 2 I, by the pivots that GRID was factored with."""
    a, n = settle(grid(spark, sf_dir)), _side(spark, sf_dir) ** 2
    more = a.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 2.0).otherwise(0.0))
    return rounded(factors.solve_with(factors.refactor(factors.plan_cholesky(a), more), products.spmv(more, sevens(spark, n))))


@query(SEVENS)
def relu_solve(spark, sf_dir):
    """x of Aᵀ-weakened GRID by the pivots that SKEW was factored with."""
    a, n = settle(skew(spark, sf_dir)), _side(spark, sf_dir) ** 2
    other = grid(spark, sf_dir).withColumn("v", F.col("v") * F.when(F.col("i") < F.col("j"), 0.5).otherwise(1.0))
    return rounded(factors.solve_with(factors.refactor(factors.plan_lu(a), other), products.spmv(other, sevens(spark, n))))


@query(f"""SELECT node, n, coalesce(sum(n) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM (SELECT k::BIGINT node, (1 + count(j))::BIGINT n FROM range({S} + 30) t(k) LEFT JOIN ({FILL}) ON j = k GROUP BY k)""")
def schol_columns(spark, sf_dir):
    """Entries and starts of the columns of NET's factor, before it is computed."""
    return symbolic.symbolic_cholesky(network(spark, sf_dir), table(spark, sf_dir, "supplier").count() + 30).columns.select("node", "n", "start")


# Orthogonal factors


@query(f"WITH RECURSIVE {normal_equations(OL, OB, 7)} SELECT j AS i, round(x, 8) AS v FROM z")
def qr_solve_lines(spark, sf_dir):
    """Least squares of the orders' numbers modulo 11 by the quantities of their lines."""
    return rounded(orthogonal.least_squares(order_lines(spark, sf_dir), order_priorities(spark, sf_dir)), 8)


@query(f"WITH RECURSIVE {normal_equations(EMB, 'SELECT vec_id i, (vec_id % 10)::DOUBLE v FROM embeddings', 64)} SELECT j AS i, round(x, 5) AS v FROM z")
def qr_solve_embeddings(spark, sf_dir):
    """Least squares of 64 columns, in panels of 24."""
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), (F.col("vec_id") % 10).cast("double").alias("v"))
    return rounded(orthogonal.least_squares(embeddings(spark, sf_dir), b, panel=24, block=1 << 14), 5)


@query(f"""WITH RECURSIVE {normal_equations(OL, f"SELECT i, 1.0 AS v FROM ({OL}) GROUP BY i", 7)}
SELECT (j + 7 * t)::BIGINT AS i, round(x * (t + 1) / 5, 8) AS v FROM z, range(2) t(t)""")
def qr_least_norm_deficient(spark, sf_dir):
    """Least squares of ones by OL beside twice OL, 14 columns of rank 7: the solution of least norm."""
    a = settle(order_lines(spark, sf_dir))
    twice = shape.hstack(a, a.withColumn("v", 2 * F.col("v")), 7)
    return rounded(orthogonal.least_squares(twice, dealt(a.select("i"), a.count(), "i").distinct().withColumn("v", F.lit(1.0))), 8)


@query(f"""WITH RECURSIVE m AS (SELECT * FROM ({OL})), w AS (SELECT j::BIGINT AS j, (j + 1)::DOUBLE AS c FROM range(7) t(j)),
  g AS (SELECT x.j AS p, y.j AS q, sum(x.v * y.v) AS v FROM m x JOIN m y USING (i) GROUP BY 1, 2 UNION ALL SELECT j, 7, c FROM w),
  rows_ AS (SELECT p, list(coalesce(v, 0.0) ORDER BY q) AS r FROM (SELECT p, q FROM range(7) s(p), range(8) t(q)) LEFT JOIN g USING (p, q) GROUP BY p),
  gj(k, m) AS (SELECT 0, list(r ORDER BY p) FROM rows_
    UNION ALL SELECT k + 1, list_transform(m, lambda r, pos: CASE WHEN pos = k + 1 THEN list_transform(r, lambda e: e / r[k + 1])
      ELSE list_transform(r, lambda e, c: e - r[k + 1] / m[k + 1][k + 1] * m[k + 1][c]) END) FROM gj WHERE k < 7),
  z AS (SELECT (c - 1)::BIGINT AS j, gj.m[c][8] AS x FROM gj, range(1, 8) t(c) WHERE k = 7)
SELECT * FROM (SELECT i, round(sum(v * x), 9) + 0.0 AS v FROM m JOIN z USING (j) GROUP BY i) WHERE v <> 0""")
def qr_least_norm_wide(spark, sf_dir):
    """The solution of least norm of OLᵀ x = (1, .. 7)."""
    c = spark.range(7).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v"))
    return rounded(orthogonal.least_squares(shape.transpose(order_lines(spark, sf_dir)), c), 9).where("v <> 0")


@query(f"WITH a AS ({EMB}) SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 6) AS v FROM a x JOIN a y USING (i) GROUP BY 1, 2")
def qr_reconstruct(spark, sf_dir):
    """Rᵀ R of the embeddings in panels of 24 columns: their Gram matrix."""
    r = orthogonal.qr(embeddings(spark, sf_dir), panel=24, block=1 << 14).r.select(F.col("k").alias("i"), "j", "v")
    return rounded(products.spgemm(shape.transpose(r), r))


@query("SELECT o_orderkey AS i, (o_orderkey % 11 + 1)::DOUBLE AS v FROM orders")
def qr_apply_q(spark, sf_dir):
    """Q (Qᵀ b) for the factors of OL."""
    f = orthogonal.qr(order_lines(spark, sf_dir))
    return rounded(f.q(f.qt(order_priorities(spark, sf_dir).withColumn("k", F.lit(0)))).select("i", "v"))


@query("""WITH t AS (SELECT sum((p_partkey + 1.0) * p_size)::DOUBLE d FROM part)
SELECT p_partkey i, round((p_partkey + 1)::DOUBLE - 0.01 * p_size * d, 6) v FROM part, t""")
def reflection(spark, sf_dir):
    """x - beta v (vᵀ x) for the vector of sizes."""
    return rounded(orthogonal.reflected(parts_vector(spark, sf_dir), 0.01, ramp(table(spark, sf_dir, "part"), "p_partkey")))


# Symbolic counts, triangles and block forms


@query(f"""WITH RECURSIVE a AS (SELECT i, j FROM ({RING})), e AS (SELECT DISTINCT x.j AS p, y.j AS q FROM a x JOIN a y USING (i) WHERE x.j < y.j),
  elim(k, s) AS (SELECT 0::BIGINT, (SELECT list({{'p': p, 'q': q}}) FROM e)
    UNION ALL SELECT k + 1, list_distinct(list_concat(s, flatten(list_transform(list_filter(s, lambda x: x.p = k), lambda x:
      list_transform(list_filter(s, lambda y: y.p = k AND y.q > x.q), lambda y: {{'p': x.q, 'q': y.q}}))))) FROM elim WHERE k < {S} + 30),
  low AS (SELECT x.p, x.q FROM (SELECT unnest(s) AS x FROM elim WHERE k = {S} + 30))
SELECT k::BIGINT AS node, coalesce(min(q), -1)::BIGINT AS parent, (1 + count(q))::BIGINT AS n FROM range({S} + 30) t(k) LEFT JOIN low ON p = k GROUP BY k""")
def normal_tree_counts(spark, sf_dir):
    """Elimination tree and column counts of AᵀA for RING, from a star of its rows."""
    n = table(spark, sf_dir, "supplier").count() + 30
    found = trees.normal_counts(ring(spark, sf_dir), n)
    return found.select("node", "parent", F.col("r").alias("n"))


@query(KNOWN)
def tri_solve_permuted(spark, sf_dir):
    """x of P L Q x = b for the lower triangle of NET, its orders found by peeling."""
    n = table(spark, sf_dir, "supplier").count() + 30
    back = vectors.randperm(spark, n, -1)
    turned = spark.range(n).select(F.col("id").alias("k"), ((F.col("id") + 3) % n).alias("at"))
    mixed = settle(shape.permute(maintain.tril(network(spark, sf_dir)), back, turned))
    b = products.spmv(mixed, ramp(spark.range(n))).withColumn("k", F.lit(0))
    return rounded(triangular.solve_permuted(mixed, b).select("i", "v"))


@query(KNOWN)
def lsolve_cols_knownx(spark, sf_dir):
    """x of L Q x = b for the lower triangle of NET with its columns in reverse order."""
    n = table(spark, sf_dir, "supplier").count() + 30
    low = maintain.tril(network(spark, sf_dir)).select("i", (n - 1 - F.col("j")).alias("j"), "v")
    b = products.spmv(low, ramp(spark.range(n))).withColumn("k", F.lit(0))
    return rounded(triangular.solve_column_permuted(low, b).select("i", "v"))


@query(f"""WITH RECURSIVE p(node) AS (SELECT 0::BIGINT UNION SELECT i FROM ({NET}) a JOIN p ON a.j = p.node WHERE i > j)
SELECT node AS i, 0::BIGINT AS bad FROM p""")
def spsolve_sparse_rhs(spark, sf_dir):
    """L x = e0 for the lower triangle of NET: the rows that are solved for, and those where L x is not e0."""
    low = settle(maintain.tril(network(spark, sf_dir)))
    x = settle(triangular.solve_sparse(low, spark.createDataFrame([(0, 0, 1.0)], "i long, k int, v double")))
    off = products.spmv(low, x.select("i", "v")).select("i", (F.abs(F.col("v") - F.when(F.col("i") == 0, 1.0).otherwise(0.0)) > 1e-9).cast("long").alias("bad"))
    return x.select("i").join(off, "i", "left").select("i", F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))


@query(f"""SELECT s_suppkey::BIGINT AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey)::BIGINT AS label, 2 AS part, 0::BIGINT AS below FROM supplier
UNION ALL SELECT k, k, 2, 0 FROM range({S}, {S} + 30) t(k)""")
def fine_blocks(spark, sf_dir):
    """The blocks of RING + I with its rows reversed: the smallest column of each, and each column's entries below its block."""
    n = table(spark, sf_dir, "supplier").count() + 30
    a = ring(spark, sf_dir).select("i", "j").unionByName(spark.range(n).selectExpr("id as i", "id as j")).select((n - 1 - F.col("i")).alias("i"), "j")
    form = block_form.block_form(a, n, n)
    rows, cols = form.rows.select(F.col("at").alias("i"), F.col("block").alias("x")), form.cols.select(F.col("at").alias("j"), "part", F.col("block").alias("y"))
    label = cols.groupBy("y").agg(F.min("j").alias("label"))
    below = a.join(rows, "i").join(cols, "j").groupBy("j").agg(F.count_if(F.col("x") > F.col("y")).alias("below"))
    return cols.join(label, "y").join(below, "j").select(F.col("j").alias("node"), "label", "part", "below")


@query(KNOWN)
def block_form_knownx(spark, sf_dir):
    """x of A x = b for RING + 3 I with its rows reversed, which has zeros on its diagonal."""
    n = table(spark, sf_dir, "supplier").count() + 30
    a = ring(spark, sf_dir).unionByName(spark.range(n).selectExpr("id as i", "id as j", "3.0D as v")).select((n - 1 - F.col("i")).alias("i"), "j", "v")
    return rounded(block_form.solve_by_form(a, products.spmv(a, ramp(spark.range(n))), n, n))


# Orders


@query(f"SELECT 0::BIGINT AS across, ({K} * {K})::BIGINT AS n, TRUE AS small")
def dissection_grid(spark, sf_dir):
    """Nested dissection of the k x k GRID: edges past a separator, nodes in the order, and whether the first separator has at most 3 k nodes.

    A task may hold a third of the nodes, so the upper levels run over all parts at once.
    """
    k = _side(spark, sf_dir)
    edges, n = grid_edges(spark, sf_dir)
    graph = settle(shape.make_symmetric(edges.select("i", "j", F.col("w").alias("v"))).select("i", "j"))
    found = settle(dissection.separators(graph, spark.range(n).withColumnRenamed("id", "node"), fits=max(16, n // 3)))
    # an edge leads between a part and what separates it from others, or inside it
    path = lambda c, name: found.select(F.col("node").alias(c), F.regexp_replace("path", "2$", "").alias(name))
    across = graph.join(path("i", "a"), "i").join(path("j", "b"), "j").where("not startswith(a, b) and not startswith(b, a)").agg(F.count("*").alias("across"))
    counts = dissection.numbered(found, ["path", "place", "node"]).agg(F.count_distinct("at").alias("n"))
    top = found.agg((F.count_if(F.col("path") == "2") <= 3 * k).alias("small"))
    return across.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(top))  # one row each


FLOWGRAPH = f"SELECT i, j, sum(v) v FROM (SELECT i, j, v FROM ({FLOW}) UNION ALL SELECT j, i, v FROM ({FLOW})) WHERE i <> j GROUP BY 1, 2"


@query(f"""WITH RECURSIVE w AS ({FLOWGRAPH}), node AS (SELECT i, row_number() OVER (ORDER BY i) AS r, count(*) OVER () AS n, d FROM (SELECT i, sum(v) AS d FROM w GROUP BY i)),
  top AS (SELECT 2 * max(d) AS t FROM node),
  m AS (SELECT x.r, list((CASE WHEN x.r = y.r THEN t - x.d ELSE coalesce(w.v, 0) END - t / x.n) / t ORDER BY y.r) AS row_
        FROM node x, node y, top LEFT JOIN w ON w.i = x.i AND w.j = y.i GROUP BY x.r),
  sq(k, a) AS (SELECT 0, list(row_ ORDER BY r) FROM m
    UNION ALL SELECT k + 1, list_transform(b, lambda r: list_transform(r, lambda e: e / f)) FROM (
      SELECT k, b, sqrt(list_sum(list_transform(b, lambda r: list_dot_product(r, r)))) AS f FROM (
        SELECT k, list_transform(a, lambda r: list_transform(a, lambda c: list_dot_product(r, c))) AS b FROM sq WHERE k < 16))),
  vec AS (SELECT list_transform(a, lambda r: r[1]) AS x FROM sq WHERE k = 16),
  e AS (SELECT unnest(x) AS x, generate_subscripts(x, 1) AS r FROM vec)
SELECT round((SELECT sum(w.v * (p.x - q.x) * (p.x - q.x)) / 2 FROM w JOIN node a ON a.i = w.i JOIN node b ON b.i = w.j JOIN e p ON p.r = a.r JOIN e q ON q.r = b.r)
             / (SELECT sum(x * x) FROM e), 2) AS value, TRUE AS small""")
def fiedler_value(spark, sf_dir):
    """The second eigenvalue of the Laplacian of FLOW's graph, and whether the residual of its vector is small."""
    a = flow(spark, sf_dir)
    w = settle(maintain.sum_duplicates(a.unionByName(shape.transpose(a)).where("i <> j")))
    value, x = spectral.fiedler(w)
    off = products.add_vectors(products.spmv(spectral.laplacian(w), x), x, 1.0, -value)
    return off.agg(F.round(F.lit(value), 2).alias("value"), (F.max(F.abs("v")) < 1e-3 * value).alias("small")).select("value", "small")


# Dense columns and reversed order


@query(f"""SELECT i, k, sum(v) v FROM (SELECT a.i, k::BIGINT k, a.v * (CASE k WHEN 0 THEN a.j % 7 + 1 ELSE 1 END) v FROM ({GRID}) a, range(2) t(k)
  UNION ALL SELECT i, 0, v FROM ({SEVENS}) UNION ALL SELECT i, 1, v FROM ({SEVENS})) GROUP BY 1, 2""")
def gaxpy_columns(spark, sf_dir):
    """GRID X + Y for two dense columns."""
    x = sevens(spark, _side(spark, sf_dir) ** 2)
    two = lambda a, b: a.withColumn("k", F.lit(0).cast("long")).unionByName(b.withColumn("k", F.lit(1).cast("long")))
    return products.gaxpy_columns(grid(spark, sf_dir), two(x, x.withColumn("v", F.lit(1.0))), two(x, x))


@query(f"""SELECT i, k, sum(v) v FROM (SELECT a.j i, k::BIGINT k, a.v * CASE WHEN a.i > a.j THEN 0.5 ELSE 1 END * (CASE k WHEN 0 THEN a.i % 7 + 1 ELSE 1 END) v FROM ({GRID}) a, range(2) t(k)
  UNION ALL SELECT i, 0, v FROM ({SEVENS}) UNION ALL SELECT i, 1, v FROM ({SEVENS})) GROUP BY 1, 2""")
def gatxpy_columns(spark, sf_dir):
    """Aᵀ X + Y for GRID with its lower half weakened and two dense columns."""
    x = sevens(spark, _side(spark, sf_dir) ** 2)
    two = lambda a, b: a.withColumn("k", F.lit(0).cast("long")).unionByName(b.withColumn("k", F.lit(1).cast("long")))
    a = grid(spark, sf_dir).withColumn("v", F.col("v") * F.when(F.col("i") > F.col("j"), 0.5).otherwise(1.0))
    return products.gatxpy_columns(a, two(x, x.withColumn("v", F.lit(1.0))), two(x, x))
