"""Registered queries over the driver tables, with their DuckDB SQL.

Three matrices recur. SP: quantity by supplier (rows) and part (columns). NET:
the positive definite Laplacian + I of suppliers - nations - regions, the
regions in a ring. RING: a directed graph, the suppliers of each nation in a
ring that leads to the nation and on to its region.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ijvory.operators import access, blocks, factors, graphs, maintain, orderings, products, shape, structure, trees, triangular, vectors
from ijvory.operators.rounds import afresh, dealt, shared_folder
from ijvory.plans import by_blocks, solver
from ijvory.sources import triplets
from ijvory.streaming import deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register the decorated ``(spark, sf_dir)`` function under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# The matrices


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier and part as they come, with duplicates."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))


def supplier_part(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """Quantity by supplier (rows) and part (columns), duplicates summed; only of one return flag if given."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.count()
    t = t if flag is None else t.where(F.col("l_returnflag") == flag)
    cells = t.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return maintain.sum_duplicates(dealt(cells, rows, "i", "j"))


def network_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Undirected edges ``(i, j)``, i < j, and the number of nodes: suppliers, then 25 nations, then 5 regions."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    n = supplier.count()
    up = supplier.select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + n).alias("j"))
    on = nation.select((F.col("n_nationkey") + n).cast("long").alias("i"), (F.col("n_regionkey") + n + 25).alias("j"))
    ring = spark.range(5).select((F.col("id") + n + 25).alias("a"), ((F.col("id") + 1) % 5 + n + 25).alias("b"))
    ring = ring.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return up.unionByName(on).unionByName(ring), n + 30


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NET."""
    edges, n = network_edges(spark, sf_dir)
    both = shape.make_symmetric(edges.withColumn("v", F.lit(-1.0)))
    degree = both.groupBy("j").agg(F.count("*").alias("d"))
    diag = spark.range(n).join(degree, F.col("id") == F.col("j"), "left").select(F.col("id").alias("i"), F.col("id").alias("j"), (F.coalesce("d", F.lit(0)) + 1.0).alias("v"))
    return both.unionByName(diag)


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RING; edges lead from j to i."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    n = supplier.count()
    own = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    round_ = supplier.select(F.col("s_suppkey").alias("j"), F.coalesce(F.lead("s_suppkey").over(own), first).alias("i"))
    up = supplier.select(F.col("s_suppkey").alias("j"), (F.col("s_nationkey") + n).alias("i"))
    on = nation.select((F.col("n_nationkey") + n).cast("long").alias("j"), (F.col("n_regionkey") + n + 25).alias("i"))
    return round_.where("i <> j").unionByName(up).unionByName(on).select("i", "j", F.lit(1.0).alias("v"))


def ramp(df: DataFrame, name: str = "id") -> DataFrame:
    """The vector (1, 2, 3, ...) on the indices of a column."""
    return df.select(F.col(name).cast("long").alias("i"), (F.col(name) + 1).cast("double").alias("v"))


def parts_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))


def suppliers_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1).cast("double").alias("v"))


def reverse(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return vectors.randperm(spark, table(spark, sf_dir, name).count(), -1)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``v`` to some digits, with no negative zero."""
    return df.withColumn("v", F.round("v", digits) + 0.0)


S = "(SELECT count(*) FROM supplier)"
P = "(SELECT count(*) FROM part)"
SP = "SELECT l_suppkey i, l_partkey j, sum(l_quantity) v FROM lineitem GROUP BY 1, 2"
XP = "SELECT p_partkey i, p_size::DOUBLE v FROM part"
XS = "SELECT s_suppkey i, (s_nationkey + 1)::DOUBLE v FROM supplier"
EDGES = f"""SELECT s_suppkey i, s_nationkey + {S} j FROM supplier
  UNION ALL SELECT n_nationkey + {S}, n_regionkey + {S} + 25 FROM nation
  UNION ALL SELECT least(r, (r + 1) % 5) + {S} + 25, greatest(r, (r + 1) % 5) + {S} + 25 FROM range(5) t(r)"""
NET = f"""SELECT i, j, v FROM (
  WITH e AS ({EDGES}), b AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e)
  SELECT i, j, -1.0::DOUBLE v FROM b
  UNION ALL SELECT k, k, (1 + (SELECT count(*) FROM b WHERE b.j = k))::DOUBLE FROM range({S} + 30) t(k))"""
RING = f"""SELECT i, j FROM (
  SELECT coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), min(s_suppkey) OVER (PARTITION BY s_nationkey)) i, s_suppkey j FROM supplier)
  WHERE i <> j
  UNION ALL SELECT s_nationkey + {S}, s_suppkey FROM supplier UNION ALL SELECT n_regionkey + {S} + 25, n_nationkey + {S} FROM nation"""
#: Parents in the elimination tree of NET: the ring of regions fills up as a path.
TREE = f"""SELECT s_suppkey::BIGINT node, (s_nationkey + {S})::BIGINT parent FROM supplier
  UNION ALL SELECT n_nationkey + {S}, n_regionkey + {S} + 25 FROM nation
  UNION ALL SELECT r + {S} + 25, CASE WHEN r < 4 THEN r + {S} + 26 ELSE -1 END FROM range(5) t(r)"""
#: The strict lower pattern of NET's factor.
FILL = f"""SELECT DISTINCT i, j FROM (
  SELECT parent i, node j FROM ({TREE}) WHERE parent >= 0 UNION ALL SELECT {S} + 29, {S} + 25 + r FROM range(4) t(r))"""
KNOWN = f"SELECT k::BIGINT i, (k + 1)::DOUBLE v FROM range({S} + 30) t(k)"


# Sources and canonical form


@query("SELECT l_suppkey i, l_partkey j, sum(l_quantity) v FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0")
def coo_compress_dedup(spark, sf_dir):
    """Triplets with duplicates to canonical form."""
    return maintain.to_canonical(lines(spark, sf_dir))


@query(f"""SELECT j::BIGINT j, coalesce(sum(n) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT p
FROM range({P} + 1) t(j) LEFT JOIN (SELECT j, count(*) n FROM ({SP}) GROUP BY j) USING (j)""")
def csc_colptr_window(spark, sf_dir):
    """Column pointers."""
    return maintain.column_pointers(supplier_part(spark, sf_dir), table(spark, sf_dir, "part").count())


@query("""SELECT i::BIGINT i, (k - 1)::BIGINT j, e[k]::DOUBLE v FROM (
  SELECT c_custkey i, [c_nationkey::DOUBLE, c_acctbal, 0.0] e FROM customer), range(1, 4) t(k) WHERE e[k] <> 0""")
def dense_to_sparse(spark, sf_dir):
    """The nonzeros of dense rows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("double"), "c_acctbal", F.lit(0.0)).alias("e"))
    return triplets.from_dense(rows, "c_custkey", "e")


@query(SP)
def packed_round_trip(spark, sf_dir):
    """Packed columns and back."""
    return triplets.from_columns(triplets.to_columns(supplier_part(spark, sf_dir)))


@query("SELECT l_suppkey i, l_partkey j, l_quantity v FROM lineitem")
def text_round_trip(spark, sf_dir):
    """Triplets as lines of text, parsed."""
    return triplets.parse_triplets(lines(spark, sf_dir).select(F.concat_ws("  ", "i", "j", "v").alias("value")))


@query(f"SELECT count(*) FILTER (i < 0)::BIGINT out_of_bounds, 0::BIGINT zeros, (count(*) - count(DISTINCT (i, j)))::BIGINT duplicates FROM (SELECT l_suppkey i, l_partkey j FROM lineitem)")
def matrix_faults(spark, sf_dir):
    """Entries out of bounds, zeros and duplicates."""
    return maintain.faults(lines(spark, sf_dir), table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count())


# Access


@query(f"SELECT coalesce(sum(v), 0)::DOUBLE v FROM ({SP}) WHERE i = 1 AND j = 1")
def cell_value(spark, sf_dir):
    return access.value(lines(spark, sf_dir), 1, 1)


@query(f"SELECT i, sum(v) v FROM ({SP}) WHERE j = 1 GROUP BY i")
def one_column(spark, sf_dir):
    return access.column(lines(spark, sf_dir), 1)


@query(f"""WITH a AS ({SP}), c AS (SELECT l_suppkey i, l_partkey j, sum(l_quantity) v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
  p AS (SELECT {S} - 1 - i AS i, {P} - 1 - j AS j, v FROM c)
SELECT i, j, v FROM p UNION ALL SELECT i, j, v FROM a ANTI JOIN p USING (i, j)""")
def assign_sparse(spark, sf_dir):
    """Returned quantities written over the mirrored cells."""
    rows, cols = reverse(spark, sf_dir, "supplier"), reverse(spark, sf_dir, "part")
    return access.assign_at(supplier_part(spark, sf_dir), rows, cols, supplier_part(spark, sf_dir, "R"), table(spark, sf_dir, "lineitem").count())


@query("""SELECT l_suppkey i, l_partkey j, sum(l_quantity) - coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) v FROM lineitem GROUP BY 1, 2""")
def update_cells(spark, sf_dir):
    """Returned quantities taken off, cell by cell."""
    return access.update(supplier_part(spark, sf_dir), supplier_part(spark, sf_dir, "R"), lambda old, new: old - new)


# Filters, predicates and reductions


@query(f"SELECT i, j, v FROM ({SP}) WHERE j - i BETWEEN -3 AND 40")
def band(spark, sf_dir):
    return maintain.band(supplier_part(spark, sf_dir), -3, 40)


@query(f"SELECT i, j, v FROM ({SP}) WHERE i >= j")
def tril(spark, sf_dir):
    return maintain.tril(supplier_part(spark, sf_dir))


@query(f"SELECT i, j, v FROM ({SP}) WHERE i <= j")
def triu(spark, sf_dir):
    return maintain.triu(supplier_part(spark, sf_dir))


@query(f"SELECT i, j, v FROM ({SP}) WHERE abs(v) > 40")
def droptol(spark, sf_dir):
    return maintain.droptol(supplier_part(spark, sf_dir), 40.0)


@query(f"""SELECT k::BIGINT i, coalesce(v, 0)::DOUBLE v FROM range(greatest(0, least({S}, {P}) - 2)) t(k)
LEFT JOIN (SELECT i, v FROM ({SP}) WHERE j - i = 2) ON i = k""")
def diagonal_k(spark, sf_dir):
    """The second diagonal above the main one."""
    return structure.diagonal(supplier_part(spark, sf_dir), table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count(), 2)


def _three(spark, sf_dir) -> dict[str, DataFrame]:
    """NET, its lower triangle and RING, by name."""
    net = network(spark, sf_dir)
    return {"net": net, "low": maintain.tril(net), "up": maintain.triu(net), "ring": ring(spark, sf_dir)}


def _each(matrices: dict[str, DataFrame], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = None
    for name, a in matrices.items():
        one = f(a).withColumn("matrix", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


THREE = f"""SELECT 'net' AS matrix, i, j, v FROM ({NET}) UNION ALL SELECT 'low', i, j, v FROM ({NET}) WHERE i >= j
  UNION ALL SELECT 'up', i, j, v FROM ({NET}) WHERE i <= j UNION ALL SELECT 'ring', i, j, 1.0 FROM ({RING})"""


@query(f"""WITH m AS ({THREE}) SELECT a.matrix, bool_and(b.v IS NOT DISTINCT FROM a.v) AS flag
FROM m a LEFT JOIN m b ON b.matrix = a.matrix AND b.i = a.j AND b.j = a.i GROUP BY 1""")
def is_symmetric(spark, sf_dir):
    """Whether NET, its triangles and RING are symmetric."""
    return _each(_three(spark, sf_dir), structure.is_symmetric)


@query(f"SELECT matrix, CASE WHEN bool_and(i <= j) THEN 1 WHEN bool_and(i >= j) THEN -1 ELSE 0 END AS kind FROM ({THREE}) GROUP BY 1")
def is_triangular(spark, sf_dir):
    """The kinds of NET, its triangles and RING."""
    return _each(_three(spark, sf_dir), structure.is_triangular)


@query(f"""WITH a AS ({RING}) SELECT count(*) FILTER (EXISTS (SELECT 1 FROM a b WHERE b.i = a.j AND b.j = a.i))::DOUBLE / count(*) v FROM a""")
def structural_symmetry(spark, sf_dir):
    """The share of RING's edges that have their mirror."""
    return structure.structural_symmetry(ring(spark, sf_dir))


@query(f"SELECT max(s)::DOUBLE v FROM (SELECT sum(abs(v)) s FROM ({SP}) GROUP BY j)")
def norm1(spark, sf_dir):
    return structure.norm1(supplier_part(spark, sf_dir))


@query(f"SELECT sqrt(sum(v * v)) v FROM ({SP})")
def fronorm(spark, sf_dir):
    return structure.fronorm(supplier_part(spark, sf_dir))


@query(f"SELECT k::BIGINT i, coalesce(v, 0)::DOUBLE v FROM range({S}) t(k) LEFT JOIN (SELECT i, sum(v) v FROM ({SP}) GROUP BY i) ON i = k")
def row_sums(spark, sf_dir):
    return structure.row_sums(supplier_part(spark, sf_dir), table(spark, sf_dir, "supplier").count())


@query(f"SELECT k::BIGINT i, coalesce(v, 0)::DOUBLE v FROM range({P}) t(k) LEFT JOIN (SELECT j, sum(v) v FROM ({SP}) GROUP BY j) ON j = k")
def col_sums(spark, sf_dir):
    return structure.col_sums(supplier_part(spark, sf_dir), table(spark, sf_dir, "part").count())


@query(f"SELECT j, count(*) n FROM ({SP}) GROUP BY j")
def col_lengths(spark, sf_dir):
    return structure.col_lengths(supplier_part(spark, sf_dir))


@query(f"SELECT sum(j - m)::BIGINT profile, max(j - m)::BIGINT bandwidth FROM (SELECT j, min(i) m FROM ({NET}) GROUP BY j)")
def bandwidth_profile(spark, sf_dir):
    return structure.profile_and_bandwidth(network(spark, sf_dir), table(spark, sf_dir, "supplier").count() + 30)


@query(f"SELECT k::BIGINT i, coalesce(j, -1)::BIGINT j FROM range({S}) t(k) LEFT JOIN (SELECT i, min(j) j FROM ({SP}) GROUP BY i) ON i = k")
def leftmost(spark, sf_dir):
    return structure.leftmost(supplier_part(spark, sf_dir), table(spark, sf_dir, "supplier").count())


# Shape


@query(f"SELECT j AS i, i AS j, v FROM ({SP})")
def transpose(spark, sf_dir):
    return shape.transpose(supplier_part(spark, sf_dir))


@query("""SELECT l_suppkey i, l_partkey j, sum(CASE l_returnflag WHEN 'R' THEN 2 ELSE -3 END * l_quantity) v
FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2""")
def add_scaled(spark, sf_dir):
    return shape.add_scaled(supplier_part(spark, sf_dir, "R"), supplier_part(spark, sf_dir, "A"), 2.0, -3.0, table(spark, sf_dir, "lineitem").count())


@query(f"SELECT a.i, a.j, x.v * a.v * y.v AS v FROM ({SP}) a JOIN ({XS}) x ON x.i = a.i JOIN ({XP}) y ON y.i = a.j")
def scale_rc(spark, sf_dir):
    return shape.scale_rows_cols(supplier_part(spark, sf_dir), suppliers_vector(spark, sf_dir), parts_vector(spark, sf_dir))


@query("""SELECT l_suppkey i, l_partkey + CASE l_returnflag WHEN 'A' THEN (SELECT count(*) FROM part) ELSE 0 END j, sum(l_quantity) v
FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2""")
def hstack(spark, sf_dir):
    return shape.hstack(supplier_part(spark, sf_dir, "R"), supplier_part(spark, sf_dir, "A"), table(spark, sf_dir, "part").count())


@query("""SELECT l_suppkey + CASE l_returnflag WHEN 'A' THEN (SELECT count(*) FROM supplier) ELSE 0 END i, l_partkey j, sum(l_quantity) v
FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2""")
def vstack(spark, sf_dir):
    return shape.vstack(supplier_part(spark, sf_dir, "R"), supplier_part(spark, sf_dir, "A"), table(spark, sf_dir, "supplier").count())


@query(f"SELECT i - 2 AS i, j - 10 AS j, v FROM ({SP}) WHERE i >= 2 AND i < 8 AND j >= 10 AND j < 150")
def slice_window(spark, sf_dir):
    return shape.window(supplier_part(spark, sf_dir), 2, 8, 10, 150)


@query(f"SELECT {S} - 1 - i AS i, j, v FROM ({SP}) UNION ALL SELECT 2 * {S} - 1 - i, j, v FROM ({SP})")
def index_arbitrary(spark, sf_dir):
    """All rows in reverse order, twice."""
    back = reverse(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "supplier").count()
    twice = back.unionByName(back.withColumn("k", F.col("k") + n))
    same = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("at"))
    return shape.index(supplier_part(spark, sf_dir), twice, same)


@query(f"SELECT {S} - 1 - i AS i, {P} - 1 - j AS j, v FROM ({SP})")
def permute_rc(spark, sf_dir):
    return shape.permute(supplier_part(spark, sf_dir), reverse(spark, sf_dir, "supplier"), reverse(spark, sf_dir, "part"))


@query(f"SELECT {P} - 1 - j AS i, {S} - 1 - i AS j, v FROM ({SP})")
def permute_transpose(spark, sf_dir):
    return shape.permute_transpose(supplier_part(spark, sf_dir), reverse(spark, sf_dir, "part"), reverse(spark, sf_dir, "supplier"))


@query(f"SELECT {S} + 29 - j AS i, {S} + 29 - i AS j, v FROM ({NET}) WHERE i <= j")
def symperm(spark, sf_dir):
    net = network(spark, sf_dir)
    return shape.symperm(net, vectors.randperm(spark, table(spark, sf_dir, "supplier").count() + 30, -1))


@query(f"SELECT i + 3 AS i, j + 5 AS j, v FROM ({SP})")
def add_empty(spark, sf_dir):
    return shape.shifted(supplier_part(spark, sf_dir), 3, 5)


@query(f"SELECT i, j, v FROM ({NET})")
def make_sym(spark, sf_dir):
    """NET from its upper triangle."""
    return shape.make_symmetric(maintain.triu(network(spark, sf_dir)))


@query(f"""WITH a AS ({SP}) SELECT k::BIGINT i, k::BIGINT j, 1.0::DOUBLE v FROM range({S}) t(k)
UNION ALL SELECT i, j + {S}, v FROM a UNION ALL SELECT j + {S}, i, v FROM a""")
def augment(spark, sf_dir):
    return shape.augment(supplier_part(spark, sf_dir), table(spark, sf_dir, "supplier").count())


# Products and vectors


@query(f"SELECT a.i, sum(a.v * x.v) v FROM ({SP}) a JOIN ({XP}) x ON x.i = a.j GROUP BY 1")
def spmv(spark, sf_dir):
    return products.spmv(supplier_part(spark, sf_dir), parts_vector(spark, sf_dir))


@query(f"SELECT a.j AS i, sum(a.v * x.v) v FROM ({SP}) a JOIN ({XS}) x ON x.i = a.i GROUP BY 1")
def spmv_t(spark, sf_dir):
    return products.spmv_t(supplier_part(spark, sf_dir), suppliers_vector(spark, sf_dir))


@query(f"""SELECT i, sum(v) v FROM (SELECT a.i, a.v * x.v v FROM ({SP}) a JOIN ({XP}) x ON x.i = a.j UNION ALL {XS}) GROUP BY 1""")
def gaxpy(spark, sf_dir):
    return products.gaxpy(supplier_part(spark, sf_dir), parts_vector(spark, sf_dir), suppliers_vector(spark, sf_dir))


@query(f"""SELECT i, sum(v) v FROM (SELECT a.j i, a.v * x.v v FROM ({SP}) a JOIN ({XS}) x ON x.i = a.i UNION ALL {XP}) GROUP BY 1""")
def gatxpy(spark, sf_dir):
    return products.gatxpy(supplier_part(spark, sf_dir), suppliers_vector(spark, sf_dir), parts_vector(spark, sf_dir))


@query(f"SELECT i, sum(v) v FROM (SELECT a.i, a.v * (a.j + 1) v FROM ({NET}) a UNION ALL SELECT k, 1.0 FROM range({S} + 30) t(k)) GROUP BY 1")
def sym_gaxpy(spark, sf_dir):
    """NET x + y, from the upper triangle."""
    nodes = spark.range(table(spark, sf_dir, "supplier").count() + 30)
    return products.sym_gaxpy(maintain.triu(network(spark, sf_dir)), ramp(nodes), nodes.select(F.col("id").alias("i"), F.lit(1.0).alias("v")))


@query(f"""SELECT a.i, k::BIGINT k, sum(a.v * CASE k WHEN 0 THEN p_size ELSE 1 END)::DOUBLE v
FROM ({SP}) a JOIN part ON p_partkey = a.j, range(2) t(k) GROUP BY 1, 2""")
def spmm(spark, sf_dir):
    """A product with two dense columns."""
    x = parts_vector(spark, sf_dir)
    both = x.withColumn("k", F.lit(0).cast("long")).unionByName(x.select("i", F.lit(1.0).alias("v"), F.lit(1).cast("long").alias("k")))
    return products.spmm(supplier_part(spark, sf_dir), both)


@query(f"""
WITH a AS ({SP}),
     c AS (SELECT x.i, y.i AS j, sum(x.v * y.v) v FROM a x JOIN a y ON x.j = y.j GROUP BY 1, 2),
     n AS (SELECT max(s) nrm FROM (SELECT j, sum(abs(v)) s FROM c GROUP BY j)),
     e AS (SELECT DISTINCT i, i AS j FROM a)
SELECT i, j, sum(v) v FROM (SELECT * FROM c UNION ALL SELECT e.i, e.j, nrm FROM e, n) GROUP BY 1, 2""")
def spgemm_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D = A Aᵀ + ‖A Aᵀ‖₁ I for SP."""
    # sums of duplicates are part of the products' sums
    c = products.mirrored(afresh(products.gram_upper(lines(spark, sf_dir).withColumn("v", F.coalesce("v", F.lit(0.0))), table(spark, sf_dir, "lineitem").count())))
    shift = F.broadcast(structure.norm1(c).withColumnRenamed("v", "shift"))
    # a row with an entry has one on the diagonal of A Aᵀ
    return c.crossJoin(shift).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") + F.col("shift")).otherwise(F.col("v")).alias("v"))


@query(f"SELECT DISTINCT x.i, y.i AS j FROM ({SP}) x JOIN ({SP}) y ON x.j = y.j")
def spgemm_pattern(spark, sf_dir):
    return products.gram_pattern(lines(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


@query("SELECT sum((p_partkey + 1.0) * p_size)::DOUBLE v FROM part")
def vecdot(spark, sf_dir):
    return products.vecdot(ramp(table(spark, sf_dir, "part"), "p_partkey"), parts_vector(spark, sf_dir))


@query(f"""WITH a AS ({NET}), r AS (SELECT i, sum(v * (j + 1)) - 1 AS v FROM a GROUP BY i)
SELECT round((SELECT max(abs(v)) FROM r) / ((SELECT max(s) FROM (SELECT sum(abs(v)) s FROM a GROUP BY j)) * ({S} + 30) + 1), 9) v""")
def residual_norm(spark, sf_dir):
    """How far NET (1, 2, 3, ...) is from ones."""
    nodes = spark.range(table(spark, sf_dir, "supplier").count() + 30)
    ones = nodes.select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    return rounded(products.residual_norm(network(spark, sf_dir), ramp(nodes), ones), 9)


@query(f"""WITH x AS ({XP}) SELECT 0.0::DOUBLE ord, count(*) FILTER (abs(v) > 2.220446049250313e-16)::DOUBLE v FROM x
UNION ALL SELECT 1, sum(abs(v)) FROM x UNION ALL SELECT 2, round(sqrt(sum(v * v)), 9) FROM x
UNION ALL SELECT 3, round(pow(sum(pow(abs(v), 3)), 1 / 3::DOUBLE), 9) FROM x UNION ALL SELECT 'inf'::DOUBLE, max(abs(v)) FROM x""")
def vec_norms(spark, sf_dir):
    x, out = parts_vector(spark, sf_dir), None
    for order in (0.0, 1.0, 2.0, 3.0, float("inf")):
        one = rounded(vectors.norm(x, order).select(F.lit(order).alias("ord"), "v"), 9)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT {P} - 1 - i AS i, v FROM ({XP})")
def pvec(spark, sf_dir):
    return vectors.pvec(reverse(spark, sf_dir, "part"), parts_vector(spark, sf_dir))


@query(f"SELECT {P} - 1 - i AS i, v FROM ({XP})")
def ipvec(spark, sf_dir):
    return vectors.ipvec(reverse(spark, sf_dir, "part"), parts_vector(spark, sf_dir))


@query(f"SELECT ({P} - 1 - i)::BIGINT k, i::BIGINT AS at FROM range({P}) t(i)")
def inv_permute(spark, sf_dir):
    return vectors.inv_permute(reverse(spark, sf_dir, "part"))


@query("SELECT p_partkey i FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def argmaxabs(spark, sf_dir):
    return vectors.argmaxabs(parts_vector(spark, sf_dir))


@query(f"""WITH t AS (SELECT max(v) FILTER (i = 0) x0, sqrt(sum(v * v)) n FROM ({XP}))
SELECT round((-n - x0) / -n, 9) beta, round(-n, 6) s FROM t""")
def householder_col(spark, sf_dir):
    """The reflection of the vector of sizes."""
    return vectors.householder(parts_vector(spark, sf_dir)).select(F.round("beta", 9).alias("beta"), F.round("s", 6).alias("s"))


# Graphs and triangles


@query(f"""SELECT s_suppkey::BIGINT node, 0 AS level FROM supplier UNION ALL SELECT DISTINCT s_nationkey + {S}, 1 FROM supplier
UNION ALL SELECT DISTINCT n_regionkey + {S} + 25, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def bfs_levels(spark, sf_dir):
    """Steps from the suppliers in RING."""
    return graphs.bfs_levels(ring(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"""SELECT s_suppkey::BIGINT node FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 0)
UNION ALL SELECT s_nationkey + {S} FROM supplier WHERE s_suppkey = 0
UNION ALL SELECT n_regionkey + {S} + 25 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 0""")
def reach(spark, sf_dir):
    """What supplier 0 reaches in RING."""
    return graphs.reach(ring(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node"))


@query(f"""SELECT s_suppkey::BIGINT node, min(s_suppkey) OVER (PARTITION BY s_nationkey)::BIGINT AS label FROM supplier
UNION ALL SELECT k, k FROM range({S}, {S} + 30) t(k)""")
def scc_labels(spark, sf_dir):
    """Strong components of RING."""
    return graphs.strong_components(ring(spark, sf_dir), spark.range(table(spark, sf_dir, "supplier").count() + 30).withColumnRenamed("id", "node"))


@query(f"SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier)::BIGINT AS n, 0::BIGINT AS bad")
def matching_size(spark, sf_dir):
    """A maximum matching of suppliers and nations: its size, and pairs that are no entries or share a row or column."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("long").alias("j"))
    found = graphs.matching(a)
    counts = found.agg(F.count("*").alias("n"), F.count_distinct("i").alias("r"), F.count_distinct("j").alias("c"))
    wrong = found.join(a, ["i", "j"], "left_anti").agg(F.count("*").alias("w"))
    return counts.crossJoin(wrong).select("n", (2 * F.col("n") - F.col("r") - F.col("c") + F.col("w")).alias("bad"))


@query("""WITH n AS (SELECT s_nationkey AS nation, count(*) AS c FROM supplier GROUP BY 1)
SELECT 'row' AS side, s_suppkey::BIGINT AS node, CASE WHEN c > 1 THEN 3 ELSE 2 END AS part FROM supplier JOIN n ON nation = s_nationkey
UNION ALL SELECT 'col', nation, CASE WHEN c > 1 THEN 3 ELSE 2 END FROM n""")
def dm_coarse(spark, sf_dir):
    """The coarse parts of suppliers by nations."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("long").alias("j"))
    return graphs.coarse_parts(a, graphs.matching(a))


@query(f"SELECT i, j FROM ({RING}) UNION SELECT j, i FROM ({RING})")
def build_graph_apat(spark, sf_dir):
    return graphs.graph_of_sum(ring(spark, sf_dir))


@query(f"SELECT DISTINCT x.j AS i, y.j FROM ({RING}) x JOIN ({RING}) y ON x.i = y.i WHERE x.j <> y.j")
def build_graph_ata(spark, sf_dir):
    return graphs.graph_of_normal(ring(spark, sf_dir))


@query(f"""SELECT 'low' AS matrix, count(DISTINCT i) AS n FROM ({NET}) WHERE i >= j
UNION ALL SELECT 'net', count(*) FROM (SELECT i FROM ({NET}) GROUP BY i HAVING count(*) = 1)""")
def peel_triangular(spark, sf_dir):
    """Pairs peeled off the mixed-up lower triangle of NET, all of them, and off NET itself, which has no row of one entry."""
    back = vectors.randperm(spark, table(spark, sf_dir, "supplier").count() + 30, -1)
    mixed = {"low": shape.permute(maintain.tril(network(spark, sf_dir)), back), "net": shape.permute(network(spark, sf_dir), back)}
    return _each(mixed, lambda a: graphs.peel_triangular(a).agg(F.least(F.count_distinct("i"), F.count_distinct("j")).alias("n")))


def _known(spark, sf_dir) -> DataFrame:
    return ramp(spark.range(table(spark, sf_dir, "supplier").count() + 30))


def _one(b: DataFrame) -> DataFrame:
    return b.withColumn("k", F.lit(0))


@query(KNOWN)
def lsolve_knownx(spark, sf_dir):
    """x of L x = b for the lower triangle of NET."""
    low = maintain.tril(network(spark, sf_dir))
    return rounded(triangular.solve(low, _one(products.spmv(low, _known(spark, sf_dir)))).select("i", "v"))


@query(KNOWN)
def usolve_knownx(spark, sf_dir):
    """x of U x = b for the upper triangle of NET."""
    up = maintain.triu(network(spark, sf_dir))
    return rounded(triangular.solve(up, _one(products.spmv(up, _known(spark, sf_dir)))).select("i", "v"))


@query(KNOWN)
def ltsolve_knownx(spark, sf_dir):
    """x of Lᵀ x = b for the lower triangle of NET."""
    low = maintain.tril(network(spark, sf_dir))
    return rounded(triangular.solve_transposed(low, _one(products.spmv_t(low, _known(spark, sf_dir)))).select("i", "v"))


@query(KNOWN)
def lsolve_rows_knownx(spark, sf_dir):
    """The same with L's rows in reverse order."""
    mixed = shape.permute(maintain.tril(network(spark, sf_dir)), vectors.randperm(spark, table(spark, sf_dir, "supplier").count() + 30, -1))
    return rounded(triangular.solve_row_permuted(mixed, _one(products.spmv(mixed, _known(spark, sf_dir)))).select("i", "v"))


# Elimination trees and factors


def _net_tree(spark, sf_dir) -> DataFrame:
    return trees.etree(network(spark, sf_dir), table(spark, sf_dir, "supplier").count() + 30)


@query(TREE)
def etree(spark, sf_dir):
    """The elimination tree of NET."""
    return _net_tree(spark, sf_dir)


@query(f"""WITH RECURSIVE p AS ({TREE}), r(n, d) AS (SELECT node, 1 FROM p WHERE parent = -1 UNION ALL SELECT p.node, d + 1 FROM r JOIN p ON p.parent = r.n)
SELECT max(d)::BIGINT AS height FROM r""")
def etree_height(spark, sf_dir):
    return trees.height(_net_tree(spark, sf_dir))


@query(f"SELECT i AS k, j AS node FROM ({FILL})")
def ereach_all(spark, sf_dir):
    """The row patterns of NET's factor, by climbing the tree."""
    return trees.row_subtrees(network(spark, sf_dir), _net_tree(spark, sf_dir))


@query(f"SELECT k::BIGINT node, (1 + count(i))::BIGINT n FROM range({S} + 30) t(k) LEFT JOIN ({FILL}) ON i = k GROUP BY k")
def chol_rowcounts(spark, sf_dir):
    return trees.row_counts(network(spark, sf_dir), _net_tree(spark, sf_dir))


@query(f"SELECT k::BIGINT node, (1 + count(j))::BIGINT n FROM range({S} + 30) t(k) LEFT JOIN ({FILL}) ON j = k GROUP BY k")
def chol_colcounts(spark, sf_dir):
    return trees.column_counts(network(spark, sf_dir), _net_tree(spark, sf_dir))


@query(f"""WITH RECURSIVE p AS ({TREE}),
  r(node, path, level) AS (SELECT node, [node], 0 FROM p WHERE parent = -1
    UNION ALL SELECT p.node, list_append(r.path, p.node), level + 1 FROM r JOIN p ON p.parent = r.node),
  o AS (SELECT node, level, row_number() OVER (ORDER BY list_append(path, 9223372036854775807)) - 1 AS post, len(path) AS depth FROM r),
  sub AS (SELECT a.node, count(*) AS size FROM r a JOIN r b ON b.path[len(a.path)] = a.node GROUP BY 1)
SELECT node, post::BIGINT post, (post - size + 1)::BIGINT AS first, level::BIGINT AS level FROM o JOIN sub USING (node)""")
def postorder(spark, sf_dir):
    """Postorder and first descendants of the tree of NET."""
    return orderings.postorder(_net_tree(spark, sf_dir))


@query(f"""SELECT a.s_suppkey::BIGINT a, b.s_suppkey::BIGINT b, (CASE WHEN a.s_nationkey = b.s_nationkey THEN a.s_nationkey + {S}
  ELSE greatest(x.n_regionkey, y.n_regionkey) + {S} + 25 END)::BIGINT AS ancestor
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey""")
def common_ancestors(spark, sf_dir):
    """Where the paths of neighbouring suppliers to the root of NET's tree meet."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    pairs = s.join(s.select(F.col("a").alias("b")), "b", "left_semi")
    return orderings.common_ancestors(_net_tree(spark, sf_dir), pairs)


@query(f"SELECT i, j, v FROM ({NET})")
def chol_reconstruct(spark, sf_dir):
    """L Lᵀ of NET's factor; fill that cancels is dropped."""
    low = factors.cholesky(network(spark, sf_dir))
    return maintain.dropzeros(rounded(products.spgemm(low, shape.transpose(low))))


@query(f"SELECT i, j, v FROM ({NET})")
def lu_reconstruct(spark, sf_dir):
    """L U of NET's factors."""
    both = factors.lu_no_pivots(network(spark, sf_dir))
    return maintain.dropzeros(rounded(products.spgemm(factors.lower_of(both), factors.upper_of(both))))


@query(f"SELECT i, j, v FROM ({NET})")
def ichol_nofill(spark, sf_dir):
    """The incomplete factor's product on the pattern of NET, where it equals NET."""
    net = network(spark, sf_dir)
    low = factors.incomplete_cholesky(net)
    return rounded(products.spgemm(low, shape.transpose(low)).join(net.select("i", "j"), ["i", "j"], "left_semi"))


@query(f"SELECT i, j, v FROM ({NET})")
def ilu_nofill(spark, sf_dir):
    net = network(spark, sf_dir)
    both = factors.incomplete_lu(net)
    return rounded(products.spgemm(factors.lower_of(both), factors.upper_of(both)).join(net.select("i", "j"), ["i", "j"], "left_semi"))


@query(f"SELECT i, j, v + CASE WHEN i >= {S} + 25 AND j >= {S} + 25 THEN 1 ELSE 0 END AS v FROM (SELECT i, j, v FROM ({NET}) UNION ALL SELECT {S} + 25 + a.r, {S} + 25 + b.r, 0 FROM range(5) a(r), range(5) b(r) WHERE abs(a.r - b.r) NOT IN (0, 1, 4)) WHERE v + CASE WHEN i >= {S} + 25 AND j >= {S} + 25 THEN 1 ELSE 0 END <> 0")
def chol_update_reconstruct(spark, sf_dir):
    """L Lᵀ after an update by the indicator of the regions."""
    n = table(spark, sf_dir, "supplier").count()
    w = spark.range(n + 25, n + 30).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    low = factors.cholesky_update(factors.cholesky(network(spark, sf_dir)), w)
    return maintain.dropzeros(rounded(products.spgemm(low, shape.transpose(low))))


# Many small systems: the normal equations of price by quantity, for each part


def part_equations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """For each part ``(block, i, j, v)``, the sums of a ridge regression of price on (1, quantity), and its right sides."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("block")).agg(
        (F.count("*") + 1.0).alias("n"), F.sum("l_quantity").alias("q"), (F.sum(F.col("l_quantity") * F.col("l_quantity")) + 1.0).alias("qq"),
        F.sum("l_discount").alias("d"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("qd"),
    )
    cell = lambda i, j, v: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(v).alias("v"))
    a = t.select("block", F.inline(F.array(cell(0, 0, "n"), cell(0, 1, "q"), cell(1, 0, "q"), cell(1, 1, "qq"))))
    b = t.select("block", F.inline(F.array(cell(0, 0, "d"), cell(1, 0, "qd"))))
    return a, b.drop("j")


EQ = """SELECT l_partkey block, count(*) + 1.0 n, sum(l_quantity) q, sum(l_quantity * l_quantity) + 1.0 qq, sum(l_discount) d, sum(l_quantity * l_discount) qd
FROM lineitem GROUP BY 1"""
BLOCKS = f"""SELECT block::BIGINT AS block, i::BIGINT i, j::BIGINT j, round((CASE i + j WHEN 0 THEN n WHEN 1 THEN q ELSE qq END)::DOUBLE, 6) v
FROM ({EQ}), range(2) a(i), range(2) b(j)"""


@query(f"""SELECT block::BIGINT AS block, i::BIGINT i, round((CASE i WHEN 0 THEN d * qq - q * qd ELSE n * qd - q * d END / (n * qq - q * q))::DOUBLE, 6) v
FROM ({EQ}), range(2) t(i)""")
def batched_solve_by_group(spark, sf_dir):
    """A regression for each part, by two equations."""
    return rounded(blocks.solve(*part_equations(spark, sf_dir)))


def _product(found: DataFrame, left: str, right: str, transposed: bool = False) -> DataFrame:
    x = found.where(F.col("factor") == left).select("block", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    y = found.where(F.col("factor") == right)
    y = y.select("block", F.col("j" if transposed else "i").alias("k"), F.col("i" if transposed else "j").alias("j"), F.col("v").alias("y"))
    return rounded(x.join(y, ["block", "k"]).groupBy("block", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")))


@query(BLOCKS)
def block_chol_reconstruct(spark, sf_dir):
    """L Lᵀ of each part's equations."""
    return _product(blocks.cholesky(part_equations(spark, sf_dir)[0]), "L", "L", True)


@query(BLOCKS)
def block_lu_reconstruct(spark, sf_dir):
    """Pᵀ L U of each part's equations."""
    found = blocks.lu(part_equations(spark, sf_dir)[0])
    lu = _product(found, "L", "U").withColumn("factor", F.lit("LU"))
    turned = found.where("factor = 'P'").select("block", F.lit("T").alias("factor"), F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return _product(turned.unionByName(lu.select("block", "factor", "i", "j", "v")), "T", "LU")


@query(BLOCKS)
def block_qr_reconstruct(spark, sf_dir):
    """Q R of each part's equations."""
    return _product(blocks.qr(part_equations(spark, sf_dir)[0]), "Q", "R")


@query(f"""SELECT block::BIGINT AS block, round((greatest(n + abs(q), abs(q) + qq) * greatest(qq + abs(q), abs(q) + n) / abs(n * qq - q * q))::DOUBLE, 4) v FROM ({EQ})""")
def block_condition(spark, sf_dir):
    """The condition of each part's equations."""
    return rounded(blocks.condition(part_equations(spark, sf_dir)[0]), 4)


# Orders


@query(f"SELECT ({S} + 30)::BIGINT AS n, 0::BIGINT AS fill")
def minimum_degree_fill(spark, sf_dir):
    """Nodes ordered by minimum degree, and edges that eliminating suppliers and nations before regions adds: none."""
    edges, n = network_edges(spark, sf_dir)
    found = orderings.minimum_degree(shape.make_symmetric(edges.withColumn("v", F.lit(1.0))), spark.range(n).withColumnRenamed("id", "node"))
    early = found.where(F.col("node") < n - 5).where("degree > 1")
    return found.agg(F.count_distinct("node").alias("n")).crossJoin(early.agg(F.count("*").alias("fill")))


@query(f"""WITH RECURSIVE u AS ({EDGES}), e AS (SELECT i, j FROM u UNION SELECT j, i FROM u), d AS (SELECT i AS node, count(*) AS degree FROM e GROUP BY 1),
  lv(node, level) AS (SELECT min_by(node, (degree, node)), 0 FROM d UNION SELECT e.j, level + 1 FROM lv JOIN e ON e.i = lv.node WHERE level < 12),
  least_ AS (SELECT node, min(level) AS level FROM lv GROUP BY 1)
SELECT (row_number() OVER (ORDER BY level DESC, degree DESC, node DESC) - 1)::BIGINT AS k, node::BIGINT AS at FROM least_ JOIN d USING (node)""")
def reverse_levels(spark, sf_dir):
    """All nodes of NET, ordered by reverse breadth-first levels."""
    edges, n = network_edges(spark, sf_dir)
    return orderings.reverse_levels(shape.make_symmetric(edges.withColumn("v", F.lit(1.0))), spark.range(n).withColumnRenamed("id", "node"))


@query("SELECT 0::BIGINT AS crossing")
def node_separator(spark, sf_dir):
    """Edges of NET that lead past its separator: none."""
    edges, n = network_edges(spark, sf_dir)
    graph = shape.make_symmetric(edges.withColumn("v", F.lit(1.0)))
    side = orderings.node_separator(graph, spark.range(n).withColumnRenamed("id", "node"))
    a, b = side.select(F.col("node").alias("i"), F.col("side").alias("x")), side.select(F.col("node").alias("j"), F.col("side").alias("y"))
    return graph.join(a, "i").join(b, "j").agg(F.count_if(F.col("x") + F.col("y") == 1).alias("crossing"))


@query(f"SELECT ({S} + 30)::BIGINT AS n")
def large_diagonal(spark, sf_dir):
    """Rows of NET matched over large entries: all, by its diagonal."""
    return orderings.large_diagonal(network(spark, sf_dir)).agg(F.count_distinct("i").alias("n"))


# Solvers


@query(KNOWN)
def spsolve_auto(spark, sf_dir):
    """x of NET x = b, the way of solving chosen by the matrix."""
    net = network(spark, sf_dir)
    return rounded(solver.solve(net, products.spmv(net, _known(spark, sf_dir))), 4)


@query(KNOWN)
def block_triangular_knownx(spark, sf_dir):
    """x of (RING + 3 I) x = b, component by component."""
    nodes = spark.range(table(spark, sf_dir, "supplier").count() + 30)
    a = ring(spark, sf_dir).unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(3.0).alias("v")))
    return rounded(by_blocks.solve_by_components(a, products.spmv(a, ramp(nodes))))


# Streams


@query("SELECT user_id i, hour(ts)::BIGINT j, sum(1.0)::DOUBLE v FROM events GROUP BY 1, 2")
def stream_fold(spark, sf_dir):
    """Events by user and hour of day, read as a stream."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    steps = source.select(F.col("user_id").alias("i"), F.hour("ts").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return deltas.fold(steps, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
