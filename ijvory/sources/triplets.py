"""Where matrices come from: text, rows, dense arrays, chance and worked examples.

A matrix is a DataFrame ``(i long, j long, v double)``, a vector ``(i long, v
double)``; indices count from 0, and absent rows are zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "i long, j long, v double"


def read_triplets(spark: SparkSession, path: str, index_base: int = 0) -> DataFrame:
    """Lines ``i j v`` of text files; blank lines are skipped, further words ignored, bad lines an error."""
    return parse_triplets(spark.read.text(path), index_base)


def parse_triplets(lines: DataFrame, index_base: int = 0) -> DataFrame:
    """Triplets of a DataFrame of text with a column ``value``; duplicates stay."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    found = lines.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(parts.alias("p"), "value")
    i, j, v = F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2))
    bad = i.try_cast("long").isNull() | j.try_cast("long").isNull() | v.try_cast("double").isNull() | (i.try_cast("long") < index_base) | (j.try_cast("long") < index_base)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a triplet: "), F.col("value"))).cast("long")).otherwise(i.try_cast("long") - index_base)
    return found.select(checked.alias("i"), (j.try_cast("long") - index_base).alias("j"), v.try_cast("double").alias("v"))


def from_rows(spark: SparkSession, rows, cols, values=None) -> DataFrame:
    """A matrix of three sequences of one length; without values each entry is 1."""
    rows, cols = list(rows), list(cols)
    values = [1.0] * len(rows) if values is None else list(values)
    if not len(rows) == len(cols) == len(values):
        raise ValueError("rows, columns and values differ in length")
    if any(x < 0 for x in (*rows, *cols)):
        raise ValueError("negative index")
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(rows, cols, values)], SCHEMA)


def shape(a: DataFrame) -> tuple[int, int]:
    """The smallest shape that holds all entries."""
    m, n = a.agg(F.coalesce(F.max("i") + 1, F.lit(0)), F.coalesce(F.max("j") + 1, F.lit(0))).first()
    return m, n


def from_dense(arrays: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """A row for each array, its nonzero components by position; null components are zero."""
    each = arrays.select(F.col(id_col).cast("long").alias("i"), F.posexplode(array_col).alias("j", "v"))
    return each.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).where("v <> 0")


def from_columns(packed: DataFrame) -> DataFrame:
    """Entries of packed columns ``(j, rows array, vals array)``."""
    each = packed.select("j", F.explode(F.arrays_zip("rows", "vals")).alias("x"))
    return each.select(F.col("x.rows").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("x.vals").cast("double").alias("v"))


def to_columns(a: DataFrame) -> DataFrame:
    """Packed columns, rows ascending."""
    cols = a.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x"))
    return cols.select("j", F.col("x.i").alias("rows"), F.col("x.v").alias("vals"))


def random_matrix(spark: SparkSession, nrows: int, ncols: int, density: float, seed: int) -> DataFrame:
    """int(nrows ncols density) distinct cells with values from [0, 1), the same for the same seed."""
    cells = spark.range(nrows * ncols).select("id", F.xxhash64("id", F.lit(seed)).alias("h"))
    kept = cells.orderBy("h", "id").limit(int(nrows * ncols * density))
    unit = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 53)) / float(1 << 53)
    return kept.select(F.expr(f"id div {ncols}").alias("i"), (F.col("id") % ncols).alias("j"), unit.alias("v"))


# The worked examples.
SMALL = [(2, 2, 3.0), (1, 0, 3.1), (3, 3, 1.0), (0, 2, 3.2), (1, 1, 2.9), (3, 0, 3.5), (3, 1, 0.4), (1, 3, 0.9), (0, 0, 4.5), (2, 1, 1.7)]
CHOL_ROWS = [5, 6, 2, 7, 9, 10, 5, 9, 7, 10, 8, 9, 10, 9, 10, 10]
CHOL_COLS = [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 7, 9]
CHOL_PARENT = [5, 2, 7, 5, 7, 6, 8, 9, 9, 10, -1]


def example_small(spark: SparkSession) -> DataFrame:
    """4 x 4 with 10 entries."""
    return spark.createDataFrame(SMALL, SCHEMA)


def example_chol(spark: SparkSession) -> DataFrame:
    """11 x 11, symmetric and positive definite: diagonal i + 10, ones elsewhere."""
    lower = [(i, j, 1.0) for i, j in zip(CHOL_ROWS, CHOL_COLS)]
    return spark.createDataFrame([*lower, *[(j, i, v) for i, j, v in lower], *[(k, k, k + 10.0) for k in range(11)]], SCHEMA)
