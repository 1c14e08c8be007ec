"""ijvory: sparse matrices, graphs and solvers as plain Spark DataFrames of (i, j, v)."""

__version__ = "0.1.0"
