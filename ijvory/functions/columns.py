"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gap between 1 and the next double; counts of nonzeros ignore what is no larger.
EPSILON = 2.220446049250313e-16


def is_number(v: Column) -> Column:
    """False for NaN, which Spark orders above all numbers."""
    return ~F.isnan(v)


def quotient(a: Column, b: Column) -> Column:
    """IEEE division: infinite or NaN where ``b`` is zero, never an error."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)


def larger_first(v: Column, i: Column) -> Column:
    """Orders by absolute value; of equals the smaller index is the larger."""
    return F.struct(F.abs(v), -i)
