"""Column expressions shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    """The sum of an amount, added exactly as decimals and rounded to cents: it doesn't depend on the order of rows."""
    return F.round(F.sum(amount.cast("decimal(24, 6)")), 2).cast("double")
