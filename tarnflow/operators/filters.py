"""Row filters; as ordinary predicates they are pushed into the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def not_equal(column: str, value) -> Column:
    return F.col(column) != F.lit(value)


def present(column: str) -> Column:
    return F.col(column).isNotNull()


def band(column: str, operand, width) -> Column:
    """|column - operand| <= width, as two bounds that a Parquet scan can use."""
    return F.col(column).between(operand - width, operand + width)
