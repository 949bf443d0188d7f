"""Column expressions that several modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def aside(value: Column) -> Column:
    """value, evaluated row by row instead of in generated code: for long case tables that would not fit into one method."""
    return let(F.lit(True), lambda _: value)


def once(value: Column) -> Column:
    """value, worked out once for a row: what filters or asks for parts of it reads the result, where the optimizer would put a copy of the expression into each."""
    return F.when(F.spark_partition_id() >= 0, value)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$", "")
