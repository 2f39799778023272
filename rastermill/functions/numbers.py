"""Whole-number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: str | Column, width: int) -> Column:
    """``floor(value / width)`` in whole numbers, also for negative values."""
    col = F.col(value) if isinstance(value, str) else value
    step = F.lit(width).cast("bigint")
    return F.call_function("div", col - F.pmod(col, step), step)
