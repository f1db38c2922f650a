"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(a: Column, b: Column | int) -> Column:
    """``a div b`` in long arithmetic."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
