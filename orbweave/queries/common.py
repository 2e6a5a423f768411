"""Helpers that the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines; negative zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
