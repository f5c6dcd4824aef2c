"""Counted broadcasts beside the sums over sorted runs that the library has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.operators.ranks import sums_before

__all__ = ["MAX_BROADCAST", "counted", "sums_before"]

#: Counted tables of at most so many rows are broadcast; larger ones meet their partners in a shuffle.
MAX_BROADCAST = 100_000


def counted(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df
