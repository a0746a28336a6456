"""Which side of a join may be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few fixed-width columns that may be broadcast: a few tens of megabytes.
MOST_ROWS = 500_000


def small(df: DataFrame, limit: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast where it has at most limit rows, counted no further than that; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
