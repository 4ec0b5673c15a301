"""Joins whose small side is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows. They are counted, so df should be cheap to compute or cut."""
    return F.broadcast(df) if df.count() <= most else df
