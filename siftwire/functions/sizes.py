"""Broadcasts behind a check of their size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow dimension that every executor can hold.
BROADCAST_ROWS = 1_000_000


def sized(dimension: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``bound`` rows; beyond that the join shuffles."""
    return F.broadcast(dimension) if dimension.limit(bound + 1).count() <= bound else dimension
