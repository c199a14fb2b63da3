"""Broadcasts behind a check of their size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table (an id, a number) that every executor can hold: some 20 MB.
BROADCAST_ROWS = 1_000_000


def sized(narrow: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow`` marked for broadcast if it has at most ``bound`` rows; beyond that the join shuffles."""
    return F.broadcast(narrow) if narrow.limit(bound + 1).count() <= bound else narrow
