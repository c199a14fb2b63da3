"""Values of expressions that are computed once for a row."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: as a variable it is no expression to be evaluated at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
