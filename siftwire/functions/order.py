"""Running sums in the order of rows, spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column | str], value: Column, name: str, kind: str = "long") -> DataFrame:
    """``name``: the sum, as ``kind``, of ``value`` up to and with the row, in the order of ``block``, then ``order``.

    Sums within blocks of the order and sums over blocks: a key with many rows is spread over its blocks. Null
    blocks come first, null keys are a key of their own.
    """
    rows = rows.withColumn("__block", block)
    totals = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__block"]]
    met = rows.withColumn("__within", within).alias("a").join(totals.alias("b"), same)
    return met.select(*(F.col(f"a.{c}").alias(c) for c in rows.columns if c != "__block"), (F.col("__within") + F.col("__before")).cast(kind).alias(name))
