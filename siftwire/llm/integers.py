"""Vectors as integers: quantised rows and exact inner products.

A component x becomes floor(scale * x), x as double. A row takes part if its id and vector are not null and no
component is null, infinite or not a number. So that every inner product fits in 64 bits, components count as at
most 2 ** 31 / sqrt(components) in size, which is 2 ** 20 or more for scale 256 and up to 65,536 components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, scale: float, vec_id: str, embedding: str, **more: Column) -> DataFrame:
    """(vec_id, copy, dims, v, and ``more``, texts or booleans) of the rows that take part.

    Rows that are equal in id, integers and texts become one, for which a boolean holds if it does for any;
    ``copy`` tells apart different rows with one id.
    """
    values = F.col(embedding).cast("array<double>")
    limit = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(values), F.lit(1)))) - 1
    ints = F.transform(values, lambda x: F.floor(F.greatest(F.least(x * F.lit(scale), limit), -limit)).cast("int"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("v"), *(c.alias(name) for name, c in more.items()))
    flags = [name for name in more if dict(rows.dtypes)[name] == "boolean"]
    texts = [name for name in more if name not in flags]
    rows = rows.withColumn("copy", F.xxhash64("v", *texts)).withColumn("dims", F.size("v"))
    kept = [F.max(c).alias(c) if c in flags else F.first(c).alias(c) for c in ("dims", "v", *more)]
    return rows.groupBy("vec_id", "copy").agg(*kept)


def matrix(rows: pd.Series) -> np.ndarray:
    """Lists of equally many integers as a matrix."""
    return np.stack(list(rows)).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices, exact; in doubles as long as those hold every sum exactly."""
    if a.size and b.size:
        largest = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
        if largest < 2**53:
            return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def narrowed(scores: np.ndarray) -> tuple[str, bytes]:
    """(type, bytes) of 64-bit integers in the narrowest type that holds them all."""
    low, high = (int(scores.min()), int(scores.max())) if scores.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, scores.astype(kind).tobytes()
