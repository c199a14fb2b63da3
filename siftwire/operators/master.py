"""The publisher master as a table of versions in hash buckets: a change rewrites only the buckets that it touches.

Data of a version stands in ``data/v=<version>/bucket=<bucket>``. A pointer, one small file for each version, names
the version of every bucket; the largest pointer is the table. It is written last, so that a change is there as a
whole or not at all: what a failed change has left is overwritten by the next one, and readers never see it.
One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from siftwire.session import checkpointed

_POINTER = "bucket int, version long, buckets int, schema string"


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, version, buckets, schema, v) of all versions."""
    try:
        return spark.read.schema(_POINTER + ", v long").parquet(f"{folder}/pointers")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _POINTER + ", v long")


def version(spark: SparkSession, folder: str) -> int:
    """The newest version; 0 before the first."""
    return _pointers(spark, folder).agg(F.max("v")).first()[0] or 0


def _table(spark: SparkSession, folder: str, at: int, only: list[int] | None = None) -> DataFrame:
    """The rows of a version with their ``bucket``; of some buckets only, if they are given. A row for each bucket comes to the driver."""
    pointer = _pointers(spark, folder).where(F.col("v") == at).collect()
    if not pointer:
        raise ValueError(f"{folder} has no version {at}")
    schema = StructType.fromJson(json.loads(pointer[0]["schema"])).add("bucket", IntegerType())
    paths = [f"{folder}/data/v={r['version']}/bucket={r['bucket']}" for r in pointer if r["version"] and (only is None or r["bucket"] in only)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*paths).select(schema.names)


def read(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """The table, at its newest version or an older one."""
    return _table(spark, folder, version(spark, folder) if at is None else at).drop("bucket")


def _with_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _publish(spark: SparkSession, folder: str, number: int, pointer: list[tuple]) -> int:
    spark.createDataFrame(pointer, _POINTER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointers/v={number}")
    return number


def _write(rows: DataFrame, folder: str, number: int) -> None:
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/v={number}")


def create(rows: DataFrame, folder: str, key: str = "atomic_site_id", buckets: int = 64) -> int:
    """The first version of a table of ``rows`` with different keys; an error if there is one already."""
    spark = rows.sparkSession
    if version(spark, folder):
        raise ValueError(f"{folder} has a table")
    placed = _with_bucket(rows, key, buckets)
    _write(placed, folder, 1)
    used = {r["bucket"] for r in spark.read.parquet(f"{folder}/data/v=1").select("bucket").distinct().collect()} if not rows.isEmpty() else set()
    return _publish(spark, folder, 1, [(b, 1 if b in used else 0, buckets, rows.schema.json()) for b in range(buckets)])


def upsert(rows: DataFrame, folder: str, key: str = "atomic_site_id") -> int:
    """Put ``rows``, whole rows with different keys, in the place of those with their key, and return the version.

    Rows that are in the table as they are change nothing; without any other there is no new version.
    """
    spark = rows.sparkSession
    now = version(spark, folder)
    pointer = _pointers(spark, folder).where(F.col("v") == now).collect()
    buckets, schema = pointer[0]["buckets"], pointer[0]["schema"]
    old = _table(spark, folder, now)
    names = [c for c in old.columns if c != "bucket"]
    equal = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names]
    new = _with_bucket(rows.select(names), key, buckets)
    same = new.alias("n").join(old.alias("o"), equal).select(F.col(f"n.{key}").alias(key))
    changed = checkpointed(new.join(same, key, "left_anti"))
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # at most as many as there are buckets
    if not touched:
        return now
    kept = _table(spark, folder, now, touched).join(changed.select(key), key, "left_anti")
    _write(kept.select(changed.columns).unionByName(changed), folder, now + 1)
    return _publish(spark, folder, now + 1, [(r["bucket"], now + 1 if r["bucket"] in touched else r["version"], buckets, schema) for r in pointer])
