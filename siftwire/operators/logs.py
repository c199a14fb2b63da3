"""Durable logs: the newest segment, quarantined records, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_segment(segments: DataFrame) -> DataFrame:
    """The content of the segment (path, content) with the largest number as suffix, '' if there is none."""
    number = F.regexp_extract("path", r"\.([0-9]+)$", 1)
    numbered = segments.where(number != "").select(number.cast("decimal(38,0)").alias("n"), "content")
    return numbered.agg(F.coalesce(F.max_by("content", "n"), F.lit("")).alias("digest"))


def split_bad(records: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Records that can be read, and those for the dead-letter folder."""
    fine = F.coalesce(good, F.lit(False))
    return records.where(fine), records.where(~fine)


def expired(segments: DataFrame, keep: int, min_age: float, max_age: float, now: float, least: int = 1, most: int | None = None) -> DataFrame:
    """Segments (path, log, number, written) to delete: beyond the newest ``keep`` of a log and old enough, or too old.

    The newest ``least`` always stay. Beyond the newest ``most`` all go at any age; 0 stands for twice ``keep``.
    """
    rank = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("number")))
    age = F.lit(now) - F.col("written")
    surplus = (F.col("rank") > keep) & (age >= min_age)
    too_old = (age > max_age) if max_age > 0 else F.lit(False)
    too_many = F.lit(False) if most is None else F.col("rank") > (most or 2 * keep)
    return segments.withColumn("rank", rank).where((F.col("rank") > least) & (surplus | too_old | too_many)).drop("rank")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The segments (path, log, number, written, content) of a log of digests; none without the folder."""
    schema = "digest string, written double, v long"
    try:
        rows = spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    path = F.concat(F.lit(f"{folder}/v="), F.col("v").cast("string"))
    return rows.select(path.alias("path"), F.lit(folder).alias("log"), F.col("v").alias("number"), "written", F.col("digest").alias("content"))


def append_digest(digest: DataFrame, folder: str, now: float, keep: int = 7, least: int = 2) -> int:
    """Write a digest (one row, ``digest``) as the next segment of its log, delete those that expire, and return its number."""
    spark = digest.sparkSession
    number = (digests(spark, folder).agg(F.max("number")).first()[0] or 0) + 1
    digest.select("digest", F.lit(float(now)).alias("written")).write.mode("overwrite").parquet(f"{folder}/v={number}")
    for row in expired(digests(spark, folder), keep, 0.0, 0.0, now, least, 0).select("path").collect():  # a few segments
        path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return number


def required(columns: Sequence[str]) -> Column:
    """True where all columns have a value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
