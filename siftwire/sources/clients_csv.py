"""Client snapshots: CSV text with the columns id, created, domain."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwire.functions import text as T
from siftwire.functions.sizes import sized

SNAPSHOT = "ord long, atomic_site_id string, domain_name string, created string"


def _fields(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fields of one line; how many there are matters, which from_csv does not tell."""
    for lines in batches:
        yield pd.Series([next(csv.reader([x]), []) for x in lines], dtype=object)


def fields(line: Column | str) -> Column:
    return F.pandas_udf(_fields, "array<string>")(line)


def parse(lines: DataFrame) -> DataFrame | None:
    """Snapshot rows of (ord, line); None rejects the whole file.

    It is rejected without a header whose first field holds "atomic", and without any row of three fields,
    so that a broken export never looks like an empty client list.
    """
    rows = lines.where(~T.blank(F.col("line")))
    header = rows.orderBy("ord").limit(1).select("ord", fields("line").alias("f")).first()
    if header is None or not header["f"] or "atomic" not in header["f"][0].lower():
        return None
    cut = rows.where(F.col("ord") > header["ord"]).select("ord", fields("line").alias("f")).where(F.size("f") >= 3)
    part = lambda i: T.trimmed(F.get("f", i))
    found = cut.select("ord", part(0).alias("atomic_site_id"), part(2).alias("domain_name"), part(1).alias("created"))
    return None if found.isEmpty() else found


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a text file or a folder of them, read in splits: lines end with LF, CR or both.

    A line's number is that of its split, from the counts of the splits before it, and its place in the split. A
    folder's files follow each other by name.
    """
    scan = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    counts = scan.groupBy("file", "split").agg(F.count("*").alias("n"))
    # A row for each split.
    before = F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "split", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    placed = scan.withColumn("at", F.monotonically_increasing_id()).withColumn("within", within)
    return placed.join(sized(starts), ["file", "split"]).select((F.col("start") + F.col("within") - 1).alias("ord"), "line")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot of a file; None if the path is empty or can't be read, or the file is rejected."""
    if not path:
        return None
    try:
        return parse(numbered_lines(spark, path))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
