"""Tracker answers (seq, answer): the JSON text of a GraphQL request for the most recently updated issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.operators import items
from siftwire.sources.code_host import text

_NODE = "identifier:variant,title:string,url:string,description:string,updatedAt:string"


def read(answers: DataFrame) -> DataFrame:
    """Nodes whose identifier is a text that isn't empty."""
    parsed = F.from_json("answer", f"data struct<issues:struct<nodes:array<struct<{_NODE}>>>>")
    rows = answers.select("seq", F.posexplode(parsed["data"]["issues"]["nodes"]).alias("at", "x")).where("x is not null")
    rows = rows.select((F.col("seq") * 1_000_000 + F.col("at")).alias("seq"), text(F.col("x.identifier")).alias("native_id"), "x.title", "x.url", F.col("x.description").alias("body"), F.col("x.updatedAt").alias("time"))
    return items.normalize(rows.where("native_id <> ''"), "linear")
