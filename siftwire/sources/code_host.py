"""Code host answers (seq, repo, releases, pulls, issues): JSON texts of three endpoints for each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.operators import items

_FIELDS = {
    "releases": "id:variant,name:variant,tag_name:variant,html_url:string,body:string,published_at:string",
    "pulls": "number:variant,title:string,html_url:string,body:string,merged_at:string",
    "issues": "number:variant,title:string,html_url:string,body:string,updated_at:string,created_at:string,pull_request:variant",
}


def token(value: Column) -> Column:
    """An id that is an integer or a text, as text; '' for anything else."""
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("BIGINT", "STRING"), F.try_variant_get(value, "$", "string")).otherwise("")


def text(value: Column) -> Column:
    """A JSON text; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _rows(answers: DataFrame, endpoint: str, place: int) -> DataFrame:
    """An entry of the endpoint's array per row; ``seq`` orders by repository, endpoint, then position."""
    parsed = F.from_json(endpoint, f"array<struct<{_FIELDS[endpoint]}>>")
    exploded = answers.select("seq", "repo", F.posexplode(parsed).alias("at", "x"))
    return exploded.select((F.col("seq") * 3_000_000 + place * 1_000_000 + F.col("at")).alias("seq"), "repo", "x.*")


def releases(answers: DataFrame) -> DataFrame:
    rows = _rows(answers, "releases", 0).withColumn("id", token(F.col("id"))).where("id <> ''")
    name = F.nullif(text(F.col("name")), F.lit(""))
    tag = F.try_variant_get("tag_name", "$", "string")
    return items.normalize(rows.select("seq", F.concat("repo", F.lit("#release-"), "id").alias("native_id"), F.coalesce(name, tag).alias("title"), F.col("html_url").alias("url"), "body", F.col("published_at").alias("time")), "github")


def merged_pulls(answers: DataFrame) -> DataFrame:
    rows = _rows(answers, "pulls", 1).withColumn("number", token(F.col("number"))).where("number <> '' and merged_at <> ''")
    return items.normalize(rows.select("seq", F.concat("repo", F.lit("#pr-"), "number").alias("native_id"), "title", F.col("html_url").alias("url"), "body", F.col("merged_at").alias("time")), "github")


def issues(answers: DataFrame) -> DataFrame:
    """Entries with a pull_request that isn't null are no issues."""
    no_pull = F.col("pull_request").isNull() | F.is_variant_null("pull_request")
    rows = _rows(answers, "issues", 2).where(no_pull).withColumn("number", token(F.col("number"))).where("number <> ''")
    return items.normalize(rows.select("seq", F.concat("repo", F.lit("#issue-"), "number").alias("native_id"), "title", F.col("html_url").alias("url"), "body", F.coalesce("updated_at", "created_at").alias("time")), "github")


def read(answers: DataFrame) -> DataFrame:
    """Releases, merged pulls and issues of every repository with a name."""
    named = answers.where("repo <> ''")
    return items.union_all([releases(named), merged_pulls(named), issues(named)])
