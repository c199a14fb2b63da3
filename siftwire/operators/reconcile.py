"""Reconciliation of the publisher master with a client snapshot: create, update, reactivate, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE = "atomic_site_id string, domain_name string, created string, status string, first_seen string, last_seen string, churned_at string"
_FIELDS = ["domain_name", "created", "status", "first_seen", "last_seen", "churned_at"]


def _joined(store: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Store and snapshot by id; of equal ids in a snapshot the last row's fields count, and all are counted."""
    last = snapshot.groupBy("atomic_site_id").agg(F.max(F.struct("ord", "domain_name", "created")).alias("new"), F.count("*").alias("times"))
    return store.withColumn("known", F.lit(True)).join(last, "atomic_site_id", "full")


def merge(store: DataFrame, snapshot: DataFrame, today: str) -> DataFrame:
    """The store after the import; other columns of the store, the enrichment, stay. An empty snapshot changes nothing.

    A column ``title`` follows the domain of every row that the snapshot holds.
    """
    if snapshot.isEmpty():
        return store
    seen, known = F.col("times").isNotNull(), F.coalesce("known", F.lit(False))
    gone = ~seen & (F.col("status") != "churned")
    back = seen & known & (F.col("status") == "churned")
    values = {
        "domain_name": F.when(seen, F.col("new.domain_name")).otherwise(F.col("domain_name")),
        "title": F.when(seen, F.col("new.domain_name")).otherwise(F.col("title") if "title" in store.columns else F.lit("")),
        "created": F.when(seen, F.col("new.created")).otherwise(F.col("created")),
        "status": F.when(gone, "churned").when(back | ~known, "active").otherwise(F.col("status")),
        "first_seen": F.when(known, F.col("first_seen")).otherwise(today),
        "last_seen": F.when(seen, today).otherwise(F.col("last_seen")),
        "churned_at": F.when(gone, today).when(back | ~known, "").otherwise(F.col("churned_at")),
    }
    rows = _joined(store, snapshot)
    return rows.select(*(values.get(c, F.coalesce(F.col(c), F.lit("")) if t == "string" else F.col(c)).alias(c) for c, t in store.dtypes))


def report(store: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row of counters; every row of the snapshot counts once, a repeated id after its first row as updated."""
    rows = _joined(store, snapshot).crossJoin(F.broadcast(snapshot.agg((F.count("*") > 0).alias("any"))))
    seen, known = F.col("times").isNotNull(), F.coalesce("known", F.lit(False))
    churned = F.col("status") == "churned"
    total = lambda c: F.coalesce(F.sum(F.when(F.col("any"), c).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(
        total(F.when(seen & ~known, 1).otherwise(0)).alias("created"),
        total(F.when(seen & known & ~churned, F.col("times")).when(seen, F.col("times") - 1).otherwise(0)).alias("updated"),
        total(F.when(seen & known & churned, 1).otherwise(0)).alias("reactivated"),
        total(F.when(~seen & ~churned, 1).otherwise(0)).alias("churned"),
        total(F.when(seen, 1).otherwise(0)).alias("total_in_csv"),
    )


def churned_ids(store: DataFrame, snapshot: DataFrame) -> DataFrame:
    return store.where("status <> 'churned'").join(snapshot, "atomic_site_id", "left_anti").select("atomic_site_id")


def report_text(counters: DataFrame) -> DataFrame:
    """The line that an import prints."""
    return counters.select(F.format_string("Imported %d rows: %d created, %d updated, %d reactivated, %d churned.", "total_in_csv", "created", "updated", "reactivated", "churned").alias("message"))


# The fields that people enrich; an import never touches them.
ENRICHMENT = ["publisher_name", "aliases", "localities", "beat_tags", "website_url", "social_handles", "notes"]


def patch(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Enrichment fields of ``changes`` that are not null, without tags and with single spaces, over the store's."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    fields = [c for c in ENRICHMENT if c in changes.columns and c in store.columns]
    new = changes.select("atomic_site_id", *(clean(F.col(c)).alias(f"__{c}") for c in fields))
    rows = store.join(new, "atomic_site_id", "left")
    return rows.select(*((F.coalesce(f"__{c}", c) if c in fields else F.col(c)).alias(c) for c in store.columns))


def delete_prefixed(options: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The options that stay, and the number of those that go: the prefix itself or as a transient's."""
    name = F.col("name")
    gone = name.startswith(prefix) | name.startswith(f"_transient_{prefix}") | name.startswith(f"_transient_timeout_{prefix}")
    return options.where(~gone), options.where(gone).agg(F.count("*").alias("deleted"))
