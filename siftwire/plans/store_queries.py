"""Queries of the publisher master: reconciliation, enrichment and clean-up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwire.operators import master, reconcile
from siftwire.plans import bindings as B
from siftwire.session import shared_folder

_LAST = "lastsnap AS (SELECT atomic_site_id, arg_max(domain_name, ord) AS d, arg_max(created, ord) AS c, count(*) AS times FROM snap GROUP BY 1), j AS (SELECT coalesce(s.atomic_site_id, n.atomic_site_id) AS atomic_site_id, s.* EXCLUDE (atomic_site_id), s.atomic_site_id IS NOT NULL AS known, n.d, n.c, n.times FROM store s FULL JOIN lastsnap n USING (atomic_site_id))"
_MERGED = f"""SELECT atomic_site_id, coalesce(d, domain_name) AS domain_name, coalesce(c, created) AS created,
  CASE WHEN times IS NULL THEN 'churned' WHEN NOT known OR status = 'churned' THEN 'active' ELSE status END AS status, CASE WHEN known THEN first_seen ELSE '{B.TODAY}' END AS first_seen,
  CASE WHEN times IS NOT NULL THEN '{B.TODAY}' ELSE last_seen END AS last_seen,
  CASE WHEN times IS NULL AND status <> 'churned' THEN '{B.TODAY}' WHEN times IS NOT NULL AND (NOT known OR status = 'churned') THEN '' ELSE churned_at END AS churned_at, coalesce(publisher_name, '') AS publisher_name FROM j"""
_REPORT = """SELECT CAST(count(*) FILTER (times IS NOT NULL AND NOT known) AS BIGINT) AS created,
  CAST(coalesce(sum(CASE WHEN times IS NULL THEN 0 WHEN known AND status <> 'churned' THEN times ELSE times - 1 END), 0) AS BIGINT) AS updated,
  count(*) FILTER (times IS NOT NULL AND known AND status = 'churned') AS reactivated, count(*) FILTER (times IS NULL AND status <> 'churned') AS churned, count(*) FILTER (times IS NOT NULL) AS total_in_csv FROM j"""


def _twice(spark, d):
    snapshot = B.client_snapshot(spark, d)
    return reconcile.report(reconcile.merge(B.store(spark, d), snapshot, B.TODAY), snapshot)


def _empty(spark, d):
    none = B.client_snapshot(spark, d).where("ord < 0")
    return reconcile.report(B.store(spark, d), none)


def _options(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("sift_wire_"), key)).when(key % 4 == 1, F.concat(F.lit("_transient_sift_wire_"), key)).when(key % 4 == 2, F.concat(F.lit("siftXwire_"), key))
    return B.table(spark, d, "customer").select(F.coalesce(name, F.concat(F.lit("other_"), key)).alias("name"))


def _patched(spark, d):
    store = B.store(spark, d)
    changes = store.where("atomic_site_id % 3 = 0").select("atomic_site_id", F.concat(F.lit("<b>The</b>  new "), "publisher_name").alias("publisher_name"), F.lit("evil.example").alias("domain_name"))
    return reconcile.patch(store, changes).select("atomic_site_id", "publisher_name", "domain_name")


def _versions(spark, d):
    """The store as a table of versions: created, enriched in some rows, imported into."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    master.create(B.store(spark, d), folder, buckets=8)
    some = master.read(spark, folder).where("atomic_site_id % 100 = 1")
    master.upsert(some.withColumn("publisher_name", F.concat("publisher_name", F.lit("!"))), folder)
    master.upsert(reconcile.merge(master.read(spark, folder), B.client_snapshot(spark, d), B.TODAY), folder)
    return master.read(spark, folder)


QUERIES = {
    "master_versions": (
        _versions,
        f"WITH {B.STORE}, {B.SNAPSHOT}, {_LAST}, m AS ({_MERGED}) SELECT * REPLACE (CASE WHEN CAST(atomic_site_id AS BIGINT) % 100 = 1 THEN publisher_name || '!' ELSE publisher_name END AS publisher_name) FROM m",
    ),
    "reconcile_merge": (lambda s, d: reconcile.merge(B.store(s, d), B.client_snapshot(s, d), B.TODAY), f"WITH {B.STORE}, {B.SNAPSHOT}, {_LAST} {_MERGED}"),
    "reconcile_report": (lambda s, d: reconcile.report(B.store(s, d), B.client_snapshot(s, d)), f"WITH {B.STORE}, {B.SNAPSHOT}, {_LAST} {_REPORT}"),
    "reconcile_duplicates": (lambda s, d: reconcile.report(B.store(s, d), B.client_snapshot(s, d, True)), f"WITH {B.STORE}, {B.REPEATED}, {_LAST} {_REPORT}"),
    "reconcile_duplicates_merge": (lambda s, d: reconcile.merge(B.store(s, d), B.client_snapshot(s, d, True), B.TODAY), f"WITH {B.STORE}, {B.REPEATED}, {_LAST} {_MERGED}"),
    "reconcile_idempotent": (
        _twice,
        f"WITH {B.SNAPSHOT} SELECT 0::BIGINT AS created, count(*) AS updated, 0::BIGINT AS reactivated, 0::BIGINT AS churned, count(DISTINCT atomic_site_id) AS total_in_csv FROM snap",
    ),
    "reconcile_empty_guard": (_empty, "SELECT 0::BIGINT AS created, 0::BIGINT AS updated, 0::BIGINT AS reactivated, 0::BIGINT AS churned, 0::BIGINT AS total_in_csv"),
    "churn_anti_join": (
        lambda s, d: reconcile.churned_ids(B.store(s, d), B.client_snapshot(s, d)),
        f"WITH {B.STORE}, {B.SNAPSHOT} SELECT atomic_site_id FROM store WHERE status <> 'churned' AND atomic_site_id NOT IN (SELECT atomic_site_id FROM snap)",
    ),
    "import_report_text": (
        lambda s, d: reconcile.report_text(reconcile.report(B.store(s, d), B.client_snapshot(s, d))),
        f"WITH {B.STORE}, {B.SNAPSHOT}, {_LAST}, r AS ({_REPORT}) SELECT 'Imported ' || total_in_csv || ' rows: ' || created || ' created, ' || updated || ' updated, ' || reactivated || ' reactivated, ' || churned || ' churned.' AS message FROM r",
    ),
    "enrichment_patch": (
        _patched,
        f"WITH {B.STORE} SELECT atomic_site_id, CASE WHEN CAST(atomic_site_id AS BIGINT) % 3 = 0 THEN 'The new ' || publisher_name ELSE publisher_name END AS publisher_name, domain_name FROM store",
    ),
    "prefix_delete": (lambda s, d: reconcile.delete_prefixed(_options(s, d), "sift_wire_")[1], "SELECT count(*) FILTER (c_custkey % 4 < 2) AS deleted FROM customer"),
    "prefix_delete_rest": (
        lambda s, d: reconcile.delete_prefixed(_options(s, d), "sift_wire_")[0],
        "SELECT CASE WHEN c_custkey % 4 = 2 THEN 'siftXwire_' ELSE 'other_' END || c_custkey AS name FROM customer WHERE c_custkey % 4 >= 2",
    ),
}
