"""Queries of what surrounds the items: collections, saved states, counters, exports, and the streams on stored events."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from siftwire.operators import cycles, items, lifecycle
from siftwire.plans import bindings as B
from siftwire.session import shared_folder, stored
from siftwire.sources import clients_csv
from siftwire.streaming import digest, jobs, seen


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _tick(spark, d):
    sources = spark.createDataFrame([("github",), ("feed",), ("github",)], "source string")
    return cycles.tick(B.items_pages(spark, d).select("seq", "source", "id"), sources).select("seq", "kind", "source", "id")


def _saved(spark, d):
    """Saved states: a cycle for each customer, its orders as items, with repeated ids, blank ones and entries of other kinds."""
    orders = B.table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority"))
    entry = F.format_string('{"id": "%s", "n": %d}', name, "o_orderkey")
    entries = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("x")))), lambda e: e["x"])
    rows = orders.groupBy(F.col("o_custkey").alias("cycle")).agg(entries.alias("l"), F.count("*").alias("n"))
    return rows.select("cycle", F.format_string('{"items": [%s, 5, null], "total": "%d", "reported": ["a", 1, "b", "a"]}', F.array_join("l", ", "), "n").alias("state"))


def _progress(spark, d):
    return cycles.restored_progress(_saved(spark, d)).select("cycle", "total", F.array_join("reported", ",").alias("reported"))


def _counters(spark, d):
    """Counted while the rows are computed, not in a pass of its own."""
    by = Observation("states")
    scored = items.score(B.items_docs(spark, d), B.NOW)
    lifecycle.observed(scored, by, lifecycle.of_summaries() | lifecycle.of_scores() | lifecycle.of_digests()).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(by.get.items()), "state string, n long")


def _controlled(spark, d):
    step = lambda rows: items.score(rows.withColumn("relevance_score", F.lit(None).cast("int")).withColumn("title", F.col("id")).drop("score"), B.NOW)
    rows = B.events(spark, d).withColumn("kind", F.when(F.col("seq") % 11 == 0, "noise").when(F.col("kind") != "item", F.col("kind")))
    return items.items_only(rows, step).select("seq", "kind", "source", "title", "score")


def _exported(spark, d):
    """Customers as a client export, written as text and read in splits."""
    key = F.col("c_custkey")
    line = F.when(key % 9 == 0, F.concat(key, F.lit(",short"))).otherwise(F.concat(F.lit('"'), key, F.lit('" ,2023-01-01,"d, '), key, F.lit('.example" ,more')))
    rows = B.table(spark, d, "customer").select(key.alias("at"), line.alias("line"))
    header = spark.createDataFrame([(-1, "Atomic id,created,domain")], "at long, line string")
    folder = _folder(spark)
    header.unionByName(rows).repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(folder)
    return clients_csv.read(spark, folder)


def _stream(spark, d):
    """The digest stream over the events in two parts, the second from the first one's checkpoint; its folder."""
    folder = _folder(spark)
    names = [f.split()[0] for f in digest.EVENT.split(", ")]
    events = B.events(spark, d).withColumn("summary", F.col("id"))
    for c in ("title", "url"):
        events = events.withColumn(c, F.lit(None).cast("string"))
    events = stored(events.select(names), "events")
    half = events.agg(F.max("seq")).first()[0] or 0
    for part in (f"seq <= {half // 2}", f"seq > {half // 2}"):
        events.where(part).write.mode("append").parquet(f"{folder}/log")
        digest.run(jobs.log(spark, f"{folder}/log", digest.EVENT, 100_000), 4, f"{folder}/out", f"{folder}/check").awaitTermination()
    return folder


def _seen(spark, d):
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("source"), F.concat("event_type", F.lit(":"), (F.col("event_id") * F.col("user_id") % 211).cast("string")).alias("id"))
    return seen.fresh_ids(rows, spark.createDataFrame([], seen.MEMORY), 20)


_DUE = """d AS (SELECT *, row_number() OVER (PARTITION BY cycle, source ORDER BY seq) = 1 AS new FROM ev WHERE kind = 'done'),
p AS (SELECT cycle, seq, sum(CAST(new AS INTEGER)) OVER (PARTITION BY cycle ORDER BY seq) AS done FROM d), due AS (SELECT cycle, seq AS place FROM p WHERE done >= 4),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cycle, id ORDER BY seq) AS r FROM ev WHERE kind = 'item') WHERE r = 1),
placed AS (SELECT due.cycle, place, k.*, row_number() OVER (PARTITION BY due.cycle, place, source ORDER BY coalesce(score, 0) DESC, seq) AS rank, min(seq) OVER (PARTITION BY due.cycle, place, source) AS first_seq
  FROM due JOIN (SELECT cycle AS c, seq, source, id, score FROM kept) k ON k.c = due.cycle AND k.seq < place)"""
_ENTRIES = """e AS (SELECT o_custkey AS cycle, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS id, o_orderkey AS n FROM orders)"""

QUERIES = {
    "collect_tick": (
        _tick,
        f"""WITH {B.ITEMS_PAGES}, m AS (SELECT coalesce(max(seq), -1) AS m FROM pageitems) SELECT seq, 'item' AS kind, source, id FROM pageitems
            UNION ALL SELECT m + 1, 'done', 'feed', NULL FROM m UNION ALL SELECT m + 2, 'done', 'github', NULL FROM m""",
    ),
    "state_restore_items": (
        lambda s, d: cycles.restored_items(_saved(s, d)).withColumnRenamed("at", "place"),
        f"""WITH {_ENTRIES} SELECT cycle, place, id, '{{"id":"' || id || '","n":' || n || '}}' AS item FROM (SELECT *, row_number() OVER (PARTITION BY cycle, id ORDER BY place) AS r FROM e) WHERE r = 1 OR id = ''""",
    ),
    "state_restore_progress": (_progress, "SELECT o_custkey AS cycle, count(*) AS total, 'a,b' AS reported FROM orders GROUP BY o_custkey"),
    "state_counters": (
        _counters,
        f"""WITH {B.ITEMS_DOCS}, c AS (SELECT count(*) AS n, count(relevance_score) AS rated FROM items)
            SELECT unnest(['COMPOSED', 'FAILED', 'RECEIVED', 'SCORED', 'SUMMARIZED']) AS state, unnest([n, n - rated, n, n, rated]) AS n FROM c""",
    ),
    "control_rows_pass": (
        _controlled,
        f"""WITH {B.EVENTS}, a AS (SELECT seq, kind, source, id FROM ev UNION ALL SELECT event_id * 3, 'reset', '', NULL FROM events WHERE event_id % 250 = 0 AND event_id > 0)
            SELECT seq, CASE WHEN kind <> 'item' THEN kind END AS kind, source, CASE WHEN kind = 'item' THEN id END AS title, CASE WHEN kind = 'item' THEN 1.0 END::DOUBLE AS score FROM a WHERE seq % 11 <> 0""",
    ),
    "clients_csv_read": (
        _exported,
        """SELECT ord, CAST(c_custkey AS VARCHAR) AS atomic_site_id, 'd, ' || c_custkey || '.example' AS domain_name, '2023-01-01' AS created
            FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS ord FROM customer) WHERE c_custkey % 9 > 0""",
    ),
    "stored_ids": (
        lambda s, d: B.store(s, d).select("atomic_site_id").where("atomic_site_id <> ''"),
        f"WITH {B.STORE} SELECT atomic_site_id FROM store WHERE atomic_site_id <> ''",
    ),
    "stream_cycle_items": (
        lambda s, d: s.read.parquet(f"{_stream(s, d)}/out/kept").select("cycle", "seq", "source", "id"),
        f"""WITH {B.EVENTS} SELECT cycle, seq, source, id FROM (SELECT *, row_number() OVER (PARTITION BY cycle, id ORDER BY seq) AS r FROM ev WHERE kind = 'item') WHERE r = 1""",
    ),
    "stream_digests": (
        lambda s, d: s.read.parquet(f"{_stream(s, d)}/out/digests").select("cycle", F.col("at").alias("seq"), "digest"),
        f"""WITH {B.EVENTS}, {_DUE} SELECT cycle, place AS seq, '# Newsletter draft' || chr(10) || chr(10) || string_agg('- ' || id, chr(10) ORDER BY first_seq, rank) || chr(10) AS digest
            FROM placed WHERE rank <= 10 GROUP BY cycle, place""",
    ),
    "stream_state_snapshot": (
        lambda s, d: digest.snapshot(s, f"{_stream(s, d)}/check"),
        f"""WITH {B.EVENTS} SELECT cycle, count(DISTINCT id) AS items, count(DISTINCT CASE WHEN kind = 'done' THEN source END) AS done, CAST(4 AS BIGINT) AS total
            FROM ev WHERE cycle = (SELECT max(cycle) FROM ev) GROUP BY cycle""",
    ),
    "seen_ids": (_seen, None),
}
