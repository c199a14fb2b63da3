"""Queries over items: normalisation, de-duplication, scores, rankings, digests and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwire.functions import text as T
from siftwire.operators import cycles, items
from siftwire.plans import bindings as B

_EVENT_ITEMS = "evitems AS (SELECT * FROM ev WHERE kind = 'item')"
# The documents here hold few of the library's own keywords, so that common words stand for them.
_WORDS = ("the", "der", "que")
_KEYWORDS = " + ".join(f"CASE WHEN regexp_matches(coalesce(body, ''), '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])') THEN 1.0 ELSE 0.0 END" for w in _WORDS)
_BONUS = f"CASE WHEN timestamp > 0 THEN 2.0 * exp(-greatest(0, {B.NOW} - timestamp) / 604800.0) ELSE 0.0 END"
_SCORED = f"""scored AS (
  SELECT *, CASE WHEN relevance_score IS NOT NULL THEN round(relevance_score + {_BONUS}, 2) ELSE CAST(round(1.0 + {_KEYWORDS}, 1) AS DOUBLE) END AS score FROM items)"""
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, seq) AS rank FROM scored) WHERE rank <= 10)"
_SUMMED = "summed AS (SELECT t.*, title || ' — ' || substring(coalesce(body, ''), 1, 80) AS summary, (SELECT min(seq) FROM scored s WHERE s.source = t.source) AS first_seq FROM top t)"
_SHOWN = r"regexp_replace(CAST(score AS VARCHAR), '\.0$', '')"


def _scored(spark, d):
    return items.score(B.items_docs(spark, d), B.NOW, "body", _WORDS)


def _selected(spark, d):
    scored = items.with_fallback_summary(_scored(spark, d))
    return items.selection(scored)


def _event_items(spark, d):
    return B.events(spark, d).where("kind = 'item'")


def _cycles(spark, d):
    return cycles.with_cycle(B.events(spark, d))


def _raw(spark, d):
    """Documents as a connector gives them: some without a title, some without a time."""
    docs = B.table(spark, d, "documents")
    time = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.date_format(F.timestamp_seconds(F.lit(B.E0) + F.col("doc_id") * 600), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    title = F.when(F.col("doc_id") % 7 > 0, F.substring_index("text", "\n", 1))
    return docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("native_id"), title.alias("title"), F.lit(None).cast("string").alias("url"), F.col("text").alias("body"), time.alias("time"))


def counts(spark, d):
    return items.counts_by_source(B.items_docs(spark, d))


QUERIES = {
    "items_normalize": (
        lambda s, d: items.normalize(_raw(s, d), "feed"),
        f"""SELECT doc_id AS seq, 'feed' AS source, 'feed:' || doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN coalesce(split_part(text, chr(10), 1), '') ELSE '' END AS title, '' AS url, coalesce(text, '') AS body,
            CASE WHEN doc_id % 5 = 0 THEN 0 ELSE {B.E0} + doc_id * 600 END AS timestamp FROM documents""",
    ),
    "items_normalize_whole": (
        lambda s, d: items.normalize(_raw(s, d), "feed"),
        f"""SELECT doc_id AS seq, 'feed' AS source, 'feed:' || doc_id AS id, CASE WHEN doc_id % 7 > 0 THEN coalesce(split_part(text, chr(10), 1), '') ELSE '' END AS title, '' AS url, coalesce(text, '') AS body,
            CASE WHEN doc_id % 5 = 0 THEN 0 ELSE {B.E0} + doc_id * 600 END AS timestamp FROM documents""",
    ),
    "items_union_all": (
        lambda s, d: items.union_all([B.items_docs(s, d).drop("relevance_score", "body"), B.items_pages(s, d).drop("body")]),
        f"WITH {B.ITEMS_DOCS}, {B.ITEMS_PAGES} SELECT seq, source, id, title, url, timestamp FROM items UNION ALL SELECT seq, source, id, title, url, timestamp FROM pageitems",
    ),
    "dedup_first_by_id": (
        lambda s, d: items.first_by_id(_event_items(s, d)).select("seq", "source", "id", "score"),
        f"WITH {B.EVENTS}, {_EVENT_ITEMS} SELECT seq, source, id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM evitems) WHERE r = 1",
    ),
    "dedup_keep_blank_ids": (
        lambda s, d: items.first_by_id(_event_items(s, d).withColumn("id", F.when(F.col("seq") % 10 == 1, "").otherwise(F.col("id"))), keep_blank=True).select("seq", "id"),
        f"""WITH {B.EVENTS}, {_EVENT_ITEMS}, b AS (SELECT seq, CASE WHEN seq % 10 = 1 THEN '' ELSE id END AS id FROM evitems)
            SELECT seq, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM b) WHERE r = 1 OR id = ''""",
    ),
    "summary_fallback": (
        lambda s, d: items.with_fallback_summary(B.items_docs(s, d).withColumn("title", F.when(F.col("seq") % 3 > 0, F.col("title")))).select("seq", "title", "summary"),
        f"""WITH {B.ITEMS_DOCS}, t AS (SELECT seq, body, CASE WHEN seq % 3 > 0 THEN title ELSE '(untitled)' END AS title FROM items)
            SELECT seq, title, title || ' — ' || substring(coalesce(body, ''), 1, 80) AS summary FROM t""",
    ),
    "score_recency": (
        lambda s, d: B.items_docs(s, d).select("seq", F.round(T.recency_bonus(F.col("timestamp"), B.NOW), 4).alias("bonus")),
        f"WITH {B.ITEMS_DOCS} SELECT seq, round({_BONUS}, 4) AS bonus FROM items",
    ),
    "score_keyword": (
        lambda s, d: B.items_docs(s, d).select("seq", T.keyword_score(F.col("body"), list(_WORDS)).alias("score")),
        f"WITH {B.ITEMS_DOCS} SELECT seq, CAST(round(1.0 + {_KEYWORDS}, 1) AS DOUBLE) AS score FROM items",
    ),
    "score_blend": (
        lambda s, d: _scored(s, d).where("relevance_score is not null").select("seq", "score"),
        f"WITH {B.ITEMS_DOCS}, {_SCORED} SELECT seq, score FROM scored WHERE relevance_score IS NOT NULL",
    ),
    "score_dispatch": (lambda s, d: _scored(s, d).select("seq", "source", "id", "score"), f"WITH {B.ITEMS_DOCS}, {_SCORED} SELECT seq, source, id, score FROM scored"),
    "counts_by_source": (counts, f"WITH {B.ITEMS_DOCS} SELECT coalesce(source, '?') AS source, count(*) AS n, min(seq) AS first_seq FROM items GROUP BY 1"),
    "accumulated_totals": (
        lambda s, d: cycles.snapshot(_cycles(s, d), 4),
        f"""WITH {B.EVENTS} SELECT cycle, count(DISTINCT id) AS items, count(DISTINCT CASE WHEN kind = 'done' THEN source END) AS done, CAST(4 AS BIGINT) AS total FROM ev GROUP BY cycle""",
    ),
    "source_share": (
        lambda s, d: items.shares(counts(s, d)).select("source", "n", "total", "sources", F.round("share", 6).alias("share")),
        f"""WITH {B.ITEMS_DOCS}, c AS (SELECT source, count(*) AS n FROM items GROUP BY source)
            SELECT source, n, CAST(sum(n) OVER () AS BIGINT) AS total, count(*) OVER () AS sources, round(n / sum(n) OVER () * 100, 6) AS share FROM c""",
    ),
    "top10_by_source": (
        lambda s, d: items.first_ranked(_scored(s, d)).select("source", "rank", "seq", "id", "title", "score"),
        f"WITH {B.ITEMS_DOCS}, {_SCORED}, {_TOP} SELECT source, CAST(rank AS INTEGER) AS rank, seq, id, title, score FROM top",
    ),
    "top_score_kpi": (
        lambda s, d: items.first_ranked(_scored(s, d)).agg(F.greatest(F.lit(0.0), F.max("score")).alias("top_score")),
        f"WITH {B.ITEMS_DOCS}, {_SCORED}, {_TOP} SELECT greatest(0.0, max(score)) AS top_score FROM top",
    ),
    "relative_bars": (
        lambda s, d: items.bars(items.first_ranked(_scored(s, d))).select("source", "rank", F.round("bar", 6).alias("bar")),
        f"WITH {B.ITEMS_DOCS}, {_SCORED}, {_TOP} SELECT source, CAST(rank AS INTEGER) AS rank, round(score / max(score) OVER () * 100, 6) AS bar FROM top",
    ),
    "top_n_digest_selection": (
        lambda s, d: _selected(s, d).select("first_seq", "rank", "seq", "summary", "score"),
        f"WITH {B.ITEMS_DOCS}, {_SCORED}, {_TOP}, {_SUMMED} SELECT first_seq, CAST(rank AS INTEGER) AS rank, seq, summary, score FROM summed",
    ),
    "digest_ranked_list": (
        lambda s, d: items.ranked_list(_selected(s, d)),
        f"""WITH {B.ITEMS_DOCS}, {_SCORED}, {_TOP}, {_SUMMED}
            SELECT '# Newsletter draft' || chr(10) || chr(10) || string_agg('- ' || summary, chr(10) ORDER BY first_seq, rank) || chr(10) AS digest FROM summed""",
    ),
    "digest_compose_lines": (
        lambda s, d: items.digest_lines(_selected(s, d)),
        f"""WITH {B.ITEMS_DOCS}, {_SCORED}, {_TOP}, {_SUMMED}
            SELECT first_seq, CAST(rank AS INTEGER) AS rank, '- ' || title || ' (' || source || ', ' || {_SHOWN} || ') ' || summary || ' — ' || url AS line FROM summed""",
    ),
    "cycle_items": (
        lambda s, d: cycles.collected(_cycles(s, d)),
        f"""WITH {B.EVENTS} SELECT cycle, seq, source, id FROM (SELECT *, row_number() OVER (PARTITION BY cycle, id ORDER BY seq) AS r FROM ev WHERE kind = 'item') WHERE r = 1""",
    ),
    "cycle_progress": (
        lambda s, d: cycles.progress(_cycles(s, d), 4),
        f"""WITH {B.EVENTS}, d AS (SELECT *, row_number() OVER (PARTITION BY cycle, source ORDER BY seq) = 1 AS new FROM ev WHERE kind = 'done'),
            p AS (SELECT cycle, seq, source, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY cycle ORDER BY seq) AS BIGINT) AS done FROM d)
            SELECT *, done >= 4 AS complete FROM p""",
    ),
    "cycle_completion": (
        lambda s, d: cycles.due(_cycles(s, d), 4),
        f"""WITH {B.EVENTS}, d AS (SELECT *, row_number() OVER (PARTITION BY cycle, source ORDER BY seq) = 1 AS new FROM ev WHERE kind = 'done'),
            p AS (SELECT cycle, seq, sum(CAST(new AS INTEGER)) OVER (PARTITION BY cycle ORDER BY seq) AS done FROM d) SELECT cycle, seq FROM p WHERE done >= 4""",
    ),
    "snapshot_merge": (
        lambda s, d: cycles.merge_snapshots(cycles.snapshot(_cycles(s, d), 4)),
        f"""WITH {B.EVENTS}, c AS (SELECT cycle, count(DISTINCT id) AS items, count(DISTINCT CASE WHEN kind = 'done' THEN source END) AS done FROM ev GROUP BY cycle)
            SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(done) AS BIGINT) AS done, CAST(4 * count(*) AS BIGINT) AS total FROM c""",
    ),
}
