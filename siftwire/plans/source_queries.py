"""Queries of connectors, model replies and logs, on raw answers built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwire.operators import enrich, logs
from siftwire.plans import bindings as B
from siftwire.sources import clients_csv, code_host, feed, tracker

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _hosted(spark, d):
    """An answer for each order: a release, a pull and two issues, some to be skipped."""
    o = B.table(spark, d, "orders")
    n = F.col("o_orderkey")
    time = F.date_format("o_orderdate", _ISO)
    empty = lambda c, cond: F.when(cond, F.lit("")).otherwise(c)
    entry = lambda **f: F.to_json(F.array(F.struct(*(v.alias(k) for k, v in f.items()))), {"ignoreNullFields": "false"})
    url = F.concat(F.lit("https://x.example/"), n)
    return o.select(
        n.alias("seq"),
        F.concat(F.lit("r/"), F.col("o_custkey")).alias("repo"),
        entry(id=n, name=empty(F.col("o_orderpriority"), n % 3 == 0), tag_name=F.concat(F.lit("v"), n), html_url=url, body=F.col("o_orderstatus"), published_at=time).alias("releases"),
        entry(number=n, title=F.col("o_orderpriority"), html_url=url, body=F.lit(None).cast("string"), merged_at=F.when(n % 2 == 0, time)).alias("pulls"),
        entry(number=n, title=F.col("o_orderpriority"), html_url=url, body=F.lit("b"), updated_at=F.when(n % 4 > 0, time), created_at=time, pull_request=F.when(n % 5 == 0, F.struct(F.lit(1).alias("u")))).alias("issues"),
    )


_HOST_COLUMNS = "'github' AS source, 'github:r/' || o_custkey || '{}' || o_orderkey AS id, {} AS title, 'https://x.example/' || o_orderkey AS url, {} AS body, CAST(epoch(o_orderdate) AS BIGINT) AS timestamp"
_RELEASES = "SELECT o_orderkey * 3000000 AS seq, " + _HOST_COLUMNS.format("#release-", "CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_orderkey ELSE o_orderpriority END", "o_orderstatus") + " FROM orders"
_PULLS = "SELECT o_orderkey * 3000000 + 1000000 AS seq, " + _HOST_COLUMNS.format("#pr-", "o_orderpriority", "''") + " FROM orders WHERE o_orderkey % 2 = 0"
_ISSUES = "SELECT o_orderkey * 3000000 + 2000000 AS seq, " + _HOST_COLUMNS.format("#issue-", "o_orderpriority", "'b'") + " FROM orders WHERE o_orderkey % 5 <> 0"


def _tracked(spark, d):
    o = B.table(spark, d, "orders")
    n = F.col("o_orderkey")
    node = F.struct(F.when(n % 6 > 0, F.concat(F.lit("ABC-"), n)).otherwise("").alias("identifier"), F.col("o_orderpriority").alias("title"), F.lit("u").alias("url"), F.col("o_orderstatus").alias("description"), F.date_format("o_orderdate", _ISO).alias("updatedAt"))
    return o.select(n.alias("seq"), F.to_json(F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("issues")).alias("data"))).alias("answer"))


def _feeds(spark, d, dialect):
    p = B.table(spark, d, "pages")
    n, url = F.col("page_id"), F.replace("url", F.lit("&"), F.lit("&amp;"))
    when = F.timestamp_seconds(F.lit(B.E0) + n * 3600)
    if dialect == "rss":
        text = F.concat(
            F.lit('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title><item><title>T &amp; '), n, F.lit("</title><link>"), url, F.lit("</link>"),
            F.when(n % 3 > 0, F.concat(F.lit('<guid isPermaLink="false">g'), n, F.lit("</guid>"))).otherwise(""),
            F.lit("<description><![CDATA[about "), n, F.lit("]]></description>"),
            F.when(n % 2 == 0, F.concat(F.lit("<pubDate>"), F.date_format(when, "EEE"), F.lit(", "), F.date_format(when, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))).otherwise(F.concat(F.lit("<dc:date>"), F.date_format(when, _ISO), F.lit("</dc:date>"))),
            F.lit("</item></channel></rss>"),
        )
    else:
        text = F.concat(
            F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T '), n, F.lit('</title><link href="https://self.example/'), n, F.lit('" rel="self"/>'),
            F.when(n % 3 > 0, F.concat(F.lit('<link href="'), url, F.lit('" rel="alternate"/>'))).otherwise(""),
            F.lit("<id>tag:"), n, F.lit("</id><content>about "), n, F.lit("</content><updated>"), F.date_format(when, _ISO), F.lit("</updated></entry></feed>"),
        )
    return p.select(n.alias("seq"), F.when(n % 10 == 9, F.lit("<rss><broken")).otherwise(text).alias("answer"))


def _csv(spark, d):
    key = F.col("c_custkey")
    rows = B.table(spark, d, "customer")
    line = F.when(key % 10 == 0, F.lit("  ")).when(key % 10 == 1, F.concat(F.lit('"'), key, F.lit('","2023"'))).otherwise(F.concat(F.lit('" '), key, F.lit('","2023-01-01","d, '), key, F.lit('.example"')))
    header = rows.limit(1).select(F.lit(0).cast("long").alias("ord"), F.lit('"Atomic Site ID","Created","Domain"').alias("line"))
    return clients_csv.parse(header.unionByName(rows.select(key.alias("ord"), line.alias("line"))))


def _replies(spark, d):
    n = F.col("doc_id")
    score = F.concat((n % 15 - 2).cast("string"), F.when(n % 2 == 0, F.lit(".6")).otherwise(""))
    body = F.concat(F.lit('{"summary": "s'), n, F.lit('", "relevance_score": '), F.when(n % 3 == 0, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score), F.lit(', "reason": 5}'))
    reply = F.when(n % 7 == 0, F.lit("no object")).when(n % 7 == 1, F.concat(body, F.lit(" and "), body)).when(n % 7 == 2, F.lit('{"summary": 5}')).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return B.table(spark, d, "documents").select("doc_id", enrich.read_reply(reply).alias("r")).select("doc_id", "r.*")


def _entity_replies(spark, d):
    n = F.col("doc_id")
    reply = F.when(n % 4 == 0, F.lit('{"orgs": "x"}')).otherwise(F.concat(F.lit('Here: {"orgs": [" Org '), n, F.lit('", 5, " ", null], "people": ["P"]}')))
    rows = B.table(spark, d, "documents").select("doc_id", enrich.read_entities(reply).alias("e"))
    return rows.select("doc_id", F.array_join("e.orgs", "|").alias("orgs"), F.array_join("e.people", "|").alias("people"), F.size("e.locations").alias("locations"))


def _prompts(spark, d):
    rows = enrich.enrich_prompt(B.items_docs(spark, d), "local news")
    content = F.get("messages", 1)["content"]
    return rows.select("seq", F.size("messages").alias("n"), F.length(content).alias("size"), F.sha2(content, 256).alias("content_sha256"))


def _segments(spark, d):
    n = F.col("event_id")
    path = F.concat(F.lit("digest."), F.when(n % 5 == 0, F.concat(n, F.lit(".tmp"))).otherwise(n.cast("string")))
    return B.table(spark, d, "events").select(path.alias("path"), F.col("event_type").alias("content"))


def _letters(spark, d):
    rows = B.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("record"))
    good, bad = logs.split_bad(rows, F.try_parse_json("record").isNotNull())
    return good.select("event_id", F.lit("log").alias("goes_to")).unionByName(bad.select("event_id", F.lit("dead_letter").alias("goes_to")))


def _stored_segments(spark, d):
    n = F.col("o_orderkey")
    return B.table(spark, d, "orders").select(F.concat(F.lit("p/"), n).alias("path"), F.concat(F.lit("log"), F.col("o_custkey") % 20).alias("log"), n.alias("number"), (n * 10).cast("double").alias("written"))


_AT = f"{B.E0} + page_id * 3600 AS timestamp"
QUERIES = {
    "github_releases": (lambda s, d: code_host.releases(_hosted(s, d)), _RELEASES),
    "github_merged_pulls": (lambda s, d: code_host.merged_pulls(_hosted(s, d)), _PULLS),
    "github_issues": (lambda s, d: code_host.issues(_hosted(s, d)), _ISSUES),
    "github_all": (lambda s, d: code_host.read(_hosted(s, d)), f"{_RELEASES} UNION ALL {_PULLS} UNION ALL {_ISSUES}"),
    "linear_issues": (
        lambda s, d: tracker.read(_tracked(s, d)),
        """SELECT o_orderkey * 1000000 AS seq, 'linear' AS source, 'linear:ABC-' || o_orderkey AS id, o_orderpriority AS title, 'u' AS url, o_orderstatus AS body,
            CAST(epoch(o_orderdate) AS BIGINT) AS timestamp FROM orders WHERE o_orderkey % 6 > 0""",
    ),
    "rss_parse": (
        lambda s, d: feed.read(_feeds(s, d, "rss")),
        f"""SELECT page_id * 1000000 AS seq, 'feed' AS source, 'feed:' || CASE WHEN page_id % 3 > 0 THEN 'g' || page_id ELSE url END AS id, 'T & ' || page_id AS title, url, 'about ' || page_id AS body, {_AT}
            FROM pages WHERE page_id % 10 <> 9""",
    ),
    "atom_parse": (
        lambda s, d: feed.read(_feeds(s, d, "atom")),
        f"""SELECT page_id * 1000000 AS seq, 'feed' AS source, 'feed:tag:' || page_id AS id, 'T ' || page_id AS title, CASE WHEN page_id % 3 > 0 THEN url ELSE 'https://self.example/' || page_id END AS url,
            'about ' || page_id AS body, {_AT} FROM pages WHERE page_id % 10 <> 9""",
    ),
    "csv_parse": (
        _csv,
        "SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS atomic_site_id, 'd, ' || c_custkey || '.example' AS domain_name, '2023-01-01' AS created FROM customer WHERE c_custkey % 10 > 1",
    ),
    "enrich_parse": (
        _replies,
        """WITH r AS (SELECT doc_id, doc_id % 7 > 2 AS good, doc_id % 15 - 2 AS w FROM documents),
            s AS (SELECT *, w + CASE WHEN doc_id % 2 = 0 THEN CASE WHEN w < 0 THEN -0.6 ELSE 0.6 END ELSE 0 END AS x FROM r)
            SELECT doc_id, CASE WHEN good THEN 's' || doc_id END AS summary, CASE WHEN good THEN CAST(trunc(greatest(0, least(10, x))) AS INTEGER) END AS relevance_score, CASE WHEN good THEN '5' END AS reason FROM s""",
    ),
    "entities_parse": (
        _entity_replies,
        """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Org ' || doc_id END AS orgs, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'P' END AS people, 0 AS locations FROM documents""",
    ),
    "prompt_enrich": (
        _prompts,
        f"WITH {B.ITEMS_DOCS} SELECT seq, 2 AS n, CAST(length(title) + length(source) + length(body) + length('Title: ' || chr(10) || 'Source: ' || chr(10) || 'Text: ' || chr(10) || 'What matters to us: local news') AS INTEGER) AS size, sha256('Title: ' || title || chr(10) || 'Source: ' || source || chr(10) || 'Text: ' || body || chr(10) || 'What matters to us: local news') AS content_sha256 FROM items",
    ),
    "latest_segment": (lambda s, d: logs.latest_segment(_segments(s, d)), "SELECT arg_max(event_type, event_id) AS digest FROM events WHERE event_id % 5 <> 0"),
    "dead_letter_split": (_letters, "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'dead_letter' ELSE 'log' END AS goes_to FROM events"),
    "log_retention": (
        lambda s, d: logs.expired(_stored_segments(s, d), 7, 5000.0, 0.0, 100000.0).select("path"),
        """SELECT path FROM (SELECT 'p/' || o_orderkey AS path, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey DESC) AS r FROM orders)
            WHERE r > 7 AND 100000 - o_orderkey * 10 >= 5000""",
    ),
}
