"""The library's inputs as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwire.functions import text as T
from siftwire.functions.sizes import sized

E0 = 1704067200  # 2024-01-01 UTC
NOW = E0 + 30 * 86400
TODAY = "2024-02-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items; a quality label gives the relevance of some."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(sized(labels), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("seq"),
        "source",
        F.concat("source", F.lit(":"), "doc_id").alias("id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.lit("").alias("url"),
        F.col("text").alias("body"),
        (F.lit(E0) + F.col("doc_id") * 600).alias("timestamp"),
        F.expr("3 + quality * 5 + doc_id % 3 - toxic * 2").cast("int").alias("relevance_score"),
    )


ITEMS_DOCS = f"""items AS (
  SELECT d.doc_id AS seq, d.source, d.source || ':' || d.doc_id AS id, substring(split_part(d.text, chr(10), 1), 1, 80) AS title, '' AS url, d.text AS body,
    {E0} + d.doc_id * 600 AS timestamp, CAST(3 + l.quality * 5 + d.doc_id % 3 - l.toxic * 2 AS INTEGER) AS relevance_score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def items_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed items; the title is the document's."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("seq"),
        F.lit("feed").alias("source"),
        F.concat(F.lit("feed:"), "page_id").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        "url",
        F.lit("").alias("body"),
        (F.lit(E0) + F.col("page_id") * 3600).alias("timestamp"),
    )


ITEMS_PAGES = f"""pageitems AS (
  SELECT page_id AS seq, 'feed' AS source, 'feed:' || page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, '' AS body, {E0} + page_id * 3600 AS timestamp
  FROM pages)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items with repeated ids, resets before every 250th and a done after every 50th."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), "value", "ts")
    wide = {"score": F.col("value"), "timestamp": F.unix_timestamp("ts")}
    item = rows.select((F.col("event_id") * 3 + 1).alias("seq"), F.lit("item").alias("kind"), "source", F.concat("source", F.lit(":"), (F.col("event_id") % 97).cast("string")).alias("id"), *(c.alias(n) for n, c in wide.items()))
    none = [F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("timestamp")]
    reset = rows.where("event_id % 250 = 0 and event_id > 0").select((F.col("event_id") * 3).alias("seq"), F.lit("reset").alias("kind"), F.lit("").alias("source"), *none)
    done = rows.where("event_id % 50 = 49").select((F.col("event_id") * 3 + 2).alias("seq"), F.lit("done").alias("kind"), "source", *none)
    return item.unionByName(reset).unionByName(done)


EVENTS = """ev AS (
  SELECT event_id * 3 + 1 AS seq, 'item' AS kind, event_type AS source, event_type || ':' || (event_id % 97) AS id, event_id // 250 AS cycle, value AS score FROM events
  UNION ALL SELECT event_id * 3 + 2, 'done', event_type, NULL, event_id // 250, NULL FROM events WHERE event_id % 50 = 49)"""


def publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as publishers: names and aliases from their words, domains from the pages' hosts."""
    hosts = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("h")).where("h <> ''")
    last = F.array_join(F.slice(F.split("h", r"\."), -3, 3), ".")
    domains = hosts.select(F.when(F.size(F.split("h", r"\.")) > 3, last).otherwise(F.col("h")).alias("domain_name")).distinct()
    passages = table(spark, sf_dir, "benchmark")
    # As many of the first domains as there are numbers of passages.
    some = domains.orderBy("domain_name").limit((passages.agg(F.max("item_id")).first()[0] or 0) + 1)
    numbered = some.select("domain_name", (F.row_number().over(Window.orderBy("domain_name")) - 1).alias("number"))
    words = F.split("text", r"\s+")
    pick = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    rows = passages.join(sized(numbered), F.col("item_id") == F.col("number"), "left")
    return rows.select(
        F.col("item_id").alias("ord"),
        (F.lit(1000) + F.col("item_id")).cast("string").alias("atomic_site_id"),
        F.coalesce("domain_name", F.lit("")).alias("domain_name"),
        F.when(F.col("item_id") % 5 == 4, "churned").otherwise("active").alias("status"),
        pick(1, 3).alias("publisher_name"),
        F.concat(pick(4, 2), F.lit("|"), pick(6, 2)).alias("aliases"),
    )


HOST = r"regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '')"
PUBLISHERS = rf"""hosts AS (SELECT DISTINCT {HOST} AS h FROM pages),
domains AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT array_to_string(string_split(h, '.')[-3:], '.') AS d FROM hosts WHERE h <> '')),
words AS (SELECT item_id, regexp_split_to_array(text, '\s+') AS w FROM benchmark),
pubs AS (
  SELECT item_id AS ord, CAST(1000 + item_id AS VARCHAR) AS atomic_site_id, coalesce(d, '') AS domain_name, CASE WHEN item_id % 5 = 4 THEN 'churned' ELSE 'active' END AS status,
    array_to_string(w[1:3], ' ') AS publisher_name, array_to_string(w[4:5], ' ') || '|' || array_to_string(w[6:7], ' ') AS aliases
  FROM words LEFT JOIN domains ON i = item_id),
terms AS (
  SELECT ord, atomic_site_id, 0 AS kind, 0 AS pos, trim(publisher_name) AS term FROM pubs WHERE status = 'active'
  UNION ALL SELECT ord, atomic_site_id, 1, p, trim(string_split(aliases, '|')[p + 1]) FROM pubs, (VALUES (0), (1)) v(p) WHERE status = 'active'),
goodterms AS (SELECT * FROM terms WHERE term <> '')"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the publisher master."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where(key % 5 != 0)
    return rows.select(
        key.cast("string").alias("atomic_site_id"),
        F.when(key % 13 == 0, F.concat(F.lit("old"), key, F.lit(".example"))).otherwise(F.concat(F.lit("c"), key, F.lit(".example"))).alias("domain_name"),
        F.lit("2023-01-01").alias("created"),
        F.when(key % 11 == 0, "churned").otherwise("active").alias("status"),
        F.lit("2023-02-01").alias("first_seen"),
        F.lit("2023-12-01").alias("last_seen"),
        F.when(key % 11 == 0, "2023-12-15").otherwise("").alias("churned_at"),
        F.col("c_name").alias("publisher_name"),
    )


def client_snapshot(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Customers as a client snapshot; with ``repeats`` some come again later with another domain."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where(key % 7 != 0)
    made = lambda shift, mark: [(key + shift).alias("ord"), key.cast("string").alias("atomic_site_id"), F.concat(F.lit(mark), key, F.lit(".example")).alias("domain_name"), F.lit("2023-01-01").alias("created")]
    first = rows.select(*made(0, "c"))
    return first.unionByName(rows.where(key % 17 == 0).select(*made(1_000_000_000, "again"))) if repeats else first


STORE = """store AS (
  SELECT CAST(c_custkey AS VARCHAR) AS atomic_site_id, CASE WHEN c_custkey % 13 = 0 THEN 'old' ELSE 'c' END || c_custkey || '.example' AS domain_name, '2023-01-01' AS created,
    CASE WHEN c_custkey % 11 = 0 THEN 'churned' ELSE 'active' END AS status, '2023-02-01' AS first_seen, '2023-12-01' AS last_seen,
    CASE WHEN c_custkey % 11 = 0 THEN '2023-12-15' ELSE '' END AS churned_at, c_name AS publisher_name
  FROM customer WHERE c_custkey % 5 <> 0)"""
SNAPSHOT = """snap AS (SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS atomic_site_id, 'c' || c_custkey || '.example' AS domain_name, '2023-01-01' AS created FROM customer WHERE c_custkey % 7 <> 0)"""
REPEATED = """snap AS (
  SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS atomic_site_id, 'c' || c_custkey || '.example' AS domain_name, '2023-01-01' AS created FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 1000000000, CAST(c_custkey AS VARCHAR), 'again' || c_custkey || '.example', '2023-01-01' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 17 = 0)"""
