"""Queries of the publisher gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwire.functions import text as T
from siftwire.operators import gate
from siftwire.plans import bindings as B

_EDGE, _END = r"(^|[^\p{L}\p{N}])", r"($|[^\p{L}\p{N}])"
_DOMAIN_HITS = f"""h AS (SELECT seq, {B.HOST} AS host FROM pageitems),
m AS (SELECT seq, host, regexp_replace(lower(trim(domain_name)), '^www\\.', '') AS domain, ord, atomic_site_id FROM h, pubs
  WHERE status = 'active' AND domain_name <> '' AND host <> '' AND (host = domain_name OR ends_with(host, '.' || domain_name))),
dh AS (SELECT seq, host, arg_min(domain, ord) AS domain, arg_min(atomic_site_id, ord) AS atomic_site_id FROM m GROUP BY seq, host)"""
_TERM_HITS = f"""t AS MATERIALIZED (SELECT seq, coalesce(title, '') || ' ' || coalesce(body, '') AS text FROM items),
pre AS MATERIALIZED (SELECT * FROM t, goodterms WHERE contains(lower(text), lower(term))),
hit AS (SELECT seq, ord, atomic_site_id, kind, pos, term FROM pre WHERE regexp_matches(text, '(?i){_EDGE}' || regexp_escape(term) || '{_END}')),
th AS (SELECT seq, ord, atomic_site_id, kind, term FROM (SELECT *, row_number() OVER (PARTITION BY seq, ord ORDER BY kind, pos) AS r FROM hit) WHERE r = 1)"""
_RESOLVED = """rs AS (SELECT seq, count(*) AS n, string_agg(atomic_site_id, ',' ORDER BY ord) AS ids, min(atomic_site_id) AS one, min(kind) AS kind, min(term) AS term FROM th GROUP BY seq)"""
_DECIDED = """SELECT i.seq, i.id AS item_id,
  CASE WHEN n = 1 THEN 'pass' ELSE 'hold' END AS decision, CASE WHEN n = 1 THEN one END AS atomic_site_id,
  CASE WHEN n = 1 THEN CASE WHEN kind = 0 THEN 'name' ELSE 'alias' END END AS matched_on, CASE WHEN n = 1 THEN 1.0::DOUBLE END AS confidence,
  CASE WHEN n = 1 THEN CASE WHEN kind = 0 THEN 'name:' ELSE 'alias:' END || term WHEN n > 1 THEN 'ambiguous: ' || n || ' candidates (' || ids || ')' ELSE 'no deterministic signal' END AS reason,
  'v1' AS config_version FROM items i LEFT JOIN rs USING (seq)"""


# The similarity of two names by its rule: bytes as characters, one each; the longest common substring that comes first,
# then what is left and right of it. A row of ``cut`` is a pair of pieces and the place where they are cut.
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '^the\s+', ''), '\s+', ' ', 'g'))"
_BYTES = "array_to_string(list_transform(range(0, length(hex(encode({0}))) // 2), lambda k: chr(256 + ('0x' || hex(encode({0}))[2 * k + 1 : 2 * k + 2])::INTEGER)), '')"
_LONGEST = """list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(range(1, length(x) - i + 2), lambda l: contains(y, substring(x, i, l))), lambda l: {'l': l, 'i': -i}))))"""
_SIMILARITY = f"""org AS (SELECT DISTINCT seq, {_NORMAL.format("array_to_string(regexp_split_to_array(title, '[ ' || chr(9) || chr(10) || ']+')[1:2], ' ')")} AS org FROM pageitems),
name AS (SELECT ord, atomic_site_id, {_NORMAL.format('term')} AS name FROM goodterms),
pair AS (SELECT o.org, n.name, {_BYTES.format('o.org')} AS x, {_BYTES.format('n.name')} AS y FROM (SELECT DISTINCT org FROM org WHERE org <> '') o, (SELECT DISTINCT name FROM name WHERE name <> '') n),
cut(org, name, x, y, c) AS (
  SELECT org, name, x, y, {_LONGEST} FROM pair
  UNION ALL SELECT org, name, x, y, {_LONGEST} FROM (
    SELECT org, name, substring(x, 1, -c.i - 1) AS x, split_part(y, substring(x, -c.i, c.l), 1) AS y FROM cut WHERE c IS NOT NULL
    UNION ALL SELECT org, name, substring(x, c.l - c.i), substring(y, strpos(y, substring(x, -c.i, c.l)) + c.l) FROM cut WHERE c IS NOT NULL)
  WHERE x <> '' AND y <> ''),
same AS (SELECT org, name, sum(c.l) AS common FROM cut WHERE c IS NOT NULL GROUP BY org, name),
sim AS (SELECT pair.org, pair.name, CASE WHEN pair.org = pair.name THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (length(x) + length(y)) END::DOUBLE AS s FROM pair LEFT JOIN same USING (org, name)),
per AS (SELECT seq, ord, atomic_site_id, max(s) AS s FROM org JOIN sim USING (org) JOIN name USING (name) GROUP BY seq, ord, atomic_site_id),
best AS (SELECT seq, max(s) AS best FROM per GROUP BY seq),
won AS (SELECT seq, best, count(*) AS n, string_agg(atomic_site_id, ',' ORDER BY ord) AS ids, arg_min(atomic_site_id, ord) AS one FROM per JOIN best USING (seq) WHERE s = best AND s > 0 GROUP BY seq, best),
band AS (SELECT DISTINCT seq, coalesce(best, 0.0) AS best, coalesce(n, 0) AS n, ids, one, regexp_replace(round(coalesce(best, 0.0), 4)::VARCHAR, '\\.0$', '') AS shown FROM org LEFT JOIN won USING (seq))"""
_NER_DECIDED = """SELECT i.seq, i.id AS item_id,
  CASE WHEN dh.seq IS NOT NULL OR rs.n = 1 THEN 'pass' WHEN rs.n > 1 THEN 'hold' WHEN best >= 0.85 AND band.n = 1 THEN 'pass' WHEN best >= 0.85 THEN 'hold' WHEN best < 0.6 THEN 'ignore' ELSE 'hold' END AS decision,
  CASE WHEN dh.seq IS NOT NULL THEN dh.atomic_site_id WHEN rs.n = 1 THEN rs.one WHEN rs.n > 1 THEN NULL WHEN best >= 0.85 AND band.n = 1 THEN band.one END AS atomic_site_id,
  CASE WHEN dh.seq IS NOT NULL THEN 'domain' WHEN rs.n = 1 THEN CASE WHEN kind = 0 THEN 'name' ELSE 'alias' END WHEN rs.n > 1 THEN NULL WHEN best >= 0.85 AND band.n = 1 THEN 'ner' END AS matched_on,
  CASE WHEN dh.seq IS NOT NULL OR rs.n = 1 THEN 1.0 WHEN rs.n > 1 THEN NULL ELSE round(best, 4) END::DOUBLE AS confidence,
  CASE WHEN dh.seq IS NOT NULL THEN 'domain:' || host || '->' || domain
    WHEN rs.n = 1 THEN CASE WHEN kind = 0 THEN 'name:' ELSE 'alias:' END || term WHEN rs.n > 1 THEN 'ambiguous: ' || rs.n || ' candidates (' || rs.ids || ')'
    WHEN best >= 0.85 AND band.n = 1 THEN 'ner:' || shown WHEN best >= 0.85 THEN 'ner: ambiguous (' || band.ids || ')' WHEN best < 0.6 THEN 'ner: no client match (' || shown || ')'
    ELSE 'ner: low confidence (' || shown || ')' END AS reason,
  'v1' AS config_version FROM items i LEFT JOIN dh USING (seq) LEFT JOIN rs USING (seq) JOIN band USING (seq)"""


def _lookups(spark, d):
    """Every tenth publisher, looked up by its id."""
    pubs = B.publishers(spark, d)
    return gate.lookups(pubs, pubs.where("ord % 10 = 0").select("atomic_site_id")).select("ord", "atomic_site_id", "publisher_name")


def _entities(spark, d):
    words = F.split("title", r"\s+")
    return B.items_pages(spark, d).select("seq", F.array(F.array_join(F.slice(words, 1, 2), " ")).alias("orgs"))


def _bypass(spark, d):
    source = F.when(F.col("seq") % 3 == 0, "github").when(F.col("seq") % 3 == 1, "linear").otherwise("feed")
    return B.items_pages(spark, d).withColumn("source", source).withColumn("url", F.lit("")).withColumn("title", F.lit("")), B.publishers(spark, d)


QUERIES = {
    "gate_bypass": (
        lambda s, d: gate.decide(*_bypass(s, d), "v1").select("seq", "decision", "reason"),
        """SELECT page_id AS seq, CASE WHEN page_id % 3 < 2 THEN 'bypass' ELSE 'hold' END AS decision,
            CASE page_id % 3 WHEN 0 THEN 'source github bypasses gate' WHEN 1 THEN 'source linear bypasses gate' ELSE 'no deterministic signal' END AS reason FROM pages""",
    ),
    "gate_active_publishers": (lambda s, d: gate.active(B.publishers(s, d)), f"WITH {B.PUBLISHERS} SELECT * FROM pubs WHERE status = 'active'"),
    "gate_host": (lambda s, d: B.items_pages(s, d).select("seq", T.host(F.col("url")).alias("host")), f"SELECT page_id AS seq, {B.HOST} AS host FROM pages"),
    "gate_domain_match": (
        lambda s, d: gate.domain_hits(B.items_pages(s, d), B.publishers(s, d)),
        f"WITH {B.PUBLISHERS}, {B.ITEMS_PAGES}, {_DOMAIN_HITS} SELECT * FROM dh",
    ),
    "gate_candidates": (lambda s, d: gate.terms(B.publishers(s, d)), f"WITH {B.PUBLISHERS} SELECT ord, atomic_site_id, kind, pos, term FROM goodterms"),
    "gate_term_hits": (
        lambda s, d: gate.term_hits(B.items_docs(s, d), B.publishers(s, d)),
        f"WITH {B.PUBLISHERS}, {B.ITEMS_DOCS}, {_TERM_HITS} SELECT * FROM th",
    ),
    "gate_resolution": (
        lambda s, d: gate.resolve_terms(gate.term_hits(B.items_docs(s, d), B.publishers(s, d))).select("seq", "n", "ids"),
        f"WITH {B.PUBLISHERS}, {B.ITEMS_DOCS}, {_TERM_HITS}, {_RESOLVED} SELECT seq, n, ids FROM rs",
    ),
    "gate_decisions": (
        lambda s, d: gate.decide(B.items_docs(s, d), B.publishers(s, d), "v1"),
        f"WITH {B.PUBLISHERS}, {B.ITEMS_DOCS}, {_TERM_HITS}, {_RESOLVED} {_DECIDED}",
    ),
    "gate_decisions_by_domain": (
        lambda s, d: gate.decide(B.items_pages(s, d), B.publishers(s, d), "v1").where("matched_on = 'domain'"),
        f"""WITH {B.PUBLISHERS}, {B.ITEMS_PAGES}, {_DOMAIN_HITS}
            SELECT seq, 'feed:' || seq AS item_id, 'pass' AS decision, atomic_site_id, 'domain' AS matched_on, 1.0::DOUBLE AS confidence, 'domain:' || host || '->' || domain AS reason, 'v1' AS config_version FROM dh""",
    ),
    "gate_ner_banding": (
        lambda s, d: gate.decide(B.items_pages(s, d), B.publishers(s, d), "v1", _entities(s, d)),
        f"WITH RECURSIVE {B.PUBLISHERS}, {B.ITEMS_PAGES}, {_DOMAIN_HITS}, items AS (SELECT * FROM pageitems), {_TERM_HITS}, {_RESOLVED}, {_SIMILARITY} {_NER_DECIDED}",
    ),
    "publisher_lookup": (_lookups, f"WITH {B.PUBLISHERS} SELECT ord, atomic_site_id, publisher_name FROM pubs WHERE ord % 10 = 0"),
    "name_normalize": (
        lambda s, d: B.table(s, d, "benchmark").select("item_id", T.normal_name(F.col("text")).alias("name")),
        r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '[^\p{L}\p{N}\s]+', ' ', 'g'), '^the\s+', ''), '\s+', ' ', 'g')) AS name FROM benchmark""",
    ),
    "name_normalize_whole": (
        lambda s, d: B.table(s, d, "benchmark").select("item_id", T.normal_name(F.col("text")).alias("name")),
        r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '[^\p{L}\p{N}\s]+', ' ', 'g'), '^the\s+', ''), '\s+', ' ', 'g')) AS name FROM benchmark""",
    ),
}
