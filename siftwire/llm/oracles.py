"""SQL for the operators whose whole result it can express, by plain definitions without the operators' methods."""

from __future__ import annotations

import math
from collections.abc import Sequence

from siftwire.llm import license_scan

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def op5(containment: float = 0.95) -> str:
    """Places of phrases, and each block compared with each template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in license_scan.PHRASES.items())
    sets = [(label, license_scan._tokens(text)) for label, texts in license_scan.TEMPLATES.items() for text in texts]
    templates = ", ".join(f"({_list(tokens)}, '{label}', {math.ceil(containment * len(tokens) - 1e-9)})" for label, tokens in sets)
    return rf"""WITH t AS (SELECT doc_id, {_LOWER} AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w FROM t),
phrases(p, label) AS (VALUES {phrases}),
templates(template, label, needed) AS (VALUES {templates}),
hits AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), phrases WHERE w[i : i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS low, max(i) - 1 AS high, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
blocks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM t
  UNION ALL SELECT doc_id, block FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n')) AS block FROM t) WHERE contains(block, chr(10))),
tokens AS (SELECT doc_id, list_distinct(regexp_extract_all(block, '{word}')) AS tokens FROM blocks),
met AS (SELECT doc_id, label, len(list_intersect(tokens, template)) / len(template) AS score FROM tokens, templates WHERE len(list_intersect(tokens, template)) >= needed),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM met GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(base.n, 0) AS n_base, base.low AS first_word, base.high AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.score, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


#: All pairs of one label.
OP7 = """WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""

#: Sets of shingles as texts, all pairs that share one.
OP9 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id"""

_QUANTISED = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
_USABLE = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"
_SCORE = "coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 0)::BIGINT"

#: Every anchor with all rows.
OP11 = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_QUANTISED} AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, {_SCORE} AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, positive_id ORDER BY s.s DESC, s.b)::INTEGER AS rank, s.b AS negative_id, positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * positive_score <= 100 * s.s AND 100 * s.s <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, positive_id ORDER BY s.s DESC, s.b) <= 5"""

#: Every query with all rows.
OP13 = f"""WITH v AS (SELECT vec_id, {_QUANTISED} AS e FROM embeddings WHERE {_USABLE})
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SCORE} DESC, b.vec_id)::INTEGER AS rank, b.vec_id, {_SCORE} AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SCORE} DESC, b.vec_id) <= 5"""

#: Bytes of a decimal number, then eight steps each: the checksum's polynomial, bit by bit.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, 4294967295::BIGINT), 4294967295)"""

#: Every prefix of every conversation as a text of hashes, and every node with all that are above it.
OP12 = rf"""WITH t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM t),
h AS (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
lent AS (SELECT h.c, o.k, o.w, o.pos FROM h JOIN o ON o.c = h.c - h.c % 20 WHERE o.pos < h.h),
n AS (SELECT c, count(*) AS n FROM lent GROUP BY c),
r AS (FROM lent UNION ALL SELECT o.c, o.k, o.w, o.pos - h.h + coalesce(n.n, 0) FROM o JOIN h USING (c) LEFT JOIN n USING (c) WHERE o.pos >= h.h),
s AS (SELECT h.c, coalesce(list(r.k ORDER BY r.pos) FILTER (WHERE r.k IS NOT NULL), []) AS k, coalesce(list(r.w ORDER BY r.pos) FILTER (WHERE r.k IS NOT NULL), []) AS w FROM h LEFT JOIN r USING (c) GROUP BY h.c),
m AS (SELECT c, len(k) AS n, d, array_to_string(k[1:d], '/') AS p, CASE WHEN d > 0 THEN array_to_string(k[1:d - 1], '/') END AS up, k[1:d] AS path, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM s)),
x AS (SELECT d, p, up, min(c) AS low, count(*) AS n, max(w) AS w, any_value(path) AS path, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY d, p, up),
k AS (SELECT up, d, count(*) AS n FROM x WHERE d > 0 GROUP BY up, d),
y AS (SELECT x.*, coalesce(k.n, 0) AS children FROM x LEFT JOIN k ON k.up = x.p AND k.d = x.d + 1),
z AS (SELECT above, array_to_string(path[1:above], '/') AS p, sum((children = 0)::INTEGER)::BIGINT AS leaves, sum((n - 1) * w)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS above FROM y) GROUP BY above, 2)
SELECT y.low AS conv_id, y.d AS depth, u.low AS parent_conv_id, y.n AS n_convs, y.children AS n_children, z.leaves AS n_leaves, z.saved AS saved_tokens, sha256(y.ends) AS ends_sha256
FROM y JOIN z ON z.above = y.d AND z.p = y.p LEFT JOIN y u ON u.d = y.d - 1 AND u.p = y.up"""
