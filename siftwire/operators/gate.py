"""The publisher gate: which organisation is an item about?

Stages in strict order, the first that speaks wins: bypassed sources, the URL's domain, whole-word names and
aliases, named entities by similarity. Each later stage only gets the items that are left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions import text as T
from siftwire.functions.sizes import BROADCAST_ROWS, sized
from siftwire.session import checkpointed

# Sources that need no check.
BYPASS = ["github", "linear"]
DECISION = ["item_id", "decision", "atomic_site_id", "matched_on", "confidence", "reason", "config_version"]


def active(publishers: DataFrame) -> DataFrame:
    return publishers.where("status = 'active'")


def suffixes(host: Column) -> Column:
    """a.b.c as [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_hits(items: DataFrame, publishers: DataFrame) -> DataFrame:
    """(seq, host, domain, atomic_site_id): the first publisher in store order whose domain ends the host."""
    hosts = items.select("seq", T.host(F.col("url")).alias("host")).where("host <> ''")
    known = active(publishers).select(T.domain(F.col("domain_name")).alias("domain"), "ord", "atomic_site_id").where("domain <> ''")
    met = hosts.select("seq", "host", F.explode(suffixes(F.col("host"))).alias("domain")).join(sized(known), "domain")
    return met.groupBy("seq", "host").agg(F.min(F.struct("ord", "domain", "atomic_site_id")).alias("x")).select("seq", "host", "x.domain", "x.atomic_site_id")


def terms(publishers: DataFrame) -> DataFrame:
    """(ord, atomic_site_id, kind, pos, term) of active publishers: the name, then the aliases in list order."""
    name = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("pos"), T.trimmed(F.coalesce("publisher_name", F.lit(""))).alias("term"))
    aliases = F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x, i: F.struct(F.lit(1).alias("kind"), i.alias("pos"), T.trimmed(x).alias("term")))
    listed = active(publishers).select("ord", "atomic_site_id", F.explode(F.concat(F.array(name), aliases)).alias("x"))
    return listed.select("ord", "atomic_site_id", "x.*").where("term <> ''")


def _folded(words: Column) -> Column:
    """Letters that a match in any case takes for equal become equal; only for keys, which may say too much."""
    # Without a step between them, the optimiser drops the inner change of case.
    lower = F.translate(F.lower(F.replace(words, F.lit("İ"), F.lit("i"))), "ς", "σ")
    return F.when(F.octet_length(words) == F.length(words), F.lower(words)).otherwise(F.lower(F.translate(F.upper(lower), "Σ", "σ")))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def term_hits(items: DataFrame, publishers: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(seq, ord, atomic_site_id, kind, term): one row for each item and publisher found in title or body.

    A term that stands in a text as whole words has its runs of letters and digits as neighbours in the text.
    Its first two runs, or the only one, are its key. A text's distinct words and word pairs meet the terms by
    key in a hash join, whose cost for a text doesn't depend on the number of terms; the full rule is checked on
    what meets. Up to ``bound`` terms are broadcast and the text is at hand for the check; beyond that only
    (seq, key) are shuffled, and the text is joined back to what met. A name beats aliases, an earlier alias a later one.
    """
    known = terms(publishers).withColumn("key", _folded(F.array_join(F.slice(_runs(F.col("term")), 1, 2), " ")))
    small = known.limit(bound + 1).count() <= bound
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    texts = items.select("seq", body.alias("text"))
    runs = texts.select("seq", "text", _runs(F.col("text")).alias("runs"))
    pairs = F.zip_with("runs", F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    # The last run has no pair.
    words = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.col("runs"), F.array_compact(pairs))))
    if small:
        met = runs.select("seq", "text", words.alias("word")).select("seq", "text", _folded(F.col("word")).alias("key")).join(F.broadcast(known), "key")
    else:
        keys = runs.select("seq", words.alias("word")).select("seq", _folded(F.col("word")).alias("key")).distinct()
        met = keys.join(known, "key").join(texts, "seq")
    best = met.where(T.whole_word(F.col("text"), F.col("term"))).groupBy("seq", "ord", "atomic_site_id").agg(F.min(F.struct("kind", "pos", "term")).alias("x"))
    return best.select("seq", "ord", "atomic_site_id", "x.kind", "x.term")


def resolve_terms(hits: DataFrame) -> DataFrame:
    """(seq, n, ids, first): the number of publishers found, their ids in store order, and the only one's hit."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "atomic_site_id", "kind", "term")))
    grouped = hits.groupBy("seq").agg(F.count("*").alias("n"), listed.alias("l"))
    return grouped.select("seq", "n", F.array_join(F.transform("l", lambda x: x["atomic_site_id"]), ",").alias("ids"), F.get("l", 0).alias("first"))


def similar_text(a: bytes, b: bytes) -> int:
    """Bytes in common: the longest common substring first found, then the same left and right of it."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        best, at_x = 0, 0
        for i in range(len(x)):
            while i + best < len(x) and x[i : i + best + 1] in y:
                best, at_x = best + 1, i
        if best:
            at_y = y.find(x[at_x : at_x + best])
            total += best
            todo += [(x[:at_x], y[:at_y]), (x[at_x + best :], y[at_y + best :])]
    return total


def _similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    x, y = a.encode(), b.encode()
    return 1.0 if a == b else 2.0 * similar_text(x, y) / (len(x) + len(y))


def _similarities(org: pd.Series, name: pd.Series) -> pd.Series:
    """Of normalised names, 0 to 1; the order of the two matters."""
    return pd.Series([_similarity(a, b) for a, b in zip(org, name, strict=True)], dtype=float)


def similarity(org: Column | str, name: Column | str) -> Column:
    return F.pandas_udf(_similarities, "double")(org, name)


def _counts(names: list[str]) -> np.ndarray:
    """How often each byte stands in each name; counts over 255 count as 255 in names of any length."""
    out = np.zeros((len(names), 256), np.uint8)
    for i, name in enumerate(names):
        values, times = np.unique(np.frombuffer(name.encode(), np.uint8), return_counts=True)
        out[i, values] = np.minimum(times, 255)
    return out


def most_similar(orgs: list[str], names: list[str]) -> list[tuple[str, str, float]]:
    """(org, name, similarity): for each org all names with the best similarity above 0.

    Bytes in common, in any order, bound the similarity from above. Names are taken by that bound, the best
    first, until it falls below what was found.
    """
    lengths, used = np.array([len(n.encode()) for n in names]), np.zeros(256, bool)
    counts = _counts(names)
    used[:] = counts.any(axis=0)
    counts, out = counts[:, used], []
    for org, own in zip(orgs, _counts(orgs)[:, used], strict=True):
        size = len(org.encode())
        common = np.minimum(counts, own).sum(axis=1, dtype=np.int64)
        # Where a count was cut off, the shorter name bounds what is in common.
        common = np.where((own == 255).any() & (counts == 255).any(axis=1), np.minimum(lengths, size), common)
        bounds = 2.0 * common / (lengths + size)
        best, found = 0.0, []
        for i in np.argsort(-bounds, kind="stable"):
            if bounds[i] < best or bounds[i] <= 0:
                break
            s = _similarity(org, names[i])
            if s > best:
                best, found = s, [names[i]]
            elif s == best > 0:
                found.append(names[i])
        out += [(org, name, best) for name in found]
    return out


def _best_names(different: DataFrame, names: DataFrame, name_block: int, org_block: int) -> DataFrame:
    """(org, name, s): the names with the best similarity to each of the distinct ``different`` (org).

    Orgs and distinct names are dealt to blocks, and each task takes one block of both, so that neither has to fit
    anywhere as a whole; what a task returns is bounded by its blocks.
    """
    distinct = names.where("name <> ''").select("name").distinct()
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_names, n_orgs = blocks(distinct, name_block), blocks(different, org_block)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = different.select("org", place("org", n_orgs).alias("org_part"), every(n_names).alias("name_part"))
    right = distinct.select("name", place("name", n_names).alias("name_part"), every(n_orgs).alias("org_part"))
    keys = ["org_part", "name_part"]

    def compare(orgs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = most_similar(orgs["org"].tolist(), own["name"].tolist()) if len(orgs) and len(own) else []
        return pd.DataFrame(found, columns=["org", "name", "s"])

    near = checkpointed(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "org string, name string, s double"))
    return near.join(near.groupBy("org").agg(F.max("s").alias("s")), ["org", "s"]).select("org", "name", "s")


def ner_best(entities: DataFrame, publishers: DataFrame, name_block: int = 20_000, org_block: int = 500) -> DataFrame:
    """(seq, best, n, ids, first_id) for items with entities (seq, orgs): the publishers with the best similarity.

    Entities that equal a name have their best in that; only they can reach 1. Each other distinct entity meets
    the names block by block, and in a block only those whose bytes may make them better than what was found.
    """
    names = terms(publishers).select("ord", "atomic_site_id", T.normal_name(F.col("term")).alias("name"))
    orgs = entities.select("seq", F.explode("orgs").alias("org")).select("seq", T.normal_name(F.col("org")).alias("org")).where("org <> ''")
    different = orgs.select("org").distinct()
    same = different.join(names.select("name").distinct(), F.col("org") == F.col("name")).select("org", "name", F.lit(1.0).alias("s"))
    rest = different.join(same.select("org"), "org", "left_anti")
    scored = same.unionByName(_best_names(rest, names, name_block, org_block)).join(names, "name").select("org", "ord", "atomic_site_id", "s").distinct()
    by_item = orgs.distinct().join(scored, "org").groupBy("seq", "ord", "atomic_site_id").agg(F.max("s").alias("s"))
    best = by_item.groupBy("seq").agg(F.max("s").alias("best"))
    winners = by_item.join(best, "seq").where("s = best and s > 0")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "atomic_site_id"))), lambda x: x["atomic_site_id"])
    found = winners.groupBy("seq", "best").agg(F.count("*").alias("n"), listed.alias("l")).select("seq", "best", "n", F.array_join("l", ",").alias("ids"), F.get("l", 0).alias("first_id"))
    return entities.select("seq").distinct().join(found, "seq", "left").fillna({"best": 0.0, "n": 0, "ids": ""})


def band(best: DataFrame, passes: float = 0.85, ignores: float = 0.6) -> DataFrame:
    """Decisions from the unrounded best similarity: pass, hold or ignore."""
    confidence = F.round("best", 4)
    shown = T.plain_number(confidence)
    one, high, low = F.col("n") == 1, F.col("best") >= passes, F.col("best") < ignores
    return best.select(
        "seq",
        F.when(high & one, "pass").when(high, "hold").when(low, "ignore").otherwise("hold").alias("decision"),
        F.when(high & one, F.col("first_id")).alias("atomic_site_id"),
        F.when(high & one, F.lit("ner")).alias("matched_on"),
        confidence.alias("confidence"),
        F.when(high & one, F.concat(F.lit("ner:"), shown))
        .when(high, F.concat(F.lit("ner: ambiguous ("), F.col("ids"), F.lit(")")))
        .when(low, F.concat(F.lit("ner: no client match ("), shown, F.lit(")")))
        .otherwise(F.concat(F.lit("ner: low confidence ("), shown, F.lit(")")))
        .alias("reason"),
    )


def lookup(publishers: DataFrame, atomic_site_id: str) -> DataFrame:
    """The first publisher in store order with that id, or no row."""
    return publishers.where(F.col("atomic_site_id") == atomic_site_id).orderBy("ord").limit(1)


def lookups(publishers: DataFrame, ids: DataFrame) -> DataFrame:
    """The first publisher in store order of each of many ids (atomic_site_id)."""
    found = publishers.join(ids.select("atomic_site_id").distinct(), "atomic_site_id", "left_semi")
    firsts = found.groupBy("atomic_site_id").agg(F.min("ord").alias("ord"))
    return found.join(firsts, ["atomic_site_id", "ord"], "left_semi")


def decide(
    items: DataFrame, publishers: DataFrame, config_version: str = "", entities: DataFrame | Callable[[DataFrame], DataFrame] | None = None, passes: float = 0.85, ignores: float = 0.6
) -> DataFrame:
    """A decision for every item. ``entities`` (seq, orgs) is the extractor's output for items that may need it,
    or the extractor itself, which then only gets the items that no earlier stage decided."""
    none = F.lit(None).cast("string")
    open_items = items.where(~F.coalesce(F.col("source").isin(BYPASS), F.lit(False)))
    bypass = items.where(F.col("source").isin(BYPASS)).select(
        "seq", F.lit("bypass").alias("decision"), none.alias("atomic_site_id"), none.alias("matched_on"), F.lit(None).cast("double").alias("confidence"),
        F.concat(F.lit("source "), F.col("source"), F.lit(" bypasses gate")).alias("reason"),
    )
    domains = domain_hits(open_items, publishers)
    by_domain = domains.select(
        "seq", F.lit("pass").alias("decision"), "atomic_site_id", F.lit("domain").alias("matched_on"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("domain:"), F.col("host"), F.lit("->"), F.col("domain")).alias("reason"),
    )
    rest = open_items.join(domains.select("seq"), "seq", "left_anti")
    found = resolve_terms(term_hits(rest, publishers))
    on = F.when(F.col("first.kind") == 0, "name").otherwise("alias")
    one = F.col("n") == 1
    by_term = found.select(
        "seq",
        F.when(one, "pass").otherwise("hold").alias("decision"),
        F.when(one, F.col("first.atomic_site_id")).alias("atomic_site_id"),
        F.when(one, on).alias("matched_on"),
        F.when(one, 1.0).alias("confidence"),
        F.when(one, F.concat(on, F.lit(":"), F.col("first.term"))).otherwise(F.concat(F.lit("ambiguous: "), F.col("n").cast("string"), F.lit(" candidates ("), F.col("ids"), F.lit(")"))).alias("reason"),
    )
    left = rest.select("seq").join(found.select("seq"), "seq", "left_anti")
    held = lambda rows, why: rows.select("seq", F.lit("hold").alias("decision"), none.alias("atomic_site_id"), none.alias("matched_on"), F.lit(None).cast("double").alias("confidence"), F.lit(why).alias("reason"))
    if entities is None:
        by_ner = held(left, "no deterministic signal")
    else:
        if callable(entities):  # calls that cost money are made once
            entities = checkpointed(entities(rest.join(left, "seq", "left_semi")))
        some = entities.where(F.size("orgs") > 0).join(left, "seq", "left_semi")
        by_ner = band(ner_best(some, publishers), passes, ignores).unionByName(held(left.join(some.select("seq"), "seq", "left_anti"), "ner: no entities"))
    made = bypass.unionByName(by_domain).unionByName(by_term).unionByName(by_ner)
    return items.select("seq", F.coalesce("id", F.lit("")).alias("item_id")).join(made, "seq").select("seq", *DECISION[:-1], F.lit(config_version).alias("config_version"))
