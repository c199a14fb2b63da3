"""Cycles: control rows in the order of events delimit what a digest collects.

Events (seq, kind, source, ...) have the kinds item, done, reset and regenerate. A reset starts a new cycle and
keeps the number of sources that must be done. A digest is due at each done from when as many distinct
sources are done as there are in total, and at each regenerate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwire.functions.order import running


def with_cycle(events: DataFrame, block: int = 100_000) -> DataFrame:
    """``cycle``: the number of resets up to the row. Resets are few: each row finds its number by its block.

    Counts of resets by block of ``seq`` are summed over the blocks, and within a block over its rows.
    """
    rows = events.withColumn("__block", F.floor(F.col("seq") / block))
    is_reset = F.when(F.col("kind") == "reset", 1).otherwise(0)
    before = F.coalesce(F.sum("resets").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("__block").agg(F.sum(is_reset).alias("resets")).select("__block", before.alias("__start"))
    within = F.sum(is_reset).over(Window.partitionBy("__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__within", within).join(starts, "__block").withColumn("cycle", (F.col("__start") + F.col("__within")).cast("long")).drop("__block", "__within", "__start")


def progress(events: DataFrame, total: int) -> DataFrame:
    """(cycle, seq, source, done, complete) at each done: distinct sources done so far in its cycle."""
    dones = events.where("kind = 'done'")
    firsts = dones.groupBy("cycle", "source").agg(F.min("seq").alias("seq")).withColumn("new", F.lit(1))
    marked = dones.join(firsts, ["cycle", "source", "seq"], "left").select("cycle", "seq", "source", F.coalesce("new", F.lit(0)).alias("new"))
    counted = running(marked, ["cycle"], F.floor(F.col("seq") / 100_000), ["seq"], F.col("new"), "done")
    return counted.select("cycle", "seq", "source", "done", (F.col("done") >= total).alias("complete"))


def due(events: DataFrame, total: int) -> DataFrame:
    """(cycle, seq): where a digest is composed."""
    return progress(events, total).where("complete").select("cycle", "seq").unionByName(events.where("kind = 'regenerate'").select("cycle", "seq"))


def collected(events: DataFrame) -> DataFrame:
    """(cycle, seq, source, id): the items that each cycle keeps, the first of each id, all without an id."""
    rows = events.where("kind = 'item'")
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    firsts = rows.where(~blank).groupBy("cycle", "id").agg(F.min("seq").alias("seq"))
    kept = rows.where(~blank).join(firsts, ["cycle", "id", "seq"], "left_semi")
    return kept.unionByName(rows.where(blank)).select("cycle", "seq", "source", "id")


def snapshot(events: DataFrame, total: int) -> DataFrame:
    """(cycle, items, done, total): what is saved of each cycle, a row each."""
    kept = collected(events).groupBy("cycle").agg(F.count("*").alias("items"))
    done = events.where("kind = 'done'").groupBy("cycle").agg(F.countDistinct("source").alias("done"))
    return kept.join(done, "cycle", "full").select("cycle", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("done", F.lit(0)).alias("done"), F.lit(total).cast("long").alias("total"))


def merge_snapshots(parts: DataFrame) -> DataFrame:
    """Partitions of a snapshot (items, done, total) as one: sums; numbers that are missing count as 0."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.try_to_number(F.col(c).cast("string"), F.lit("S999999999999")).cast("long"), F.lit(0))), F.lit(0)).alias(c)
    return parts.agg(*(total(c) for c in ("items", "done", "total")))


def tick(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Events of one collection: the items (seq, source, id, ...), then a done of each of ``sources`` (source).

    A source is done whether or not its calls succeeded; its done comes after all items.
    """
    last = items.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    place = F.row_number().over(Window.orderBy("source"))  # a handful of sources
    done = sources.select("source").distinct().withColumn("place", place).crossJoin(F.broadcast(last)).select((F.col("last") + F.col("place")).alias("seq"), "source", F.lit("done").alias("kind"))
    return items.withColumn("kind", F.lit("item")).unionByName(done, allowMissingColumns=True)


def restored_items(saved: DataFrame) -> DataFrame:
    """(cycle, at, id, item): the items of saved states (cycle, state), JSON texts of any shape.

    Entries that are no objects are dropped; of entries with one id the first stays, all without an id stay.
    ``item`` is the entry's JSON text, ``at`` its place. A state without a list of items has none.
    """
    entries = F.try_variant_get(F.try_parse_json("state"), "$.items", "array<variant>")
    rows = saved.select("cycle", F.posexplode(entries).alias("at", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    named = F.try_variant_get("x", "$.id", "variant")
    own = F.when(F.schema_of_variant(named) == "STRING", F.try_variant_get("x", "$.id", "string")).otherwise("")
    rows = rows.select("cycle", F.col("at").cast("long").alias("at"), F.coalesce(own, F.lit("")).alias("id"), F.to_json("x").alias("item"))
    firsts = rows.where("id <> ''").groupBy("cycle", "id").agg(F.min("at").alias("at"))
    return rows.where("id <> ''").join(firsts, ["cycle", "id", "at"], "left_semi").unionByName(rows.where("id = ''")).select("cycle", "at", "id", "item")


def restored_progress(saved: DataFrame) -> DataFrame:
    """(cycle, total, reported): numbers and lists of texts of saved states (cycle, state); what is neither counts as 0 or none."""
    state = F.try_parse_json("state")
    total = F.coalesce(F.try_variant_get(state, "$.total", "double").cast("long"), F.lit(0))
    sources = F.coalesce(F.try_variant_get(state, "$.reported", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(sources, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return saved.select("cycle", total.alias("total"), F.array_distinct(texts).alias("reported"))


def restored(saved: DataFrame) -> DataFrame:
    """(cycle, source): sources of a saved list that are texts; others are dropped."""
    return saved.select("cycle", F.explode("reported").alias("source")).where("source is not null").distinct()
