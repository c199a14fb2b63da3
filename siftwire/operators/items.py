"""Items: one schema for all connectors, first-row-per-id, and the rules for missing fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.functions import text as T

ITEM = "seq long, source string, id string, title string, url string, body string, timestamp long"
UNTITLED = "(untitled)"


def normalize(raw: DataFrame, source: str | Column) -> DataFrame:
    """Rows (seq, native_id, title, url, body, time) as items: missing text is '', an unreadable time is 0."""
    source = F.lit(source) if isinstance(source, str) else source
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        "seq",
        source.alias("source"),
        F.concat(source, F.lit(":"), text("native_id")).alias("id"),
        text("title").alias("title"),
        text("url").alias("url"),
        text("body").alias("body"),
        T.epoch(F.col("time")).alias("timestamp"),
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All connectors' items; a part that stands later has later ``seq``s only if the caller numbered it so."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_by_id(items: DataFrame, keys: Sequence[str] = ("id",), order: str = "seq", keep_blank: bool = False) -> DataFrame:
    """The first row of each id. Blank ids are dropped at sources, but all kept in a digest.

    The first position is a partial minimum that is joined back by position, so a hot id costs no more than
    others. ``order`` must be unique within a key.
    """
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    firsts = items.where(~blank).groupBy(*keys).agg(F.min(order).alias("__first"))
    joined = items.where(~blank).join(firsts, list(keys)).where(F.col(order) == F.col("__first")).select(items.columns)
    return joined.unionByName(items.where(blank)) if keep_blank else joined


def with_fallback_summary(items: DataFrame) -> DataFrame:
    """Summary from title and the first 80 characters of the body; the body goes, a missing title is named."""
    title = F.coalesce("title", F.lit(UNTITLED))
    summary = F.concat(title, F.lit(" — "), F.substring(F.coalesce("body", F.lit("")), 1, 80))
    return items.withColumn("summary", summary).withColumn("title", title).drop("body")


def score(items: DataFrame, now: int, text: str = "title", keywords: Sequence[str] = tuple(T.KEYWORDS)) -> DataFrame:
    """Relevance plus recency where a model rated the item, else the keyword score; the title default comes after."""
    blend = F.round(F.col("relevance_score").cast("double") + T.recency_bonus(F.col("timestamp"), now), 2)
    rated = F.col("relevance_score").isNotNull()
    scored = items.withColumn("score", F.when(rated, blend).otherwise(T.keyword_score(F.col(text), list(keywords))))
    return scored.withColumn("title", F.coalesce("title", F.lit(UNTITLED)))


# Kinds of control rows.
CONTROL = ["done", "reset", "regenerate"]


def items_only(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` on the items of rows with a ``kind`` (null: an item); control rows pass as they are, others go.

    Columns that the step adds are null in control rows, those that it drops are dropped.
    """
    kind = F.coalesce("kind", F.lit("item"))
    own = [f"__{c}" for c in rows.columns]
    done = step(rows.where(kind.isin("item", *CONTROL)).withColumns({f"__{c}": F.col(c) for c in rows.columns}))
    is_item = kind == "item"
    old = lambda c: F.when(~is_item, F.col(f"__{c}")) if f"__{c}" in own else F.lit(None)
    return done.select(*(F.when(is_item, F.col(c)).otherwise(old(c)).alias(c) for c in done.columns if c not in own))


def first_ranked(items: DataFrame, n: int = 10) -> DataFrame:
    """The n best items of each source: score descending, then arrival. A missing score counts as 0."""
    by = Window.partitionBy("source").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "seq")
    return items.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def counts_by_source(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def shares(counts: DataFrame) -> DataFrame:
    """Each source's share of all items in percent; 0 if there are none. ``counts`` has a row for each source."""
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(0.0))


def bars(top: DataFrame) -> DataFrame:
    """The score of each ranked item relative to the best of all; 0 if that is 0."""
    best = top.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("score"), F.lit(0.0))).alias("best"))
    return top.crossJoin(F.broadcast(best)).withColumn("bar", F.when(F.col("best") > 0, F.col("score") / F.col("best") * 100).otherwise(0.0))


def selection(items: DataFrame, n: int = 10) -> DataFrame:
    """The ranked items of all sources with their place: sources in order of first arrival, then rank."""
    top = first_ranked(items, n)
    firsts = items.groupBy("source").agg(F.min("seq").alias("first_seq"))
    return top.join(firsts, "source").withColumn("place", F.struct("first_seq", "rank"))


def ranked_list(selected: DataFrame, heading: str = "Newsletter draft", keys: Sequence[str] = ()) -> DataFrame:
    """A heading and a line for each selected item (n for each source), in place order: one row, or one for each value of ``keys``."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("summary", F.lit("")).alias("s")))), lambda x: F.concat(F.lit("- "), x["s"]))
    return selected.groupBy(*keys).agg(F.concat(F.lit(f"# {heading}\n\n"), F.concat_ws("\n", lines), F.lit("\n")).alias("digest"))


def digest_lines(selected: DataFrame) -> DataFrame:
    """The line that a model is given for each selected item."""
    line = F.format_string("- %s (%s, %s) %s — %s", "title", "source", T.plain_number(F.col("score")), F.coalesce("summary", F.lit("")), "url")
    return selected.select("place.first_seq", "place.rank", line.alias("line"))


def compose(selected: DataFrame, reply: str | None) -> DataFrame:
    """The model's reply as it is, unless it is missing or blank; then the ranked list."""
    plain = ranked_list(selected)
    return plain.select(F.when(~T.blank(F.lit(reply).cast("string")), F.lit(reply)).otherwise(F.col("digest")).alias("digest"))
