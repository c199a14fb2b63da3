"""Feed answers (seq, answer): RSS 2.0 or Atom texts. A document with a channel is read as RSS, else as Atom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.operators import items

_RSS = "channel struct<item:array<struct<title:string,link:string,guid:string,description:string,pubDate:string,`dc:date`:string>>>"
_ATOM = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,summary:string,content:string,updated:string>>"


def _own_text(value: Column) -> Column:
    """The element's own text without nested elements."""
    return F.regexp_replace(value, r"(?s)<([A-Za-z][\w:.-]*)\b[^>]*>.*?</\1>", "")


def first_link(links: Column) -> Column:
    """The first link that is an alternate or has no relation, else the first with an address, else ''."""
    some = F.filter(F.coalesce(links, F.array()), lambda x: F.coalesce(x["_href"], F.lit("")) != "")
    plain = F.filter(some, lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate"))
    return F.coalesce(F.get(plain, 0)["_href"], F.get(some, 0)["_href"], F.lit(""))


def rss(answers: DataFrame) -> DataFrame:
    parsed = F.from_xml("answer", _RSS)
    rows = answers.select("seq", F.posexplode(parsed["channel"]["item"]).alias("at", "x"))
    native = F.coalesce(F.nullif(F.col("x.guid"), F.lit("")), F.nullif(F.col("x.link"), F.lit("")))
    when = F.coalesce(F.nullif(F.col("x.pubDate"), F.lit("")), F.col("x.dc:date"))
    rows = rows.select((F.col("seq") * 1_000_000 + F.col("at")).alias("seq"), native.alias("native_id"), _own_text(F.col("x.title")).alias("title"), F.col("x.link").alias("url"), _own_text(F.col("x.description")).alias("body"), when.alias("time"))
    return items.normalize(rows.where("native_id is not null"), "feed")


def atom(answers: DataFrame) -> DataFrame:
    parsed = F.from_xml("answer", _ATOM)
    rows = answers.select("seq", F.posexplode(parsed["entry"]).alias("at", "x"))
    url = first_link(F.col("x.link"))
    native = F.coalesce(F.nullif(F.col("x.id"), F.lit("")), F.nullif(url, F.lit("")))
    body = F.coalesce(F.nullif(F.col("x.summary"), F.lit("")), F.col("x.content"))
    rows = rows.select((F.col("seq") * 1_000_000 + F.col("at")).alias("seq"), native.alias("native_id"), "x.title", url.alias("url"), body.alias("body"), F.col("x.updated").alias("time"))
    return items.normalize(rows.where("native_id is not null"), "feed")


def read(answers: DataFrame) -> DataFrame:
    has_channel = F.from_xml("answer", "channel string")["channel"].isNotNull()
    marked = answers.withColumn("is_rss", F.coalesce(has_channel, F.lit(False)))
    return rss(marked.where("is_rss")).unionByName(atom(marked.where("not is_rss")))
