"""The read and write API: what a dashboard or a command line asks for."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwire.config import PipelineConfig
from siftwire.functions.order import running
from siftwire.operators import cycles, enrich, items, reconcile
from siftwire.session import stored
from siftwire.sources import clients_csv, code_host, feed, fetch, tracker
from siftwire.streaming.digest import StateView


def counts(scored: DataFrame) -> DataFrame:
    """(source, n) in order of first arrival."""
    return items.counts_by_source(scored).orderBy("first_seq").select("source", "n")


def top(scored: DataFrame, n: int = 10) -> DataFrame:
    """(source, rank, title, score) of the best items."""
    return items.first_ranked(scored, n).select("source", "rank", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"))


def accumulated(snapshot: DataFrame, digest: DataFrame) -> DataFrame:
    """One row: accumulated items, done, total, whether complete and whether a new cycle may start, and the latest digest."""
    whole = snapshot.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "done", "total")))
    complete = (F.col("total") > 0) & (F.col("done") >= F.col("total"))
    rows = whole.select(F.col("items").alias("accumulated"), "done", "total", complete.alias("complete"), ((F.col("done") == 0) | complete).alias("may_collect"))
    return rows.crossJoin(F.broadcast(digest.select("digest").limit(1)))


def poll(scored: DataFrame, snapshot: DataFrame, digest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``counts``, ``top`` and ``accumulated`` of one state: the scored items are read once and stored for all of them."""
    once = stored(scored.select("seq", "source", "title", "score"), "poll")
    return counts(once), top(once), accumulated(snapshot, digest)


def poll_state(view: StateView, digest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of the digest stream's state: counts, best items and progress come from what it keeps, not from the log."""
    return view.counts(), view.top(), accumulated(view.snapshot(), digest)


def compose(scored: DataFrame, config: PipelineConfig, reply: str | None = None, model: Callable[[], enrich.Model] | None = None) -> DataFrame:
    """The digest of scored items with summaries: a reply that is there already, else the model's."""
    selected = items.selection(scored, config.per_source)
    return items.compose(selected, reply) if model is None else enrich.compose(selected, model, config.relevance_profile)


#: Events of one collection stay below this number of places.
PLACES = 1 << 32


def events(answers: DataFrame, start: int = 0) -> DataFrame:
    """Events of one collection from its answers: a reset, the items, the first of each id, then a done of each source.

    Places count from ``start``, so that the reset of a later collection comes after all events of an earlier one.
    """
    of = lambda source: answers.where(F.col("source") == source).select("seq", "answer")
    parts = [code_host.read(fetch.by_repository(answers)), tracker.read(of("linear")), feed.read(of("feed"))]
    # Places in order of the connectors; an answer's own places stay below 2 ** 50.
    placed = [part.withColumn("seq", F.col("seq") + F.lit(i << 50)) for i, part in enumerate(parts)]
    spark = answers.sparkSession
    sources = spark.createDataFrame([("github",), ("linear",), ("feed",)], "source string")
    rows = cycles.tick(items.first_by_id(items.union_all(placed)), sources)
    reset = spark.createDataFrame([(-1, "reset", "")], "seq long, kind string, source string")
    rows = reset.unionByName(rows, allowMissingColumns=True)
    numbered = running(rows, [], F.floor(F.col("seq") / (1 << 20)), ["seq"], F.lit(1), "__place")
    return numbered.withColumn("seq", F.col("__place") + F.lit(start - 1)).drop("__place")


def collect(spark: SparkSession, config: PipelineConfig, transport: fetch.Transport = fetch.http, start: int = 0) -> DataFrame:
    """``events`` of one collection from all configured sources.

    The answers are stored once, so that no service is called twice. A call that fails brings no items.
    """
    return events(stored(fetch.answers(spark, fetch.requests(config), transport), "answers"), start)


def collect_stream(
    spark: SparkSession, config: PipelineConfig, path: str, checkpoint: str, transport: fetch.Transport = fetch.http, clock: Callable[[], float] = time.time, interval: float = fetch.INTERVAL
) -> StreamingQuery:
    """Append the events of a collection in every time slot to a log; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "answers")
        slot = rows.agg(F.max("slot")).first()[0]
        if slot is not None:
            events(rows, slot * PLACES).write.mode("overwrite").parquet(f"{path}/batch={number}")

    asked = fetch.answer_stream(spark, fetch.requests(config), transport, clock, interval)
    return asked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regenerate(spark: SparkSession, seq: int) -> DataFrame:
    """The control row that asks for a new digest of what is collected."""
    return spark.createDataFrame([(seq, "regenerate", "")], "seq long, kind string, source string")


def import_clients(spark: SparkSession, store: DataFrame, path: str, today: str) -> tuple[DataFrame, DataFrame]:
    """(store after the import, message). A rejected file leaves the store as it is."""
    snapshot = clients_csv.read(spark, path)
    if snapshot is None:
        return store, spark.createDataFrame([(f"{path or 'no file'}: no client rows found",)], "message string")
    return reconcile.merge(store, snapshot, today), reconcile.report_text(reconcile.report(store, snapshot))
