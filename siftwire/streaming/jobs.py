"""The pipeline as Structured Streaming jobs: durable logs between stages, each consumer with its own offsets.

All jobs read and write folders of Parquet or JSON lines and run what is available (``availableNow``), so that
a scheduler can start them at any pace. Folders and checkpoints belong in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwire.operators import gate, items
from siftwire.operators.logs import required, split_bad

#: The scored log's rows.
SCORED = "seq long, source string, id string, title string, url string, timestamp long, relevance_score int, reason string, summary string, score double"


def log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A durable log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append the stream to a log of Parquet files or JSON lines."""
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def summarize_and_score(stream: DataFrame, now: int) -> DataFrame:
    """Fallback summary and score of each item; the row-wise plan is that of the batch queries.

    With a column ``kind``, control rows pass as they are and rows of unknown kinds go.
    """
    rated = stream if "relevance_score" in stream.columns else stream.withColumn("relevance_score", F.lit(None).cast("int"))
    step = lambda rows: items.score(items.with_fallback_summary(rows), now)
    return items.items_only(rated, step) if "kind" in stream.columns else step(rated)


def decisions(stream: DataFrame, publishers: Callable[[], DataFrame], path: str, checkpoint: str, version: str, now: Callable[[], str]) -> StreamingQuery:
    """The gate as an observer with its own offsets: decisions as JSON lines, with the publishers of each batch's time."""

    def write(batch: DataFrame, number: int) -> None:
        decided = gate.decide(batch, publishers(), version).drop("seq").withColumn("ts", F.lit(now()))
        decided.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_dead_letters(stream: DataFrame, columns: list[str], path: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Rows that lack a required value go to the dead-letter folder, all others to the log; a batch writes the same files again."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_bad(batch, required(columns))
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completion(stream: DataFrame, total: int) -> DataFrame:
    """(cycle, done, complete) at each done of a source, from control rows (seq, cycle, kind, source) in seq order."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(state.get[0]) if state.exists else {}
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            seen[row.source] = None
            out.append((key[0], row.seq, len(seen), len(seen) >= total))
        state.update((list(seen),))
        yield pd.DataFrame(out, columns=["cycle", "seq", "done", "complete"])

    dones = stream.where("kind = 'done'")
    return dones.groupBy("cycle").applyInPandasWithState(count, "cycle long, seq long, done long, complete boolean", "sources array<string>", "append", GroupStateTimeout.NoTimeout)


def running(spark: SparkSession) -> list[str]:
    """Names or ids of the live streams."""
    return sorted(q.name or str(q.id) for q in spark.streams.active)
