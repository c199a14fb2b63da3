"""Items whose id is not among the last ids of their source: a bounded memory, first in, first out, in many tasks.

A source's remembered ids are numbered in the order in which they came in. An id is remembered while fewer than
``remembered`` others came in after it; a repeat of a remembered id is dropped and doesn't make it younger. Whether
a row is fresh thus depends on how many fresh rows of its source stand before it, and those on the rows before
them. Rows are dealt in their order to blocks of about ``BLOCK``, and a source's blocks are gone through row by row,
all at once, each from the memory that an assumption about who is fresh leaves before it. What comes out is the next
assumption. Up to a source's first block with a change nothing can change any more: only the blocks after it are
gone through again, until there are none. A memory soon holds what its own block brought, so that mostly two or three
rounds do. For rows that carry an early change far along, the stretches that one task goes through grow eightfold
with each round from the third on: the rounds grow with the logarithm of the rows, and a task's last stretch is the
plain loop over what is left of the source.

A source with most rows is spread over its blocks. Only ids and places are handled; the items themselves are joined
back by (source, seq) at last. The memory is a table for each batch, so that a batch that is run again starts from the same.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwire.functions.order import running
from siftwire.session import stored

MEMORY = "source string, id string, place long"
#: Rows of one block.
BLOCK = 65_536
#: By how much stretches grow from the third round on.
GROWTH = 8


def fresh_ids(keys: DataFrame, memory: DataFrame, remembered: int = 2000, block: int = BLOCK) -> DataFrame:
    """(source, seq, id, place): the rows of ``keys`` (source, seq, id) whose id is not remembered, with the id's new number.

    ``memory`` (source, id, place) has the ids remembered before. Rows are taken by seq, then id; equal rows are one.
    Rows without a source or an id are left out.
    """
    rows = keys.select("source", "seq", "id").where("source is not null and id is not null").distinct()
    count = memory.groupBy("source").agg(F.max("place").alias("start"))
    held = memory.groupBy("source", "id").agg(F.max("place").alias("place")).join(count, "source")
    times = rows.groupBy("source", "id").agg(F.count("*").alias("times"), F.min("seq").alias("first"))
    known = rows.join(times.join(held, ["source", "id"], "left"), ["source", "id"])
    # The first assumption: nothing that comes in is forgotten.
    forgotten = F.coalesce(F.col("start") - F.col("place") >= remembered, F.lit(True))
    # A single row of an id that isn't in the memory is fresh whatever the others are.
    open_ = (F.col("times") > 1) | F.col("place").isNotNull()
    flags = stored(known.select("source", "seq", "id", open_.alias("open"), ((F.col("first") == F.col("seq")) & forgotten).alias("fresh")), "seen-rows")
    blocks = -(-flags.count() // block)
    if blocks > 1:
        flags = stored(flags.repartitionByRange(blocks, "source", "seq", "id").withColumn("block", F.spark_partition_id().cast("long")), "seen-blocks")
    else:
        flags = flags.withColumn("block", F.lit(0).cast("long"))
    after = stored(flags.where("open").groupBy("source").agg((F.min("block") - 1).alias("after")), "seen-open")
    flags = flags.drop("open")
    length, rounds = 1, 0
    while after.limit(1).count() > 0:
        flags, after = _round(flags, after, memory, remembered, length)
        rounds += 1
        length *= GROWTH if rounds > 1 else 1
    counted = running(flags.where("fresh"), ["source"], F.col("block"), ["seq", "id"], F.lit(1), "upto")
    return counted.join(count, "source", "left").select("source", "seq", "id", (F.coalesce("start", F.lit(0)) + F.col("upto")).alias("place"))


def _round(flags: DataFrame, after: DataFrame, memory: DataFrame, remembered: int, length: int) -> tuple[DataFrame, DataFrame]:
    """The rows (source, block, seq, id, fresh) judged anew in stretches of ``length`` blocks; (source, after): what is still open."""
    marked = flags.join(after, "source", "left")
    stretch = F.floor((F.col("block") - F.col("after") - 1) / length)
    again = marked.where("block > after").select("source", stretch.alias("stretch"), "block", "seq", "id", "fresh")
    settled = marked.where("after is null or block <= after").select("source", "block", "seq", "id", "fresh", F.lit(False).alias("changed"))
    before = _before(flags, again.groupBy("source", "stretch").agg(F.min("block").alias("block")), memory, remembered)
    given = again.unionByName(before.withColumns({"block": F.lit(None).cast("long"), "fresh": F.lit(None).cast("boolean")}))
    dealt = given.repartition("source", "stretch").sortWithinPartitions("source", "stretch", F.col("fresh").isNotNull(), "seq", "id")
    schema = "source string, block long, seq long, id string, fresh boolean, changed boolean"
    judged = stored(dealt.mapInArrow(_judge(remembered), schema).unionByName(settled), "seen-judged")
    still = judged.groupBy("source").agg(F.min(F.when(F.col("changed"), F.col("block"))).alias("after"), F.max("block").alias("last"))
    return judged.drop("changed"), stored(still.where("after < last").select("source", "after"), "seen-open")


def _before(flags: DataFrame, wanted: DataFrame, memory: DataFrame, remembered: int) -> DataFrame:
    """(source, stretch, seq, id): what is remembered before the ``wanted`` blocks (source, stretch, block); seq is 0 for the latest, negative before it."""
    number = flags.groupBy("source", "block").agg(F.sum(F.col("fresh").cast("long")).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    old = memory.groupBy("source").agg(F.max("place").alias("old"))
    starts = number.join(old, "source", "left").select("source", "block", "n", (F.coalesce(earlier, F.lit(0)) + F.coalesce("old", F.lit(0))).alias("start"))
    # A block's last ids are all that later ones can remember of it.
    back = F.row_number().over(Window.partitionBy("source", "block").orderBy(F.desc("seq"), F.desc("id")))
    last = flags.where("fresh").withColumn("back", back).where(F.col("back") <= remembered).join(starts, ["source", "block"])
    ids = last.select("source", "id", (F.col("start") + F.col("n") - F.col("back") + 1).alias("place")).unionByName(memory.select("source", "id", "place"))
    # The places that count, from start - remembered + 1 to start, lie in two slots.
    slot = lambda place: F.floor(place / max(remembered, 1))
    slots = F.array_distinct(F.array(slot(F.col("start") - remembered + 1), slot(F.col("start"))))
    places = wanted.join(starts, ["source", "block"]).select("source", "stretch", "start", F.explode(slots).alias("slot"))
    met = places.join(ids.withColumn("slot", slot(F.col("place"))), ["source", "slot"]).where((F.col("place") <= F.col("start")) & (F.col("place") > F.col("start") - remembered))
    return met.select("source", "stretch", (F.col("place") - F.col("start")).alias("seq"), "id")


def _judge(remembered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The plain loop over stretches, each with what is remembered before it (fresh is null), then its rows."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, queue, held, n = None, deque(), {}, 0
        for batch in batches:
            now = []
            for source, stretch, seq, name, fresh in zip(*(batch.column(c).to_pylist() for c in ("source", "stretch", "seq", "id", "fresh")), strict=True):
                if (source, stretch) != where:
                    where, queue, held, n = (source, stretch), deque(), {}, 0
                if fresh is None:
                    queue.append((seq, name))
                    held[name] = seq
                    continue
                new = name not in held
                now.append(new)
                if new:
                    n += 1
                    queue.append((n, name))
                    held[name] = n
                    while queue and queue[0][0] <= n - remembered:
                        place, oldest = queue.popleft()
                        if held.get(oldest) == place:
                            del held[oldest]
            rows = batch.filter(batch.column("fresh").is_valid())
            fresh = pa.array(now, pa.bool_())
            changed = pa.array([a != b for a, b in zip(now, rows.column("fresh").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("source", "block", "seq", "id")), fresh, changed], ["source", "block", "seq", "id", "fresh", "changed"])

    return judge


def next_memory(memory: DataFrame, fresh: DataFrame, remembered: int = 2000) -> DataFrame:
    """The ids remembered after a batch: the last ``remembered`` of each source."""
    all_ids = memory.unionByName(fresh.select("source", "id", "place")).groupBy("source", "id").agg(F.max("place").alias("place"))
    last = all_ids.groupBy("source").agg(F.max("place").alias("last"))
    return all_ids.join(last, "source").where(F.col("place") > F.col("last") - remembered).select("source", "id", "place")


def _memory(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    if batch < 0:
        return spark.createDataFrame([], MEMORY)
    return spark.read.schema(MEMORY).parquet(f"{folder}/batch={batch}")


def first_seen(stream: DataFrame, path: str, memory: str, checkpoint: str, remembered: int = 2000) -> StreamingQuery:
    """Append the stream's items (source, seq, id, ...) whose id isn't remembered to a log; blank ids are dropped.

    (source, seq) names a row of the stream; a null source is one of its own.
    """
    named = F.coalesce("source", F.lit("")).alias("source"), "seq", "id"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.coalesce("id", F.lit("")) != "")
        before = _memory(batch.sparkSession, memory, number - 1)
        found = stored(fresh_ids(rows.select(*named), before, remembered), "seen-fresh")
        next_memory(before, found, remembered).write.mode("overwrite").parquet(f"{memory}/batch={number}")
        kept = rows.withColumn("__source", F.coalesce("source", F.lit(""))).join(found.select(F.col("source").alias("__source"), "seq", "id"), ["__source", "seq", "id"], "left_semi")
        kept.select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
