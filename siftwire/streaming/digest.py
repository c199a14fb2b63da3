"""The digest as one stream: accumulate, count finished sources, compose, reset, save and restore.

Events (seq, kind, source, id, ...) have the kinds item, done, reset and regenerate. Items are dealt to buckets by
their id; control events go to every bucket, so that each knows the cycle and the finished sources by itself and
no bucket waits for another. A bucket keeps, in typed state: the number of the cycle, the finished sources, the
ids seen, all items, and for each source the count, the first place and the best items. Where a digest is due,
each bucket gives its best items of each source, at most ``per_source``, and the batch makes one digest of them.

Within a batch a bucket takes its rows by seq; a later batch must not have earlier rows. What is due, kept and
composed is that of the batch operators in ``cycles`` and ``items`` on all events so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from siftwire.operators import cycles, items
from siftwire.session import stored

EVENT = "seq long, kind string, source string, id string, title string, url string, timestamp long, summary string, score double"
_ITEM = [f.split()[0] for f in EVENT.split(", ") if not f.startswith("kind")]
ITEM = ", ".join(f for f in EVENT.split(", ") if not f.startswith("kind"))
BEST = f"n long, first_seq long, top array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"
OUTPUT = f"bucket int, what string, cycle long, at long, done long, complete boolean, first_seq long, {ITEM}"
#: Rows that a bucket gives out at a time.
ROWS = 20_000
#: State variables need this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_ID, _SCORE = _ITEM.index("id"), _ITEM.index("score")


def _rank(item: tuple) -> tuple:
    """The best item has the largest value: score, a missing one is 0, then the earlier place."""
    return (item[_SCORE] or 0.0, -item[0])


class DigestState(StatefulProcessor):
    """One bucket. See the module for its state and its rows."""

    def __init__(self, total: int, per_source: int):
        self.default_total, self.per_source = total, per_source

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cycle = handle.getValueState("cycle", "cycle long, total long")
        self.reported = handle.getMapState("reported", "source string", "seq long")
        self.seen = handle.getMapState("seen", "id string", "seq long")
        self.items = handle.getListState("items", ITEM)
        self.best = handle.getMapState("best", "source string", BEST)

    def close(self) -> None:
        pass

    def _position(self) -> tuple[int, int]:
        return tuple(self.cycle.get()) if self.cycle.exists() else (0, self.default_total)

    def _begin(self, stored: bool) -> None:
        """A cycle's rows of one batch, in memory until ``_save``; ``stored``: the state has earlier rows of the cycle.

        Each call of the state is a message to the JVM, so what a cycle loses at a reset in the same batch never gets there.
        """
        self.stored, self.ask = stored, stored and self.seen.exists()
        self.new_sources: dict[str, int] = {}
        self.new_ids: dict[str, int] = {}
        self.new_items: list[tuple] = []
        # Of each source: number, first place, best items so far, items not yet compared with these.
        self.ranked: dict[str, list] = {}
        self.changed: set[str] = set()
        self.done = {k[0] for k in self.reported.keys()} if stored else set()
        if stored:
            self.ranked = {k[0]: [n, first, [*map(tuple, top)], []] for k, (n, first, top) in self.best.iterator()}

    def _accept(self, row: tuple) -> bool:
        """Whether the cycle keeps the row."""
        key = row[_ID] or ""
        if key:
            if key in self.new_ids or (self.ask and self.seen.containsKey((key,))):
                return False
            self.new_ids[key] = row[0]
        self.new_items.append(row)
        source = row[1] if row[1] is not None else "?"
        own = self.ranked.get(source)
        if own is None:
            own = self.ranked[source] = [0, row[0], [], []]
        own[0] += 1
        if row[0] < own[1]:
            own[1] = row[0]
        own[3].append(row)
        if len(own[3]) >= 1000:
            self._top(source)
        self.changed.add(source)
        return True

    def _top(self, source: str) -> list[tuple]:
        own = self.ranked[source]
        if own[3]:
            own[2], own[3] = heapq.nlargest(self.per_source, [*own[2], *own[3]], key=_rank), []
        return own[2]

    def _report(self, source: str, seq: int) -> int:
        """The number of finished sources, this one counted."""
        if source not in self.done:
            self.done.add(source)
            self.new_sources[source] = seq
        return len(self.done)

    def _save(self) -> None:
        if not self.stored:
            for state in (self.reported, self.seen, self.items, self.best):
                state.clear()
        for source, seq in self.new_sources.items():
            self.reported.updateValue((source,), (seq,))
        for name, seq in self.new_ids.items():
            self.seen.updateValue((name,), (seq,))
        if self.new_items:
            self.items.appendList(self.new_items)
        for source in self.changed:
            self.best.updateValue((source,), (*self.ranked[source][:2], self._top(source)))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of a snapshot: (cycle, total, reported) and items."""
        self._begin(True)
        for row in initialState.itertuples():
            self.cycle.update((int(row.cycle), int(row.total)))
            if row.reported is not None:
                self._report(row.reported, 0)
        for row in _tuples(initialState[initialState["reported"].isna() & initialState["seq"].notna()]):
            self._accept(row)
        self._save()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        kinds, items_ = batch["kind"].tolist(), _tuples(batch)
        cycle, total = self._position()
        out: list[tuple] = []
        nothing = (None,) * len(_ITEM)
        self._begin(True)
        for kind, row in zip(kinds, items_, strict=True):
            if kind == "item":
                if self._accept(row):
                    out.append((key[0], "kept", cycle, row[0], None, None, None, *row))
                continue
            due = kind == "regenerate"
            if kind == "reset":
                cycle += 1
                self._begin(False)
            elif kind == "done":
                done = self._report(row[1] or "", row[0])
                due = done >= total
                if key[0] == 0:
                    out.append((key[0], "progress", cycle, row[0], done, due, None, None, row[1], *nothing[2:]))
            if due:
                out.append((key[0], "due", cycle, row[0], None, None, None, *nothing))
                for source, own in self.ranked.items():
                    out.extend((key[0], "part", cycle, row[0], None, None, own[1], *item) for item in self._top(source))
            if len(out) >= ROWS:
                yield _made(out)
                out = []
        self._save()
        self.cycle.update((cycle, total))
        yield _made(out)


def _made(out: list[tuple]) -> pd.DataFrame:
    """Rows of OUTPUT; whole numbers stay whole beside missing ones."""
    columns = [f.split()[0] for f in OUTPUT.split(", ")]
    values = np.empty((len(out), len(columns)), dtype=object)
    if out:
        values[:] = out
    return pd.DataFrame(values, columns=columns, copy=False)


def _tuples(rows: pd.DataFrame) -> list[tuple]:
    """Items as plain values, missing ones None."""
    lists = []
    for c in _ITEM:
        number = {"seq": int, "timestamp": int, "score": float}.get(c)
        lists.append([None if x is None or x != x else number(x) if number else x for x in rows[c].tolist()])
    return list(zip(*lists, strict=True))


def _bucketed(events: DataFrame, buckets: int) -> DataFrame:
    own = F.array(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.when(F.coalesce("id", F.lit("")) == "", F.col("seq"))), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    names = [f.split()[0] for f in EVENT.split(", ")]
    return events.where(F.col("kind").isin("item", *items.CONTROL)).select(*names, F.explode(F.when(F.col("kind") == "item", own).otherwise(every)).alias("bucket"))


def restored(saved: DataFrame, buckets: int) -> DataFrame:
    """The state that a stream starts from, out of one saved state (cycle, state), a JSON text of any shape."""
    head = cycles.restored_progress(saved)
    entry = F.from_json("item", ITEM)
    # What is restored came before all events.
    place = F.coalesce(F.try_variant_get(F.try_parse_json("item"), "$.seq", "long"), F.col("at") - F.lit(1 << 40))
    own = cycles.restored_items(saved).select("cycle", place.alias("seq"), F.col("id"), *(entry[c].alias(c) for c in _ITEM if c not in ("seq", "id")), F.lit("item").alias("kind"))
    dealt = _bucketed(own.drop("cycle"), buckets).drop("kind").withColumn("reported", F.lit(None).cast("string"))
    none = [F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in ITEM.split(", ")]
    sources = head.select(F.explode_outer("reported").alias("reported")).select(*none, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "reported")
    one = head.select("cycle", "total")
    return dealt.select(*_ITEM, "bucket", "reported").unionByName(sources).crossJoin(F.broadcast(one))  # one saved state


def digest_rows(events: DataFrame, total: int, *, buckets: int = 16, per_source: int = 10, saved: DataFrame | None = None) -> DataFrame:
    """The stream of OUTPUT rows: items kept, progress, where a digest is due, and the buckets' parts of it."""
    start = None if saved is None else restored(saved, buckets).groupBy("bucket")
    grouped = _bucketed(events, buckets).groupBy("bucket")
    return grouped.transformWithStateInPandas(DigestState(total, per_source), outputStructType=StructType.fromDDL(OUTPUT), outputMode="Append", timeMode="None", initialState=start)


def composed(rows: DataFrame, per_source: int = 10) -> DataFrame:
    """(cycle, at, digest) of the parts that the buckets gave: the best of each source, sources by first arrival."""
    keys = ["cycle", "at"]
    parts = rows.where("what = 'part'")
    by = Window.partitionBy(*keys, "source").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "seq")
    firsts = Window.partitionBy(*keys, "source")
    ranked = parts.withColumn("first_seq", F.min("first_seq").over(firsts)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_source)
    lists = items.ranked_list(ranked.withColumn("place", F.struct("first_seq", "rank")), keys=keys)
    empty = items.ranked_list(rows.where("false").select(F.lit("").alias("summary"), F.struct(F.lit(0)).alias("place"))).select(F.col("digest").alias("none"))
    due = rows.where("what = 'due'").select(*keys).distinct()
    return due.join(lists, keys, "left").crossJoin(F.broadcast(empty)).select(*keys, F.coalesce("digest", "none").alias("digest"))  # empty: one row


def run(events: DataFrame, total: int, folder: str, checkpoint: str, *, buckets: int = 16, per_source: int = 10, saved: DataFrame | None = None) -> StreamingQuery:
    """Write items kept, progress and digests to ``folder``; a batch that is run again writes the same files again."""

    def write(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "digest-batch")
        rows.where("what = 'kept'").select("cycle", *_ITEM).write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
        rows.where("what = 'progress'").select("cycle", F.col("at").alias("seq"), "source", "done", "complete").write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")
        composed(rows, per_source).write.mode("overwrite").parquet(f"{folder}/digests/batch={number}")

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    made = digest_rows(events, total, buckets=buckets, per_source=per_source, saved=saved)
    return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


# What is read from the state, and not from the logs.


def _state(spark: SparkSession, checkpoint: str, name: str, version: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    return (reader if version is None else reader.option("batchId", version)).load()


def version(spark: SparkSession, checkpoint: str) -> int:
    """The last batch whose state is there; -1 before the first."""
    found = spark.read.format("state-metadata").option("path", checkpoint).load().agg(F.max("maxBatchId")).first()[0]
    return -1 if found is None else found


def snapshot(spark: SparkSession, checkpoint: str, at: int | None = None) -> DataFrame:
    """(cycle, items, done, total) of the stream's state after a batch, one row."""
    read = lambda name: _state(spark, checkpoint, name, at)
    head = read("cycle").agg(F.max("value.cycle").alias("cycle"), F.max("value.total").alias("total"))
    count = read("best").agg(F.coalesce(F.sum("user_map_value.n"), F.lit(0)).alias("items"))
    done = read("reported").agg(F.count_distinct("user_map_key.source").alias("done"))
    return head.crossJoin(F.broadcast(count)).crossJoin(F.broadcast(done)).select("cycle", "items", "done", "total")  # a row each


class StateView:
    """Reads of one stream's state that ask the same version are made once."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.checkpoint = spark, checkpoint
        self.known: dict[str, tuple[int, DataFrame]] = {}

    def _once(self, name: str, make: Callable[[int], DataFrame]) -> DataFrame:
        now = version(self.spark, self.checkpoint)
        if name not in self.known or self.known[name][0] != now:
            self.known[name] = (now, stored(make(now), name))
        return self.known[name][1]

    def snapshot(self) -> DataFrame:
        return self._once("snapshot", lambda now: snapshot(self.spark, self.checkpoint, now))

    def _best(self) -> DataFrame:
        return self._once("best", lambda now: _state(self.spark, self.checkpoint, "best", now).select("user_map_key.source", "user_map_value.*"))

    def counts(self) -> DataFrame:
        """(source, n) in order of first arrival: sums over the buckets."""
        return self._best().groupBy("source").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq")).orderBy("first_seq").select("source", "n")

    def top(self, n: int = 10) -> DataFrame:
        """(source, rank, title, score): of each bucket's best items the best."""
        rows = self._best().select(F.explode("top").alias("x")).select("x.*")
        ranked = items.first_ranked(rows, n)
        return ranked.select("source", "rank", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"))

    def items(self) -> DataFrame:
        """All items of the cycle."""
        return self._once("items", lambda now: _state(self.spark, self.checkpoint, "items", now).select("list_element.*"))
