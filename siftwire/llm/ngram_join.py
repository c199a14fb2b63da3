"""N-gram Jaccard join: groups of documents whose word-shingle sets have at least a given Jaccard similarity.

The method is a grouped prefix join.

1.  The occurrences of hashed shingles are counted over all documents in a table of fixed size, which gives
    one global order, rare shingles first.
2.  Every document gives the size of its set, a 128-bit key of the set, and its prefix in that order. Equal
    sets are one class; classes with the same size and prefix are one group.
3.  Groups that share a prefix shingle are candidates, by size and by the position of the shingle. Classes
    of candidate groups are expanded and verified on their whole sets. Before that, small sketches bound the
    overlap from above, so that only the texts of pairs that may link are read again.

Only connectivity is asked of large groups of copies, so a list of groups that share a shingle is first
compared with one of its members, the one with the fewest rarer shingles, the components of the links found are taken, and only pairs of members
in different components are compared after that. The member that all were compared with has no pair left and goes, and
with it each list that had two members, as most of the lists of groups that meet by chance. No link between components
is lost, and the pairs within a group of copies are never all made.

Defined results: a null text and a text without words have the empty set and link with nothing; a text with
fewer words than a shingle has one shingle, its whole sequence. The similarity bound is a whole percentage,
compared in integers. Repeated rows and equal ids are kept as rows; documents are compared by their sets, so
a null id only means that the row can't name a component. Shingles are compared by 64-bit hashes, sets by
128-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.llm import shingles
from siftwire.llm.components import components
from siftwire.llm.memory import portions, released
from siftwire.llm.sized import BROADCAST_ROWS, sized
from siftwire.session import checkpointed, stored

#: Counters of hashed shingles, whatever the corpus (4 MB); they only set the order of shingles.
COUNTER_BITS = 20
_CHUNK = 4096
#: Two sets have no more in common than the sum over the parts of the hash range of their smaller counts.
SKETCH_BITS = 6
#: A shingle counted at least so often is hot: its list may be long and is never brought together in one task.
HOT = 1000
#: Tasks over which the members of a hot list are spread.
SALTS = 64


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Occurrences of all documents' shingles in 2 ** COUNTER_BITS counters, added up in two steps."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, np.uint32)
        salt = 0
        for batch in batches:
            for part in portions(batch, batch.column("text")):
                for word in shingles.words(part.column("text").to_pylist()):
                    at = _bucket(shingles.shingles(word, width))
                    np.add.at(table, at, np.uint32(1))
                    salt ^= int(at[0]) if len(at) else 0
        if table.any():
            chunks = len(table) // _CHUNK
            yield pa.RecordBatch.from_pydict(
                {"chunk": np.arange(chunks, dtype=np.int32), "salt": np.full(chunks, salt % 64, np.int32), "counts": [c.tobytes() for c in table.astype("<u4").reshape(-1, _CHUNK)]}
            )

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, np.uint64)
        for counts in batch["counts"]:
            total += np.frombuffer(counts, "<u4")
        return pd.DataFrame({"chunk": batch["chunk"].iloc[:1], "salt": 0, "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})

    schema = "chunk int, salt int, counts binary"
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, schema)
    summed = counted.groupBy("chunk", "salt").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    table = np.zeros(1 << COUNTER_BITS, np.uint32)
    for row in summed.collect():  # 4 MB at any corpus size
        table[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], "<u4")
    return table


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, set_key, group_key, prefix, cold, sketch) of every row; a task gives each group's prefix once, else null.

    ``cold`` shingles of the prefix, its first ones, are counted less than HOT times in the corpus.
    ``sketch`` has the number of the set's shingles in each of 2 ** SKETCH_BITS parts of the hash range.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, width))

    def signed(texts: list[str], seen: set[int]) -> dict[str, pa.Array]:
        rows: list[tuple] = []
        for word in shingles.words(texts):
            own = shingles.distinct(shingles.shingles(word, width))
            n = len(own)
            length = n - (percent * n + 99) // 100 + 1 if n else 0
            count = shared.value[_bucket(own)]
            first_ones = np.argsort(count, kind="stable")[:length]
            prefix, cold = own[first_ones], int(np.count_nonzero(count[first_ones] < HOT))
            group = int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
            first = n > 0 and group not in seen
            if first and len(seen) < 200_000:
                seen.add(group)
            parts = np.bincount((own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            sketch = parts.astype(np.int16) if n and parts.max() < 1 << 15 else None
            rows.append((n, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), group, prefix.view(np.int64) if first else None, cold, sketch))
        columns = zip(*rows, strict=True) if rows else ((),) * 6
        return {name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)}

    @released
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in portions(batch, batch.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **signed(part.column("text").to_pylist(), seen)})

    kinds = {"n": pa.int64(), "set_key": pa.binary(), "group_key": pa.int64(), "prefix": pa.list_(pa.int64()), "cold": pa.int32(), "sketch": pa.list_(pa.int16())}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, set_key binary, group_key long, prefix array<long>, cold int, sketch array<short>")


def whole_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(set_key, members) of the texts whose id is in ``ids`` (doc_id), recomputed; equal ids may add more."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")

    @released
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.column("text")):
                found = [shingles.distinct(shingles.shingles(w, width)) for w in shingles.words(part.column("text").to_pylist())]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
                yield pa.RecordBatch.from_pydict({"set_key": pa.array(keys, pa.binary()), "members": pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))})

    return texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sets, "set_key binary, members array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class nodes whose Jaccard similarity is at least ``percent``, which may repeat; only their texts are read again.

    The sets of a go to those of b, so a pair costs least where b stands in many pairs. A set of b is taken once,
    however often its row repeats.
    """
    of = lambda name: classes.select(*(F.col(x).alias(f"{y}_{name}") for x, y in (("n", "n"), ("sketch", "s"), ("set_key", "k"), ("doc_id", "d"))), F.col("node").alias(name))
    most = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
    may = F.coalesce((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")), F.lit(True))
    pairs = checkpointed(pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(may).select("a", "b", "k_a", "k_b", "d_a", "d_b"))
    # The pairs are counted once; few pairs have few ids.
    some = pairs.limit(BROADCAST_ROWS + 1).count()
    if not some:
        return pairs.select("a", "b")
    narrow = F.broadcast if some <= BROADCAST_ROWS else sized

    def sets(name: str) -> DataFrame:
        return whole_sets(docs, narrow(pairs.select(F.col(f"d_{name}").alias("doc_id")).distinct()), width)

    left = sets("a").withColumnsRenamed({"set_key": "k_a", "members": "left"}).join(narrow(pairs.drop("d_a", "d_b")), "k_a").select("a", "b", "k_b", "left")
    right = sets("b").groupBy(F.col("set_key").alias("k_b")).agg(F.first("members").alias("right"))
    both = left.join(right, "k_b").select("a", "b", F.size("left").alias("x"), F.size("right").alias("y"), F.size(F.array_intersect("left", "right")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("x") + F.col("y") - F.col("common"))).select("a", "b")


def candidate_lists(signed: DataFrame) -> DataFrame:
    """(shingle, group_key, n, at, hot): the groups that meet in a prefix shingle, a row for each group and list.

    Lists of cold shingles are bounded by HOT, so they are told from shingles of one group only within one
    partition; lists with the same groups become one, with each group's first position in them, which can
    only let more pairs pass the filters. Hot shingles are taken as lists as they are.
    """
    index = signed.where(F.col("prefix").isNotNull()).select("group_key", "n", "cold", F.posexplode("prefix").alias("at", "shingle"))
    packed = index.where("at < cold").select("shingle", "group_key", (F.col("n") * (1 << 31) + F.col("at")).alias("place"))
    of_one = Window.partitionBy("shingle")
    met = packed.select(
        "group_key",
        "place",
        F.min("group_key").over(of_one).alias("low"),
        F.max("group_key").over(of_one).alias("high"),
        # A sum of integers, the same in any order; HOT bounds its terms, so that it can't overflow.
        F.sum(F.shiftright(F.xxhash64("group_key"), 14)).over(of_one).alias("shingle"),
    ).where("low <> high")
    cold = met.groupBy("shingle", "group_key").agg(F.min("place").alias("place"))
    cold = cold.select("shingle", "group_key", F.expr(f"place div {1 << 31}").alias("n"), F.expr(f"cast(place % {1 << 31} as int)").alias("at"), F.lit(False).alias("hot"))
    hot = index.where("at >= cold").select("shingle", "group_key", "n", "at", F.lit(True).alias("hot")).distinct()
    return cold.unionByName(hot)


def _may_link(n: Column, at: Column, other_n: Column, other_at: Column, percent: int) -> Column:
    """Size and position filters: the overlap that is needed can still be reached from the shared shingle on."""
    need = F.ceil(percent * (n + other_n) / (100 + percent))
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & (1 + F.least(n - at - 1, other_n - other_at - 1) >= need)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, star_rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, the row's own included.
    """
    signed = stored(signatures(docs, width, percent), "signatures")
    # A class is named by a number from here on; the numbers are written once and read from then on.
    classes = signed.where("n > 0").groupBy("set_key", "group_key", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # Classes with the same prefix and size meet under their group's key.
    own = classes.groupBy("group_key", "n").agg(F.count("*").alias("classes")).where("classes > 1").select("group_key", "n", F.lit(0).alias("at"), F.col("group_key").alias("shingle"), (F.col("classes") >= HOT).alias("hot"))
    lists = candidate_lists(signed).unionByName(own)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = stored(lists.join(classes.select("group_key", "node"), "group_key").withColumn("salt", salt).drop("group_key"), "members")

    labels = None
    for turn in range(star_rounds + 1):
        placed = rows if labels is None else rows.join(labels.hint("merge"), "node", "left")
        placed = placed.withColumn("component", F.coalesce("component", "node") if labels is not None else F.col("node"))
        # The member with the fewest rarer shingles, an original among its copies; then by a seeded hash.
        # Lists that are one component by now are done.
        draw = F.xxhash64(F.lit(turn), "node")
        lead = F.struct(F.struct(F.when(F.lit(turn == 0), F.col("at")).otherwise(0), draw).alias("draw"), *(F.col(c) for c in ("node", "component", "n", "at")))
        heads = (
            placed.groupBy("shingle")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(lead).alias("head"), F.max("hot").alias("hot"), F.count("*").alias("members"))
            .where("low <> high")
            .select("shingle", "members", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))), "head.*")
            .toDF("shingle", "members", "salt", "draw", "h_node", "h_component", "h_n", "h_at")
            .drop("draw")
        )
        # Members of lists that aren't one component yet; stored, as what follows reads them twice.
        still = stored(placed.join(heads, ["shingle", "salt"]), "stars")
        if turn < star_rounds:
            # Every pair of a head is decided by this round: the next ones take lists without it, where two members are left at least.
            rows = still.where("members > 2 and node <> h_node").select(rows.columns)
        others = still.where(F.col("component") != F.col("h_component"))
        if turn < star_rounds:
            near = _may_link(F.col("n"), F.col("at"), F.col("h_n"), F.col("h_at"), percent)
            pairs = others.where(near).select(F.col("node").alias("a"), F.col("h_node").alias("b"))
        else:  # every pair of members in different components, one of them outside the head's
            # Sizes that may link differ by one step of this scale at most, so that a list is dealt out by size too.
            step = lambda n: F.floor(F.log(n) / math.log(100 / percent) if percent < 100 else n).cast("long")
            # A hot list and step is a skewed partition of this join, which Spark splits on both sides where it is large;
            # salts of our own would copy the list's members, few or many, once for each salt.
            others = others.select("shingle", "node", "component", "n", "at", "h_component", F.explode(F.sequence(step(F.col("n")) - 1, step(F.col("n")) + 1)).alias("step"))
            mates = still.select("shingle", *(F.col(c).alias(f"m_{c}") for c in ("node", "component", "n", "at")), step(F.col("n")).alias("step"))
            near = _may_link(F.col("n"), F.col("at"), F.col("m_n"), F.col("m_at"), percent)
            once = (F.col("m_component") == F.col("h_component")) | (F.col("node") < F.col("m_node"))
            met = others.join(mates, ["shingle", "step"]).where((F.col("component") != F.col("m_component")) & once & near)
            pairs = met.select(F.least("node", "m_node").alias("a"), F.greatest("node", "m_node").alias("b"))
        links = _verified(docs, pairs, classes, width, percent)
        if labels is not None:  # what the links so far reach is known: each node's link to its component stands for them
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = checkpointed(components(links, "a", "b"))

    named = classes.join(labels, "node", "left").select("set_key", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.select("set_key", "component").join(smallest, "component").select("set_key", "component_id")
    out = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(found, "set_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
