"""The trie of conversation prefixes by distributed MSD radix partitioning.

Turns (role, text) are dictionary-encoded: each distinct turn has a number. All conversations start in one bucket.
A round splits every open bucket: the turns that all its members share are its chain of nodes, and by the first
turn in which they differ, the digit, the members go to the buckets of the next round; those that have no turn
there end. A bucket with at most ``local`` turns left is finished in one task, many buckets after each other, by multikey
quicksort, which emits the nodes below as its recursion meets them. Rounds go on until all buckets are finished, so
that they are as many as there are branchings above local buckets, not as the longest conversation has turns.

Sums over subtrees come back up round by round: a bucket's total is that of its children and its own chain.
Nothing brings the members of an open bucket together: counts, minima and the first difference are partial
aggregates. The members that end at such a node are hashed in order as a stream: sorted ranges are joined to
texts of bounded size, and those are hashed one after another.

Turns are ordered by number, null first, then by role and text; null role or text counts as empty; repeated rows
are turns of their own. Rows with a null id take no part. No rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.functions.order import running
from siftwire.llm.memory import released
from siftwire.session import stored

_WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Bytes of a text of ids that is hashed at once.
_PIECE = 1 << 20


def encoded(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, code, words): turns numbered from 0 in each conversation, with their numbers in the dictionary."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role_).cast("string"), F.lit(" "), role_, text_)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.sha2(whole, 256).alias("digest"), F.regexp_count(text_, F.lit(_WORD)).cast("long").alias("words")
    )
    rows = rows.withColumn("digest", F.unhex("digest"))
    # A block of 1,024 turn numbers has about as many rows.
    placed = running(rows, ["conv_id"], F.floor(F.col("turn") / 1024), ["turn", "digest"], F.lit(1), "n")
    placed = stored(placed.select("conv_id", (F.col("n") - 1).alias("pos"), "digest", "words"), "turns")
    # Written once: the numbers differ from run to run, but not within one.
    dictionary = stored(placed.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("code")), "dictionary")
    return stored(placed.join(dictionary, "digest").select("conv_id", "pos", "code", "words"), "codes")


def rebuilt(turns: DataFrame, base: Column, shared: Column) -> DataFrame:
    """(conv_id, pos, code, words): the first ``shared`` turns (a few) of conversation ``base``, then the own ones after as many.

    Both are expressions of conv_id.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), shared.cast("long").alias("h"))
    most = convs.agg(F.max("h")).first()[0] or 0  # no more of a long conversation meets those that borrow from it
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "code", "words")
    lent = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "code", "words")
    counts = convs.join(lent.groupBy("conv_id").agg(F.count("*").alias("k")), "conv_id", "left").select("conv_id", "h", F.coalesce("k", F.lit(0)).alias("k"))
    own = turns.join(counts, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "code", "words")
    return lent.unionByName(own)


_COLUMNS = [field.split()[0] for field in NODE.split(", ")]


def finish(codes: list[list[int]], words: list[list[int]], ids: list[int], depth: int, parent: int | None, top_words: int) -> list[list]:
    """The nodes of a bucket, its top first, by multikey quicksort of its sequences: lists of the values of NODE.

    ``ids`` rise. ``top_words`` are those of the top's last turn.
    """
    nodes: list[list] = []
    above: list[int] = []

    def node(members: list[int], at: int, up: int, last: int) -> int:
        """n_leaves and saved_tokens are the node's own until the sums below."""
        ends = [ids[m] for m in members if len(codes[m]) == at]
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _NO_ENDS
        nodes.append([ids[members[0]], depth + at, nodes[up][0] if up >= 0 else parent, len(members), 0, 0, (len(members) - 1) * last, sha])
        above.append(up)
        if up >= 0:
            nodes[up][4] += 1
        return len(nodes) - 1

    everyone = list(range(len(ids)))
    # Parts still to be split by the turn at a place; members keep the order of their ids.
    todo = [(everyone, 0, node(everyone, 0, -1, top_words))]
    while todo:
        members, at, up = todo.pop()
        members = [m for m in members if len(codes[m]) > at]
        if not members:
            continue
        pivot = codes[members[len(members) // 2]][at]
        same = members
        if len(members) > 1:
            less, more = [m for m in members if codes[m][at] < pivot], [m for m in members if codes[m][at] > pivot]
            todo += [(part, at, up) for part in (less, more) if part]
            same = [m for m in members if codes[m][at] == pivot]
        todo.append((same, at + 1, node(same, at + 1, up, words[same[0]][at])))
    for i in range(len(nodes) - 1, -1, -1):  # nodes stand after their parents
        nodes[i][5] = nodes[i][5] or 1
        if above[i] >= 0:
            nodes[above[i]][5] += nodes[i][5]
            nodes[above[i]][6] += nodes[i][6]
    return nodes


def _finish_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, ..., conv_id, pos, code, words) in the order of (bucket, conv_id, pos); a member without a turn left has no pos."""

    def finished(rows: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        out: list[list] = []
        conv, real, code, words = rows["conv_id"].tolist(), rows["pos"].notna().tolist(), rows["code"].tolist(), rows["words"].tolist()
        heads = [rows[c].tolist() for c in ("bucket", "depth", "parent_low", "top_words")]
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            codes: list[list[int]] = []
            word_lists: list[list[int]] = []
            ids: list[int] = []
            for i in range(a, b):
                if not ids or ids[-1] != conv[i]:
                    ids.append(conv[i])
                    codes.append([])
                    word_lists.append([])
                if real[i]:
                    codes[-1].append(code[i])
                    word_lists[-1].append(words[i])
            bucket, depth, parent, top_words = (h[a] for h in heads)
            nodes = finish(codes, word_lists, ids, depth, None if parent is None or parent != parent else int(parent), top_words)
            out += [[*n, bucket, i == 0] for i, n in enumerate(nodes)]
        made = pd.DataFrame(out, columns=[*_COLUMNS, "bucket", "is_top"])
        made["parent_conv_id"] = pd.array(made["parent_conv_id"].tolist(), "Int64")
        return made

    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(rows):
            bucket = rows["bucket"].to_numpy()
            starts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()]
            if len(starts) > 1:
                yield finished(rows.iloc[: starts[-1]], starts[:-1])
            rest = rows.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield finished(rest, [0])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one bucket, in order, as comma-joined texts of bounded size."""
    for batch in batches:
        for bucket, ids in batch.groupby("bucket", sort=False)["conv_id"]:
            values, step = ids.tolist(), _PIECE // 20
            parts = [values[i : i + step] for i in range(0, len(values), step)]
            yield pd.DataFrame({"bucket": bucket, "first": [p[0] for p in parts], "piece": [",".join(map(str, p)) for p in parts]})


def _hash_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One hash of the pieces of each bucket, which stand in order."""
    now, digest = None, None
    for batch in batches:
        out = []
        for bucket, piece in zip(batch["bucket"], batch["piece"], strict=True):
            if bucket != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = bucket, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["bucket", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["bucket", "ends_sha256"])


def ends_hash(ends: DataFrame) -> DataFrame:
    """(bucket, ends_sha256) of the members (bucket, conv_id), ascending: a bucket of any size is sorted by ranges."""
    ranged = ends.repartitionByRange("bucket", "conv_id").sortWithinPartitions("bucket", "conv_id")
    pieces = ranged.mapInPandas(_pieces, "bucket string, first long, piece string")
    return pieces.repartition("bucket").sortWithinPartitions("bucket", "first").mapInPandas(_hash_pieces, "bucket string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, *, local: int = 20_000) -> DataFrame:
    """All nodes (see NODE) of the sequences ``turns`` (conv_id, pos, code, words) of the conversations ``convs`` (conv_id)."""
    none = F.lit(None).cast("string")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    members = convs.join(lengths, "conv_id", "left").select(F.lit("0").alias("bucket"), "conv_id", F.coalesce("length", F.lit(0)).alias("length"))
    placed = stored(members, "placed")
    whole = placed.groupBy("bucket").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("low"), F.sum("length").alias("left"))
    buckets = stored(whole.select("bucket", none.alias("above"), F.lit(0).cast("long").alias("depth"), "n_convs", "low", F.lit(None).cast("long").alias("parent_low"), F.lit(0).cast("long").alias("top_words"), "left"), "buckets")
    rounds, local_buckets, local_members, ends = [], [], [], []
    while True:
        small, large = buckets.where(F.col("left") <= local), buckets.where(F.col("left") > local)
        local_buckets.append(small)
        local_members.append(placed.join(small.select("bucket", "depth", "parent_low", "top_words"), "bucket"))
        if not large.limit(1).count():
            break
        # What all members share, and the digit after it.
        inside = placed.join(large.select("bucket", "depth"), "bucket")
        rest = stored(inside.join(turns, "conv_id").where("pos >= depth").select("bucket", "conv_id", "length", "pos", "code", "words"), "rest")
        by_pos = rest.groupBy("bucket", "pos").agg(F.count("*").alias("n"), F.min("code").alias("first"), F.max("code").alias("last"), F.max("words").alias("words"))
        by_pos = by_pos.join(large.select("bucket", "n_convs"), "bucket").select("bucket", "pos", "words", ((F.col("n") == F.col("n_convs")) & (F.col("first") == F.col("last"))).alias("shared"))
        by_pos = stored(by_pos, "places")
        stop = by_pos.groupBy("bucket").agg(F.coalesce(F.min(F.when(~F.col("shared"), F.col("pos"))), F.max("pos") + 1).alias("branch"))
        large = stored(large.join(stop, "bucket"), "split")
        chain = by_pos.join(large.select("bucket", "branch"), "bucket").where("pos < branch").select("bucket", (F.col("pos") + 1).alias("depth"), "words")
        split = rest.join(large.select("bucket", "branch", F.col("low").alias("parent_low")), "bucket").where("pos = branch")
        children = split.groupBy("bucket", "code").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("low"), F.max("words").alias("top_words"), F.max("parent_low").alias("parent_low"),
            (F.max("pos") + 1).alias("depth"), F.sum(F.col("length") - F.col("pos") - 1).alias("left"),
        )
        name = F.concat(F.lit(f"{len(rounds) + 1}-"), F.monotonically_increasing_id().cast("string"))
        children = stored(children.withColumnRenamed("bucket", "above").withColumn("bucket", name), "children")
        ends.append(placed.join(large.select("bucket", "branch"), "bucket").where("length = branch").select("bucket", "conv_id"))
        rounds.append((large, chain))
        digits = children.select(F.col("above"), "code", "bucket")
        placed = stored(split.select(F.col("bucket").alias("above"), "code", "conv_id", "length").join(digits, ["above", "code"]).select("bucket", "conv_id", "length"), "placed")
        buckets = children.select(buckets.columns)
    nodes = stored(_local_nodes(_union(local_members), turns), "local")
    above = _union([b.select("bucket", "above") for b in local_buckets])
    out = nodes.select(_COLUMNS)
    if rounds:
        out = out.unionByName(_split_nodes(rounds, _union(ends), nodes.where("is_top").join(above, "bucket").select("above", "n_leaves", "saved_tokens")))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _local_nodes(members: DataFrame, turns: DataFrame) -> DataFrame:
    """NODE, bucket and is_top of the nodes of local buckets, from their members."""
    rows = members.join(turns, "conv_id", "left")
    left = F.coalesce(F.col("pos") >= F.col("depth"), F.lit(False))
    # Of a member without a turn left one row stays: that of the bucket's last turn, or the one without a turn.
    last = (F.col("length") == F.col("depth")) & (F.coalesce("pos", F.lit(-1)) == F.col("depth") - 1)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.where(left | last).select("bucket", "depth", "parent_low", "top_words", "conv_id", F.when(left, F.col("pos")).alias("pos"), number("code"), number("words"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "pos").mapInPandas(released(_finish_buckets), NODE + ", bucket string, is_top boolean")


def _split_nodes(rounds: list[tuple[DataFrame, DataFrame]], ends: DataFrame, totals: DataFrame) -> DataFrame:
    """NODE of the buckets that were split; ``totals`` (above, n_leaves, saved_tokens) of local buckets."""
    hashes = stored(ends_hash(ends), "ends")
    made = []
    for large, chain in reversed(rounds):
        sums = totals.groupBy(F.col("above").alias("bucket")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        known = large.join(sums, "bucket", "left").join(hashes, "bucket", "left").withColumnRenamed("depth", "top").drop("top_words", "left")
        own = large.select("bucket", "depth", F.col("top_words").alias("words")).unionByName(chain).join(known, "bucket")
        # From the end of the chain to its top.
        own = running(own, ["bucket"], F.floor(-F.col("depth") / 65_536), [F.desc("depth")], (F.col("n_convs") - 1) * F.col("words"), "chain_saved")
        at_end, is_top = F.col("depth") == F.col("branch"), F.col("depth") == F.col("top")
        own = own.select(
            F.col("low").alias("conv_id"),
            "depth",
            F.when(is_top, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
            "n_convs",
            F.when(at_end, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + F.col("chain_saved")).alias("saved_tokens"),
            F.when(at_end, F.coalesce("ends_sha256", F.lit(_NO_ENDS))).otherwise(_NO_ENDS).alias("ends_sha256"),
            "above",
            is_top.alias("is_top"),
        )
        own = stored(own, "split-nodes")
        made.append(own.select(_COLUMNS))
        totals = totals.unionByName(own.where("is_top").select("above", "n_leaves", "saved_tokens"))
    return _union(made)
