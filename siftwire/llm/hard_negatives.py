"""Hard-negative mining by a two-dimensional block matrix multiply.

The anchors and all rows are the two matrices. Both are sharded by rows into blocks and by components into chunks;
a task multiplies one block of anchors with one block of rows in one chunk. The partial tiles of 64-bit integers,
cut into strips of a few anchors and sent in the narrowest type that holds them, are shuffled to one place for each
strip and added there. What is left of a finished tile is its first few rows for each anchor, or for each window
of an anchor and a positive; these are reduced over all tiles.

Two products are made: anchors with the rows of their label for the positives, then anchors with all rows for the
negatives, whose windows the positives set. Blocks have a bounded number of rows at any size of a label, so that a
label with a third of all rows is only more blocks. Pairs are never rows: a task's output is bounded by its tile.

Defined results: see ``integers`` for rows that take no part; rows with a null label take none either. Only rows
with equally many components are compared. Equal rows count once; of different rows with one id each counts, but
none is a positive or negative of its own id. Ties go to the smaller id. An anchor without a positive, and a window
without a negative, give no rows. Empty vectors have the score 0. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.llm.integers import matrix, narrowed, products, quantised
from siftwire.llm.sized import sized
from siftwire.session import stored

#: Anchors of a strip: what is added and searched at once.
STRIP = 32
_ROW = ["vec_id", "copy", "label", "v"]
_STRIP = (
    "chunk int, strip int, anchors array<long>, anchor_copies array<long>, anchor_labels array<string>, positives array<array<long>>, positive_scores array<array<long>>, "
    "ids array<long>, copies array<long>, labels array<string>, kind string, scores binary"
)


def _chunked(rows: DataFrame, width: int) -> DataFrame:
    """A row for each chunk of components; an empty vector has one chunk."""
    last = F.greatest(F.ceil(F.col("dims") / width).cast("int"), F.lit(1)) - 1
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).withColumn("v", F.slice("v", F.col("chunk") * width + 1, F.lit(width)))


def _strips(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    """The partial tile of one chunk."""
    anchors, rows = anchors.sort_values(["vec_id", "copy"]), rows.sort_values(["vec_id", "copy"])
    if not len(anchors) or not len(rows):
        return
    partial = products(matrix(anchors["v"]), matrix(rows["v"]))
    for start in range(0, len(anchors), STRIP):
        part = anchors.iloc[start : start + STRIP]
        kind, scores = narrowed(partial[start : start + STRIP])
        values = [part[c].tolist() for c in ("vec_id", "copy", "label", "positives", "positive_scores")] + [rows[c].tolist() for c in ("vec_id", "copy", "label")]
        yield pd.DataFrame([[*key, start // STRIP, *values, kind, scores]], columns=[*keys, *(f.split()[0] for f in _STRIP.split(", "))])


def _finished(strip: pd.DataFrame) -> tuple[pd.Series, np.ndarray]:
    """The strip's head, and the sum of its partial tiles."""
    head = strip.iloc[0]
    shape = len(head["anchors"]), len(head["ids"])
    total = np.zeros(shape, np.int64)
    for kind, scores in zip(strip["kind"], strip["scores"], strict=True):
        total += np.frombuffer(scores, kind).reshape(shape)
    return head, total


def _tops(strip: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first n rows of each anchor's label."""
    head, scores = _finished(strip)
    ids, copies, out = np.asarray(head["ids"]), np.asarray(head["copies"]), []
    for i, anchor in enumerate(head["anchors"]):
        order = np.argsort(-scores[i], kind="stable")  # columns are in order of ids
        order = order[ids[order] != anchor][:n]
        out += [(anchor, head["anchor_copies"][i], ids[j], copies[j], scores[i, j]) for j in order]
    return pd.DataFrame(out, columns=["anchor_id", "anchor_copy", "vec_id", "copy", "score"])


def _negatives(strip: pd.DataFrame, n: int, low: int, high: int) -> pd.DataFrame:
    """The first n rows of other labels in the window of each anchor and positive."""
    head, scores = _finished(strip)
    ids, copies, labels = np.asarray(head["ids"]), np.asarray(head["copies"]), np.asarray(head["labels"], object)
    out = []
    for i, anchor in enumerate(head["anchors"]):
        others = np.flatnonzero((labels != head["anchor_labels"][i]) & (ids != anchor))
        order = others[np.argsort(-scores[i, others], kind="stable")]
        falling = -scores[i, order]
        for place, (positive, score) in enumerate(zip(head["positives"][i], head["positive_scores"][i], strict=True)):
            least, most = -(-low * int(score) // 100), high * int(score) // 100
            first = np.searchsorted(falling, -most)
            found = order[first : min(first + n, np.searchsorted(falling, -least, side="right"))]
            out += [(anchor, head["anchor_copies"][i], place, positive, score, ids[j], copies[j], scores[i, j]) for j in found]
    return pd.DataFrame(out, columns=["anchor_id", "anchor_copy", "place", "positive_id", "positive_score", "negative_id", "negative_copy", "negative_score"])


def _multiplied(anchors: DataFrame, rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Strips of partial tiles for blocks that share ``keys``."""
    types = dict(anchors.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + _STRIP
    # New names for the columns, since both sides may come from one table.
    sides = [_chunked(side, width).select(*keys, "chunk", *_ROW, *more) for side, more in ((anchors, ["positives", "positive_scores"]), (rows, []))]
    left, right = (side.toDF(*side.columns).groupBy(*keys, "chunk") for side in sides)

    def multiply(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        made = list(_strips(key, a, b, keys))
        return pd.concat(made) if made else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])

    return left.cogroup(right).applyInPandas(multiply, schema)


def _best(found: DataFrame, keys: list[str], score: str, vec_id: str, copy: str, n: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id, copy)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def mine(
    vectors: DataFrame,
    anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: float = 256.0,
    chunk: int = 32,
    anchor_block: int = 512,
    row_block: int = 4096,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``anchor`` holds. A window holds the scores between ``low`` and ``high`` hundredths
    of the positive's.
    """
    chosen = vectors.where(F.col(label).isNotNull())
    flag = F.coalesce(anchor, F.lit(False))
    rows = stored(quantised(chosen, scale, vec_id, embedding, label=F.col(label).cast("string"), is_anchor=flag), "rows")
    no_windows = [F.array().cast("array<long>").alias(c) for c in ("positives", "positive_scores")]
    anchors = rows.where("is_anchor").select("dims", *_ROW, *no_windows)
    place = F.xxhash64("vec_id", "copy")

    labels = rows.groupBy("dims", "label").agg(F.ceil(F.count("*") / row_block).alias("row_blocks"), F.ceil(F.count_if("is_anchor") / anchor_block).alias("anchor_blocks"))
    labels = sized(labels.where("anchor_blocks > 0"))
    keys = ["dims", "of_label", "anchor_part", "row_part"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_label = F.col("label").alias("of_label")
    own = of_label, F.pmod(place, F.col("anchor_blocks")).alias("anchor_part"), every(F.col("row_blocks")).alias("row_part")
    all_of = of_label, every(F.col("anchor_blocks")).alias("anchor_part"), F.pmod(place, F.col("row_blocks")).alias("row_part")
    same = _multiplied(anchors.join(labels, ["dims", "label"]).select("dims", *_ROW, *no_windows, *own), rows.join(labels, ["dims", "label"]).select("dims", *_ROW, *all_of), keys, chunk)
    tops = same.groupBy(*keys, "strip").applyInPandas(lambda strip: _tops(strip, positives), "anchor_id long, anchor_copy long, vec_id long, copy long, score long")
    best = _best(tops, ["anchor_id", "anchor_copy"], "score", "vec_id", "copy", positives)
    listed = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score")))  # at most ``positives`` of an anchor
    windows = best.groupBy("anchor_id", "anchor_copy").agg(listed.alias("l"))
    windows = stored(windows.select("anchor_id", "anchor_copy", F.col("l.vec_id").alias("positives"), F.col("l.score").alias("positive_scores")), "windows")

    with_windows = anchors.drop("positives", "positive_scores").join(windows, (F.col("vec_id") == F.col("anchor_id")) & (F.col("copy") == F.col("anchor_copy")))
    n_anchor_blocks, n_row_blocks = max(1, -(-windows.count() // anchor_block)), max(1, -(-rows.count() // row_block))
    keys = ["dims", "anchor_part", "row_part"]
    left = with_windows.select("dims", *_ROW, "positives", "positive_scores", F.pmod(place, F.lit(n_anchor_blocks)).cast("int").alias("anchor_part"), every(F.lit(n_row_blocks)).alias("row_part"))
    right = rows.select("dims", *_ROW, F.pmod(place, F.lit(n_row_blocks)).cast("int").alias("row_part")).select("*", every(F.lit(n_anchor_blocks)).alias("anchor_part"))
    met = _multiplied(left, right, keys, chunk).groupBy(*keys, "strip").applyInPandas(
        lambda strip: _negatives(strip, negatives, low, high),
        "anchor_id long, anchor_copy long, place int, positive_id long, positive_score long, negative_id long, negative_copy long, negative_score long",
    )
    found = _best(met, ["anchor_id", "anchor_copy", "place"], "negative_score", "negative_id", "negative_copy", negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
