"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training (``fit``): the presence of hashed character n-grams is counted per class on labelled rows, each
n-gram gets its log-count ratio, the n-grams whose ratio is most significant are kept, and a logistic
regression is fitted on the kept n-grams: how dense each is in the text, on a logarithmic scale, times its
ratio. Density tells a text that dwells on telling words from a long one that meets them by chance. Scoring
(``score``) is one narrow pass over whole texts.

Defined results: a null text counts as empty and gets the score of an empty text; a null or unknown label
is no training row; several labels of one doc_id count as toxic if any of them is; rows may repeat; with no
labelled row of one of the classes every score is the constant share of that class (0.0 without labels).
Existing columns of the output names are replaced, all others are passed through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.llm.memory import portions, released
from siftwire.session import stored

#: Code points hashed at once; longer texts are taken in overlapping pieces, none is cut off.
PIECE = 1 << 18
#: An n-gram's density is its places for each ``PER`` code points; ``PRIOR`` code points are added to every text.
PER, PRIOR = 1000.0, 200.0
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ToxicityModel:
    """Kept n-grams (hash buckets, ascending), their weights with the ratios multiplied in, and the bias."""

    orders: tuple[int, ...]
    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    density: bool = True


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == 0, F.lit(False))


def _code_points(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([32], np.where(points < 32, 32, points), [32])).astype(np.uint64)


def _pieces(texts: Iterable[str | None], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of several texts, a zero after each, with the row of every position and whether n-grams may begin there.

    A piece of a long text goes on over the start of the next one, so that every n-gram is whole in the piece it begins in.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for row, text in enumerate(texts):
        own = _code_points(text)
        for start in range(0, len(own), PIECE):
            part = np.append(own[start : start + PIECE + longest - 1], np.uint64(0))
            parts.append((part, np.full(len(part), row, np.int32), np.arange(len(part)) < PIECE))
            size += len(part)
            if size >= PIECE:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _grams(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at every position, and whether the n-gram there lies within one text."""
    value = points * _MULTIPLIER
    whole = points != 0
    for n in range(2, max(orders) + 1):
        value = value[:-1] * _MULTIPLIER + points[n - 1 :]
        whole = whole[:-1] & (points[n - 1 :] != 0)
        if n in orders:
            mixed = (value ^ (value >> np.uint64(29))) * _FINAL + np.uint64(n)
            yield ((mixed ^ (mixed >> np.uint64(32))) * _MULTIPLIER >> np.uint64(64 - bits)).astype(np.int64), whole


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def _count_udf(orders: tuple[int, ...], bits: int):
    """Presences of each bucket by class: a text counts once for a bucket, however many pieces it is taken in."""

    def added(totals: np.ndarray, texts: list[str | None], toxic: np.ndarray) -> None:
        before = np.zeros(0, np.int64)  # keys of the text in which the last piece ended
        for points, rows, begins in _pieces(texts, max(orders)):
            found = [(b, np.flatnonzero(ok & begins[: len(b)])) for b, ok in _grams(points, orders, bits)]
            keys = _distinct(np.concatenate([(rows[at].astype(np.int64) << bits) | b[at] for b, at in found]))
            new = keys[~np.isin(keys, before)] if len(before) else keys
            np.add.at(totals, (toxic[new >> bits] << bits) | (new & ((1 << bits) - 1)), 1)
            before = np.concatenate((before[before >> bits == rows[-1]], new[new >> bits == rows[-1]]))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 << bits, np.int32)
        for batch in batches:
            for part in portions(batch, batch.column("text")):
                added(totals, part.column("text").to_pylist(), part.column("toxic").to_numpy().astype(np.int64))
        totals = totals.reshape(2, -1)
        found = np.flatnonzero(totals.any(axis=0))
        for part in np.array_split(found, max(1, len(found) // 100_000)):
            yield pa.RecordBatch.from_pydict({"bucket": part, "clean": totals[0, part].astype(np.int64), "toxic": totals[1, part].astype(np.int64)})

    return count


def _hits(texts: list[str | None], slot: np.ndarray, orders: tuple[int, ...], bits: int, density: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kept n-gram, log of 1 + density, or 1) of the texts, each pair once, by rows; n-grams numbered from 0."""
    found, places = [], []
    for points, rows, begins in _pieces(texts, max(orders)):
        for buckets, ok in _grams(points, orders, bits):
            kept = slot[buckets]
            at = np.flatnonzero((kept >= 0) & ok & begins[: len(buckets)])
            keys, times = np.unique((rows[at].astype(np.int64) << 32) | kept[at], return_counts=True)
            found.append(keys)
            places.append(times)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, own = np.unique(np.concatenate(found), return_inverse=True)
    times = np.bincount(own, np.concatenate(places), minlength=len(keys))
    length = np.array([len(x or "") for x in texts], float)
    row = keys >> 32
    return row, keys & 0xFFFFFFFF, np.log1p(PER * times / (length[row] + PRIOR)) if density else np.ones(len(keys))


def _slots(buckets: np.ndarray, bits: int) -> np.ndarray:
    slot = np.full(1 << bits, -1, np.int32)
    slot[buckets] = np.arange(len(buckets), dtype=np.int32)
    return slot


def _feature_udf(buckets: np.ndarray, orders: tuple[int, ...], bits: int, density: bool):
    @F.arrow_udf("struct<at:array<int>,value:array<double>>")
    @released
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot = _slots(buckets, bits)
        for batch in batches:
            for part in portions(batch, batch):
                rows, kept, dense = _hits(part.to_pylist(), slot, orders, bits, density)
                ends = pa.array(np.searchsorted(rows, np.arange(len(part) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(kept, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(dense))]
                yield pa.StructArray.from_arrays(lists, ["at", "value"])

    return features


def ratios_of(train: DataFrame, classes: dict[int, int], orders: tuple[int, ...], bits: int, smoothing: float, min_docs: int) -> DataFrame:
    """(bucket, ratio, z): the log-count ratio of each n-gram of ``train`` (text, toxic), and how significant it is."""
    counts = train.mapInArrow(_count_udf(orders, bits), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") + smoothing, F.col("clean") + smoothing
    ratio = F.log(p / classes[1]) - F.log(q / classes[0])
    return counts.where(F.col("clean") + F.col("toxic") >= min_docs).select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("z"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    orders: tuple[int, ...] = (3, 4, 5),
    bits: int = 20,
    max_train_rows: int = 20_000,
    max_features: int = 4096,
    min_docs: int = 3,
    smoothing: float = 0.5,
    regularisation: float = 1e-4,
    density: bool = True,
) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``density`` takes how dense an n-gram is in the text, else whether it is there (``cross_validated`` compares them).
    ``max_train_rows`` bounds the labelled rows that are used: above it the rows with the lowest hash of
    their id are taken, about so many. The chosen labels are therefore small enough to broadcast at any
    corpus size, and no text is shuffled.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = chosen.count()
    if known > max_train_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(max_train_rows / known * (1 << 31)))
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    classes = {int(r["toxic"]): int(r["count"]) for r in train.groupBy("toxic").count().collect()}
    empty = np.zeros(0)
    if len(classes) < 2:
        share = 1.0 if classes.get(1) else 0.0
        return ToxicityModel(orders, bits, empty.astype(np.int64), empty, 50.0 if share else -50.0)

    ranked = ratios_of(train, classes, orders, bits, smoothing, min_docs).orderBy(F.desc("z"), "bucket").limit(max_features).collect()
    kept = sorted((int(r["bucket"]), float(r["ratio"])) for r in ranked)
    if not kept:
        odds = float(np.log(classes[1] / classes[0]))
        return ToxicityModel(orders, bits, empty.astype(np.int64), empty, odds)
    buckets = np.array([b for b, _ in kept], np.int64)
    ratios = np.array([r for _, r in kept])

    size = len(kept)
    vector = F.udf(lambda found: Vectors.sparse(size, found["at"], found["value"]), VectorUDT())
    grams = train.select(F.col("toxic").cast("double").alias("label"), _feature_udf(buckets, orders, bits, density)("text").alias("grams"))
    # Stored before the next Python step, so that a task never needs two Python workers at once.
    rows = stored(grams, "grams").select("label", vector("grams").alias("dense")).persist()
    try:
        model = Pipeline(
            stages=[
                ElementwiseProduct(scalingVec=Vectors.dense(ratios.tolist()), inputCol="dense", outputCol="scaled"),
                LogisticRegression(featuresCol="scaled", labelCol="label", regParam=regularisation, maxIter=30, standardization=False),
            ]
        ).fit(rows)
    finally:
        rows.unpersist()
    linear = model.stages[-1]
    return ToxicityModel(orders, bits, buckets, np.array(linear.coefficients.toArray()) * ratios, float(linear.intercept), density)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "score") -> DataFrame:
    """Add ``output``: the probability, 0 to 1, that the whole text is toxic."""

    @F.arrow_udf("double")
    @released
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot = _slots(model.buckets, model.bits)
        for batch in batches:
            for part in portions(batch, batch):
                total = np.full(len(part), model.bias)
                if len(model.buckets):
                    rows, kept, dense = _hits(part.to_pylist(), slot, model.orders, model.bits, model.density)
                    total += np.bincount(rows, model.weights[kept] * dense, minlength=len(part))
                yield pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))

    return docs.withColumn(output, toxicity(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted; the model never sees held-out rows."""
    model = fit(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")), **options)
    scored = score(docs.withColumn("held_out", held_out("doc_id")), model)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def cross_validated(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """(toxic, n, rejected) over the folds of the rows to learn from, each judged by a model of the others.

    Rows that are held out take no part, so that a choice made by these figures leaves them unseen.
    """
    fold = lambda df: df.withColumn("__fold", F.crc32(F.col("doc_id").cast("string")) % folds).where("__fold <> 0")
    docs, known = fold(docs), fold(labels.where(F.col("toxic").isin(0, 1)))
    judged = None
    for k in range(1, folds):
        model = fit(docs.where(f"__fold <> {k}"), known.where(f"__fold <> {k}"), **options)
        own = docs.where(f"__fold = {k}").select("doc_id", "text").join(known.where(f"__fold = {k}").select("doc_id", "toxic"), "doc_id")
        part = score(own, model, output="score").select("toxic", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("rejected"))
        judged = part if judged is None else judged.unionByName(part)
    return judged.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("rejected").alias("rejected"))
