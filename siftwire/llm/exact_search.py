"""Exact top-k search by inner product with a pivot-distance index.

The largest inner product with a query is the smallest distance once every vector v gets one more component
sqrt(M - |v|^2), with M the largest squared length of all, and every query a 0. In that space a few vectors of a
bounded sample are pivots. Every vector is keyed by its nearest pivot and its distance to it; the vectors of a
pivot are cut by distance into annuli, and the index is stored in the order of (pivot, distance).

By the triangle inequality a vector in an annulus is at least as far from the query as the query's distance to the
pivot lies outside the annulus. Each query takes the annuli in order of that bound, a few at first, then ever more
in a round, and stops when the next bound is beyond its k-th best so far. A round is a join of the annuli that some
query still wants with those queries, in blocks: an annulus of any size is dealt to blocks of about ``block`` rows, its
queries to blocks of ``query_block``. Bounds are taken with a margin far above rounding errors and the scores are exact
integers, so that the result is that of comparing all.

Defined results: see ``integers`` for rows that take no part. Only vectors with equally many components are compared.
Equal rows count once; of different rows with one id each counts, none as a result of its own id. Ties go to the smaller
id. Empty vectors have the score 0. No rows, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.llm.integers import matrix, products, quantised
from siftwire.llm.memory import released
from siftwire.llm.sized import sized
from siftwire.session import stored

#: Rows whose distances to all pivots, or to all annuli, are held at once.
_CHUNK = 512
#: Below every score: the k-th best of a query that has not met k rows.
NONE = -(2**63)


def far_apart(sample: np.ndarray, n: int, longest: float) -> np.ndarray:
    """Up to n different vectors of the sample: the first, then each time the one farthest from those chosen."""
    chosen, left = [0], np.full(len(sample), np.inf)
    while True:
        left = np.minimum(left, distances(sample, sample[chosen[-1:]], longest)[:, 0])
        if len(chosen) == n or left.max() <= 1e-6:
            return sample[chosen]
        chosen.append(int(left.argmax()))


def _rest(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The component that makes all vectors equally long."""
    return np.sqrt(np.maximum(longest - (vectors.astype(float) ** 2).sum(axis=1), 0.0))


def distances(vectors: np.ndarray, pivots: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Distances in the longer space; queries have 0 as their last component."""
    a, b = vectors.astype(float), pivots.astype(float)
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    last = np.zeros(len(a)) if query else _rest(vectors, longest)
    return np.sqrt(np.maximum(square + (last[:, None] - _rest(pivots, longest)[None]) ** 2, 0.0))


class Directory:
    """Pivots and annuli of the vectors with one number of components."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots, self.longest = pivots, longest
        self.pivot, self.ring, self.low, self.high, self.parts = (np.zeros(0) for _ in range(5))

    def reach(self, vectors: np.ndarray, kth: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, annulus) at the places from start to stop of each query's order, as far as they can hold a result."""
        own = distances(vectors, self.pivots, self.longest, query=True)[:, self.pivot]
        bound = np.maximum(np.maximum(self.low[None] - own, own - self.high[None]), 0.0)
        length = (vectors.astype(float) ** 2).sum(axis=1)
        radius = np.sqrt(np.maximum(length + self.longest - 2 * kth, 0.0))
        margin = 1e-6 * np.sqrt(length + self.longest) + 1e-6  # squares cancel down to half the digits
        order = np.lexsort((own, bound), axis=1)[:, start:stop]
        row, place = np.nonzero(np.take_along_axis(bound, order, 1) <= (radius + margin)[:, None])
        return row, order[row, place]


def _key(directories: dict[int, Directory]):
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, rows in batch.groupby("dims"):
                d = directories[dims]
                for start in range(0, len(rows), _CHUNK):
                    part = rows.iloc[start : start + _CHUNK]
                    far = distances(matrix(part["v"]), d.pivots, d.longest)
                    yield part.assign(pivot=far.argmin(axis=1), distance=far.min(axis=1))

    return released(keyed)


def _reach(directories: dict[int, Directory], start: int, stop: int):
    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, rows in batch.groupby("dims"):
                d = directories[dims]
                for at in range(0, len(rows), _CHUNK):
                    part = rows.iloc[at : at + _CHUNK]
                    kth = np.where(part["kth"] == NONE, -np.inf, part["kth"].to_numpy(dtype=float))
                    row, annulus = d.reach(matrix(part["v"]), kth, start, stop)
                    yield part.iloc[row].assign(pivot=d.pivot[annulus], ring=d.ring[annulus], parts=d.parts[annulus])

    return released(reached)


def _scan(k: int):
    def scan(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k best rows of a block for each query, none below its k-th best so far."""
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values(["vec_id", "copy"])
            ids, copies = rows["vec_id"].to_numpy(), rows["copy"].to_numpy()
            scores = products(matrix(queries["v"]), matrix(rows["v"]))
            for i, (query, own, kth) in enumerate(zip(queries["vec_id"], queries["copy"], queries["kth"], strict=True)):
                able = np.flatnonzero((ids != query) & (scores[i] >= kth))
                best = able[np.argsort(-scores[i, able], kind="stable")[:k]]
                out += [(query, own, ids[j], copies[j], scores[i, j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "query_copy", "vec_id", "copy", "score"])

    return scan


def search(
    vectors: DataFrame,
    query: Column,
    *,
    k: int = 5,
    scale: float = 256.0,
    pivots: int = 256,
    rings: int = 32,
    block: int = 1024,
    query_block: int = 1024,
    sample: int = 4096,
    growth: int = 4,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row for which ``query`` holds.

    Pivots, at most ``pivots``, are of a sample of ``sample`` rows taken by hash; every row is indexed. A pivot has at most
    ``rings`` annuli, so that the directory, which each task has, is bounded; their size is not.
    """
    rows = stored(quantised(vectors, scale, vec_id, embedding, is_query=F.coalesce(query, F.lit(False))), "rows")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x.cast("long") * x.cast("long"))
    sizes = {r["dims"]: (r["n"], float(r["longest"])) for r in rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect()}
    taken = rows.select("dims", "v", F.xxhash64("vec_id", "copy").alias("h")).orderBy("h", "dims").limit(sample).toPandas()
    directories, n_rings = {}, 1
    for dims, (n, longest) in sizes.items():
        own = taken.loc[taken["dims"] == dims, "v"]
        wanted = min(pivots, max(1, n // (4 * block)))
        # A number of components that the sample missed has few rows: one pivot, the origin.
        chosen = far_apart(matrix(own), wanted, longest) if len(own) else np.zeros((1, dims), np.int64)
        directories[dims] = Directory(chosen, longest)
        n_rings = min(rings, max(n_rings, -(-n // (block * len(chosen)))))

    keyed = stored(rows.mapInPandas(_key(directories), "vec_id long, copy long, dims int, v array<int>, is_query boolean, pivot int, distance double"), "keyed")
    edges = keyed.groupBy("dims", "pivot").agg(F.percentile_approx("distance", [i / n_rings for i in range(1, n_rings)] or [1.0]).alias("edges"))
    ringed = keyed.join(F.broadcast(edges), ["dims", "pivot"]).withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("distance")))).drop("edges")
    annuli = ringed.groupBy("dims", "pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    annuli = annuli.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    for dims, listed in annuli.orderBy("pivot", "ring").toPandas().groupby("dims"):  # at most pivots * rings of each
        d = directories[dims]
        d.pivot, d.ring, d.low, d.high, d.parts = (listed[c].to_numpy() for c in ("pivot", "ring", "low", "high", "parts"))
    index = ringed.join(F.broadcast(annuli.select("dims", "pivot", "ring", "parts")), ["dims", "pivot", "ring"])
    index = index.withColumn("part", F.pmod(F.xxhash64("vec_id", "copy"), F.col("parts")).cast("int")).drop("parts")
    index = stored(index.repartitionByRange("dims", "pivot", "distance", "vec_id").sortWithinPartitions("dims", "pivot", "distance"), "index")

    open_queries = index.where("is_query").select("vec_id", "copy", "dims", "v", F.lit(NONE).alias("kth"))
    query_blocks = max(1, -(-open_queries.count() // query_block))
    most = max((len(d.pivot) for d in directories.values()), default=0)
    best, start, width = None, 0, 1
    while start < most:
        reached = open_queries.mapInPandas(_reach(directories, start, start + width), "vec_id long, copy long, dims int, v array<int>, kth long, pivot int, ring int, parts int")
        reached = stored(reached.withColumn("query_part", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(query_blocks)).cast("int")), "reached")
        if not reached.limit(1).count():
            break
        keys = ["dims", "pivot", "ring", "part", "query_part"]
        wanted = reached.select("dims", "pivot", "ring", "query_part").distinct()
        met = index.select("dims", "pivot", "ring", "part", "vec_id", "copy", "v").join(sized(wanted), ["dims", "pivot", "ring"])
        asked = reached.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "vec_id", "copy", "v", "kth")
        asked, met = (side.toDF(*side.columns) for side in (asked, met))  # new names, since both sides come from one table
        found = asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(_scan(k), "query_id long, query_copy long, vec_id long, copy long, score long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        by = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
        best = stored(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "best")
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("query_copy").alias("copy"), F.col("score").alias("kth"))
        # A query whose annuli of this round were all too far is done.
        still = reached.select("vec_id", "copy", "dims", "v").dropDuplicates(["vec_id", "copy"])
        open_queries = still.join(kth, ["vec_id", "copy"], "left").select("vec_id", "copy", "dims", "v", F.coalesce("kth", F.lit(NONE)).alias("kth"))
        start, width = start + width, (start + width) * (growth - 1)
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
