"""Embedding near-dedup: links between vectors of one label by spherical-cap filters, with their components.

The filters are the words of a few random product codes: the space is rotated, cut into blocks, and each block
has random unit code vectors; a filter's direction is a choice of one code vector in each block. A vector is
list-decoded to all filters whose inner product with it exceeds ``cap``: partial sums are dropped as soon as
the best rest can't reach the cap. Vectors of one label that share a filter are compared in double precision.
The cap is chosen by simulation so that pairs at exactly the threshold share a filter with probability
``recall``; closer pairs share more.

Equal vectors of one label are one class and compared once. Filters meet twice, since a vector stands in twenty
of them or more and copies of it in all would take many times the input's disk. First only class numbers and 128
signs of random projections are dealt to the filters; a class stays in a filter if another one there differs in
no more signs than a pair at the threshold does, but for a chance of ``MISSED``. Only what stays gets its vectors.
They are dealt to blocks of about ``block`` of them, and each task compares two blocks, so that a filter with any
share of all vectors is spread; a task takes many filters, one after the other, and returns counts and the roots
of a local union-find, never the pairs. A pair that shares several filters counts in the first.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a
null label, link with nothing. Only vectors with equally many components are compared. Rows may repeat: each
row counts as a vector. Null ids are never a component's name. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.components import components
from siftwire.llm.memory import released
from siftwire.llm.sized import sized
from siftwire.session import checkpointed, stored

#: Vectors decoded at once.
_CHUNK = 256
#: Signs of random projections of a class, as two longs.
SIGNS = 128
#: The chance that a pair at the threshold differs in more signs than are let through.
MISSED = 1e-7
#: Classes of a filter whose signs one task compares; those of a larger filter all stay.
MOST = 8192


@lru_cache(maxsize=64)
def product_code(dims: int, blocks: int, words: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation, and the code vectors of each block scaled so that filters are unit vectors."""
    rng = np.random.default_rng([seed, dims, blocks, words])
    blocks = min(blocks, dims)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    codes = [rng.normal(size=(words, len(part))) for part in np.array_split(np.arange(dims), blocks)]
    return rotation, [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks) for c in codes]


def decode(unit: np.ndarray, codes: int, blocks: int, words: int, cap: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters whose inner product with a row is at least ``cap``, by rows."""
    rows, filters = [], []
    for code in range(codes):
        for start in range(0, len(unit), _CHUNK):
            row, word = _decode(unit[start : start + _CHUNK], blocks, words, cap, seed + code)
            rows.append(row + start)
            filters.append(word + code * words ** min(blocks, unit.shape[1]))
    row, word = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((word, row))
    return row[order], word[order]


def _decode(unit: np.ndarray, blocks: int, words: int, cap: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rotation, parts = product_code(unit.shape[1], blocks, words, seed)
    turned, scores, at = unit @ rotation, [], 0
    for part in parts:
        scores.append(turned[:, at : at + part.shape[1]] @ part.T)
        at += part.shape[1]
    best = [s.max(axis=1) for s in scores]
    row, word, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for k, score in enumerate(scores[:-1]):
        sums = total[:, None] + score[row]
        left = sum((b[row] for b in best[k + 1 :]), np.zeros(len(row)))  # the most that further blocks can add
        i, j = np.nonzero(sums >= (cap - left)[:, None])
        row, word, total = row[i], word[i] * words + j, sums[i, j]
    # The last block's scores in falling order: what reaches the cap is a beginning of them, found without a look at the rest.
    order = np.argsort(-scores[-1], axis=1)
    falling = (np.arange(len(unit)) * 4.0)[:, None] - np.take_along_axis(scores[-1], order, axis=1)
    reach = np.searchsorted(falling.ravel(), row * 4.0 - (cap - total), side="right") - row * words
    place = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    row = np.repeat(row, reach)
    return row, np.repeat(word, reach) * words + order[row, place]


@lru_cache(maxsize=64)
def _planes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(dims, SIGNS))


def signs(unit: np.ndarray, seed: int) -> np.ndarray:
    """The signs of random projections of each row, packed into two longs."""
    return np.packbits(unit @ _planes(unit.shape[1], seed) > 0, axis=1).view("<i8")


def differing(threshold: float) -> int:
    """The number of signs in which a pair at the threshold differs at most, but for a chance of MISSED."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    rest, most = 1.0, -1
    while rest > MISSED and most < SIGNS:
        most += 1
        rest -= math.comb(SIGNS, most) * p**most * (1 - p) ** (SIGNS - most)
    return most


def choose_cap(dims: int, codes: int, blocks: int, words: int, threshold: float, recall: float, seed: int, trials: int = 2000) -> float:
    """The largest cap on a grid at which simulated pairs at the threshold share a filter often enough."""
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(2, trials, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(1 - threshold**2) * y
    width = codes * words ** min(blocks, dims)
    grid = np.arange(0.9, 0.0, -0.005)
    low, high = 0, len(grid)  # a lower cap has all filters of a higher one, so that the first cap that does is found by halving
    while low < high:
        cap = grid[(low + high) // 2]
        keys = [set((row * width + word).tolist()) for row, word in (decode(v, codes, blocks, words, cap, seed) for v in (x, y))]
        if len({k // width for k in keys[0] & keys[1]}) >= recall * trials:
            high = (low + high) // 2
        else:
            low = (low + high) // 2 + 1
    return float(grid[low]) if low < len(grid) else 0.0


def _units(raw: pd.Series, kind: str) -> np.ndarray:
    values = np.stack([np.frombuffer(x, kind) for x in raw]).astype(float)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


_GROUP = ["label", "dims", "filter", "low", "high"]


def _joined(near: np.ndarray) -> np.ndarray:
    """The smallest row that links reach, for each row of a symmetric matrix."""
    parent, before = np.arange(len(near)), None
    while before is None or (parent != before).any():
        before = parent
        parent = np.minimum(parent, np.where(near, parent, len(near)).min(axis=1))
        parent = parent[parent]
    return parent


def _links(key: np.ndarray, copies: np.ndarray, filters: np.ndarray, near: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the linked rows of two blocks of a filter: keys, links counted in their first common filter, and local roots."""
    order = np.argsort(key, kind="stable")
    key, copies, filters, near = key[order], copies[order], filters[order], near[np.ix_(order, order)]
    root = key[_joined(near)]
    lists = [x[: np.searchsorted(x, own)] for x in filters]  # ascending
    row, flat = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    if len(flat):
        names, column = np.unique(flat, return_inverse=True)
        has = np.zeros((len(lists), len(names)), np.float32)
        has[row, column] = 1
        near = near & (has @ has.T == 0)
    return key, near @ copies, root


def _meet(differ: int):
    """Of (part, filter, node, s0, s1) in order, the classes that may link in a filter; a filter may cross batches."""

    def met(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        part, name, node, first, second = columns
        stays = np.zeros(len(node), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > MOST:
                stays[a:b] = True
            elif b - a > 1:
                x, y = first[a:b], second[a:b]
                for at in range(0, b - a, _CHUNK):
                    apart = np.bitwise_count(x[at : at + _CHUNK, None] ^ x) + np.bitwise_count(y[at : at + _CHUNK, None] ^ y)
                    stays[a + at : a + at + len(apart)] = np.count_nonzero(apart <= differ, axis=1) > 1
        return pa.RecordBatch.from_pydict({"part": part[stays], "filter": name[stays], "node": node[stays]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            columns[3:] = [c.view(np.uint64) for c in columns[3:]]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
            part, name = columns[:2]
            starts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (name[1:] != name[:-1]))))
            yield met([c[: starts[-1]] for c in columns], starts[:-1], starts[1:])
            rest = [c[starts[-1] :] for c in columns]
        if rest is not None:
            yield met(rest, np.zeros(1, int), np.array([len(rest[0])]))

    return released(meet)


def _compare(kind: str, threshold: float):
    """Compares the blocks of many filters; the rows of a group stand together, in order, and may cross batches."""

    def starts_of(rows: pd.DataFrame) -> np.ndarray:
        differs = np.zeros(len(rows), bool)
        differs[0] = True
        for c in _GROUP:
            values = rows[c].to_numpy()
            differs[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(differs)

    def compared(rows: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        block, dims, low, high, own_filter, key, copies, filters = (rows[c].to_numpy() for c in ("block", "dims", "low", "high", "filter", "key", "copies", "filters"))
        ends = np.append(starts[1:], len(rows))
        unit, unit_from, unit_to, found = None, 0, 0, []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < 2:
                continue
            if b > unit_to:  # the units of the groups that follow, as far as they have equally many components
                other = np.flatnonzero(dims[a:] != dims[a])
                unit_from, unit_to = a, a + (other[0] if len(other) else len(dims) - a)
                unit = _units(rows["raw"].iloc[unit_from:unit_to], kind)
            own = unit[a - unit_from : b - unit_from]
            near = own @ own.T >= threshold
            np.fill_diagonal(near, False)
            if low[a] != high[a]:
                near &= block[a:b, None] != block[None, a:b]
            linked = np.flatnonzero(near.any(axis=1))
            if len(linked):
                at = a + linked
                found.append(_links(key[at], copies[at], filters[at], near[np.ix_(linked, linked)], own_filter[a]))
        if found:
            yield pd.DataFrame({name: np.concatenate(parts) for name, parts in zip(("key", "links", "root"), zip(*found, strict=True), strict=True)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rows):
                starts = starts_of(rows)
                yield from compared(rows.iloc[: starts[-1]], starts[:-1])
                rest = rows.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield from compared(rest, np.zeros(1, int))

    return released(compare)


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.93,
    recall: float = 0.99,
    codes: int = 16,
    blocks: int = 2,
    per_filter: int = 8,
    block: int = 1024,
    seed: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    ``per_filter`` sets the number of filters, about a filter for so many vectors, so that filters don't grow
    with the table.
    """
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, bytes] = {}
        for batch in batches:
            lists = batch.column("embedding")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)  # null components are NaN
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
            odd, some = (np.concatenate(([0], np.cumsum(x)))[ends] for x in (~np.isfinite(values), values != 0))
            usable, data, rows = (odd[1:] == odd[:-1]) & (some[1:] > some[:-1]), values.tobytes(), []
            for i, name in enumerate(batch.column("label").to_pylist()):
                if name is None or not usable[i]:
                    rows.append((None, None, None))
                    continue
                if name not in names:
                    if len(names) >= 10_000:
                        names.clear()
                    names[name] = hashlib.blake2b(name.encode()).digest()
                raw = data[ends[i] * values.itemsize : ends[i + 1] * values.itemsize]
                rows.append((hashlib.blake2b(raw, digest_size=16, key=names[name]).digest(), raw, len(raw) // values.itemsize))
            key, raw, dims = zip(*rows, strict=True) if rows else ((), (), ())
            found = {"key": pa.array(key, pa.binary()), "raw": pa.array(raw, pa.binary()), "dims": pa.array(dims, pa.int32())}
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), **found})

    id_type = dict(vectors.dtypes)[vec_id]
    chosen = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    # Read twice: to be kept, it would take as much disk as the input.
    rows = chosen.mapInArrow(keyed, f"vec_id {id_type}, label string, key binary, raw binary, dims int")
    sizes = {r["dims"]: r["n"] for r in chosen.where("label is not null").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).where("dims > 0").collect()}
    plan = {}
    for dims, n in sizes.items():
        words = max(4, int(np.ceil((n / per_filter / codes) ** (1 / min(blocks, dims)))))
        plan[dims] = (words, choose_cap(dims, codes, blocks, words, threshold, recall, seed))

    def to_filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                words, cap = plan[dims]
                unit = _units(part["raw"], kind)
                row, word = decode(unit, codes, blocks, words, cap, seed)
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                s0, s1 = signs(unit, seed).T
                yield part.assign(filters=[word[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], s0=s0, s1=s1)

    equal = rows.where(F.col("key").isNotNull()).groupBy("label", "dims", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("raw").alias("raw"))
    classes = equal.mapInPandas(to_filters, f"label string, dims int, key binary, copies long, first_id {id_type}, raw binary, filters array<long>, s0 long, s1 long")
    # A class is named by a number from here on; the numbers are written once and read from then on.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    place = ["part", "filter"]
    met = classes.select(F.xxhash64("label", "dims").alias("part"), F.explode("filters").alias("filter"), "node", "s0", "s1").repartition(*place).sortWithinPartitions(*place)
    stay = stored(met.mapInArrow(_meet(differing(threshold)), "part long, filter long, node long"), "filters")
    large = stay.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > block)
    placed = stay.join(sized(large), place, "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("filter", "node", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "block")
    pairs = classes.select("node", "label", "dims", "key", "copies", "raw", "filters").join(sized(placed), "node").drop("node")
    dealt = pairs.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    compared = checkpointed(dealt.mapInPandas(_compare(kind, threshold), "key binary, links long, root binary"))

    linked = compared.groupBy("key").agg(F.sum("links").alias("links"))
    graph = components(compared.select("key", "root"), "key", "root")
    named = classes.select("key", "copies", "first_id").join(linked, "key", "left").join(graph, F.col("key") == F.col("node"), "left")
    named = named.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first_id", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = named.join(smallest, "component").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
