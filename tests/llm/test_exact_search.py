import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwire.llm import exact_search
from tests.llm.test_hard_negatives import quantised

SCHEMA = "vec_id long, embedding array<float>, label long, copy string, score double, pivot int"


def brute_force(rows, k=5):
    rows, out = [(i, v) for i, v, _ in quantised([(r[0], r[1], 0) for r in rows])], []
    for query, vector in (r for r in rows if r[0] % 5 == 0):
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i) for i, v in rows if i != query and len(v) == len(vector))
        out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def made_up(n=240, dims=6):
    rng = np.random.default_rng(4)
    centres = 3 * rng.normal(size=(8, dims))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=dims)).round(2).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]  # a group of copies
    rows += [rows[5], (10, rows[4][1])]
    odd = [None, [None] * dims, [float("nan")] * dims, [float("-inf")] + [0.0] * (dims - 1), [], [0.0] * dims, rows[0][1][:2], rows[0][1][:2], []]
    rows += [(600 + 5 * i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]
    return [(*r, None, "x", 0.5, 7) for r in rows]


def searched(spark, rows, **options):
    found = exact_search.search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("options", [{}, {"block": 8, "query_block": 7, "sample": 64, "growth": 2}, {"block": 4, "pivots": 3, "rings": 3, "sample": 5}])
def test_against_all_pairs(spark, options):
    rows = made_up()
    want = brute_force(rows)
    assert len(want) > 200 and searched(spark, rows, **options) == want


def test_more_results_than_rows(spark):
    rows = made_up(30)
    assert searched(spark, rows, k=1000, block=8) == brute_force(rows, 1000)


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e6], None, "", 0.0, 0) for i in range(60)]
    assert searched(spark, rows, block=4, sample=40) == brute_force(rows)


def test_no_rows_no_queries(spark):
    assert searched(spark, []) == [] and searched(spark, [(1, [1.0], None, "", 0.0, 0)]) == []


def test_bounds_stop_far_annuli():
    """In clusters a query reaches few annuli once it knows its k-th best, and never loses a vector above that."""
    rng = np.random.default_rng(6)
    centres = 300 * rng.normal(size=(10, 8))
    vectors = np.concatenate([c + 3 * rng.normal(size=(50, 8)) for c in centres]).astype(np.int64)
    longest = float((vectors**2).sum(axis=1).max())
    d = exact_search.Directory(exact_search.far_apart(vectors, 10, longest), longest)
    far = exact_search.distances(vectors, d.pivots, longest)
    nearest = far.argmin(axis=1)
    d.pivot = np.arange(10)
    d.ring = d.parts = np.zeros(10, int)
    d.low, d.high = (np.array([f(far[nearest == p, p]) for p in range(10)]) for f in (min, max))
    queries = vectors[np.argsort(-(vectors**2).sum(axis=1))[:20]]
    scores = queries @ vectors.T
    kth = np.sort(scores, axis=1)[:, -5]
    row, annulus = d.reach(queries, kth.astype(float), 0, 10)
    assert len(row) <= 3 * len(queries)
    reached = set(zip(row.tolist(), annulus.tolist(), strict=True))
    for i, j in zip(*np.nonzero(scores >= kth[:, None]), strict=True):
        assert (i, nearest[j]) in reached
