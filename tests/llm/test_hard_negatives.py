import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftwire.llm import hard_negatives
from siftwire.llm.integers import narrowed, products

SCHEMA = "vec_id long, embedding array<float>, label long, copy string, rank int, v int"


def quantised(rows):
    """The different rows that take part, components as Python integers."""
    kept = set()
    for vec_id, vector, label, *_ in rows:
        if None in (vec_id, vector, label) or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        kept.add((vec_id, tuple(math.floor(256 * x) for x in vector), label))
    return sorted(kept)


def brute_force(rows, positives=5, negatives=5):
    rows, out = quantised(rows), []
    for anchor, vector, label in (r for r in rows if r[0] % 5 == 0):
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, other) for i, v, other in rows if i != anchor and len(v) == len(vector))
        for low, positive, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 80 * -low <= 100 * -s[0] <= 100 * -low]
            out += [(anchor, positive, k + 1, s[1], -low, -s[0]) for k, s in enumerate(window[:negatives])]
    return sorted(out)


def made_up(n=150, dims=7):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=dims)).round(1).tolist(), 0 if i % 3 else i % 5) for i in range(n)]
    rows += [(n + i, rows[i][1], 1) for i in range(20)]  # ties
    rows += [rows[5], rows[7], (10, rows[3][1], 2), (15, rows[4][1], rows[15][2])]  # repeated rows, and other rows with an id
    odd = [None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [], [0.0] * dims, rows[0][1][:3], rows[0][1][:3], []]
    rows += [(300 + 5 * i, v, 0) for i, v in enumerate(odd)] + [(400, [0.0] * dims, 1), (405, rows[0][1][:3], 1), (None, rows[0][1], 0), (500, rows[0][1], None)]
    return [(*r, "x", 1, 2) for r in rows]


def mined(spark, rows, **options):
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_against_all_pairs_in_small_tiles(spark):
    rows = made_up()
    want = brute_force(rows)
    assert len(want) > 300
    # Several chunks of components, strips, blocks of anchors and blocks of rows, and one of each.
    assert mined(spark, rows, chunk=3, anchor_block=9, row_block=30) == want
    assert mined(spark, rows) == want


def test_a_label_with_most_rows_is_only_more_blocks(spark):
    rows = [(*r[:2], 0 if r[0] and r[0] % 9 else r[2], *r[3:]) for r in made_up()]
    assert mined(spark, rows, chunk=4, anchor_block=5, row_block=16, positives=3, negatives=2) == brute_force(rows, 3, 2)


def test_large_components_keep_every_digit(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e6], i % 2, "", 0, 0) for i in range(40)]
    assert mined(spark, rows, chunk=2) == brute_force(rows)
    beyond = [(i, [3e38, -3e38, 1.0, float(i)], i % 2, "", 0, 0) for i in range(12)]
    assert all(abs(r[4]) < 2**63 for r in mined(spark, beyond))


def test_no_rows_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0, "", 0, 0), (2, [1.0], 1, "", 0, 0)]) == []
    assert mined(spark, [(5, [1.0], 0, "", 0, 0), (2, [1.0], 1, "", 0, 0)]) == []  # no positive


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for size in (100, 2**28):
        a, b = rng.integers(-size, size, (5, 6)), rng.integers(-size, size, (4, 6))
        assert products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    sizes = defaultdict(str, {kind: narrowed(np.array([n]))[0] for kind, n in (("<i1", 127), ("<i2", -129), ("<i4", 2**15), ("<i8", -(2**31) - 1))})
    assert all(k == v for k, v in sizes.items())
