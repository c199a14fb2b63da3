import math

import numpy as np

from siftwire.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute_force(rows, threshold):
    def usable(v, label):
        return label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)

    n = len(rows)
    unit = [np.array(r[1], np.float32).astype(float) if usable(r[1], r[2]) else None for r in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((row[0], links[i], component, row[0] is not None and row[0] == component))
    return out


def made_up():
    rng = np.random.default_rng(3)
    rows = []
    for group in range(30):
        base = rng.normal(size=24)
        for _ in range(rng.choice([1, 2, 6])):
            rows.append(base + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.3]))
    rows += [rows[0] + rng.normal(size=24) * 0.05 for _ in range(70)]
    step = rng.normal(size=(2, 24))
    rows += [math.cos(a) * step[0] + math.sin(a) * step[1] for a in np.arange(0, 2.5, 0.08)]  # a chain
    rows = [(i, [float(np.float32(x)) for x in v], int(i) % 2 if i < 40 else 0, "old") for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] * 24, rows[0][1][:5], rows[0][1][:5]]
    rows += [(500 + i, v, 0, None) for i, v in enumerate(odd)]
    return rows + [(600, rows[0][1], None, None), (None, rows[0][1], 0, None), (0, rows[0][1], 0, "again"), (601, [2 * x for x in rows[0][1]], 0, "")]


def test_against_all_pairs(spark):
    rows = made_up()
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=16, recall=1.0)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows, 0.93), key=key)


def test_pairs_at_the_threshold_share_a_filter():
    cap = embed_dedup.choose_cap(64, 16, 2, 9, 0.93, 0.99, 5)
    rng = np.random.default_rng(99)
    x, y = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    found = [set(zip(*map(list, embed_dedup.decode(v, 16, 2, 9, cap, 5)), strict=True)) for v in (x, y)]
    assert len({row for row, _ in found[0] & found[1]}) >= 0.97 * 400


def test_empty_table(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels_that_begin_alike_stay_apart(spark):
    rows = [(1, [1.0, 2.0], "x" * 64 + "a"), (2, [1.0, 2.0], "x" * 64 + "b"), (3, [1.0, 2.0], "x" * 64 + "b")]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 1, 2, True), (3, 1, 2, False)]


def test_recall_of_the_whole_query_at_its_own_settings(spark):
    """Pairs planted at cosine 0.93 to 0.99 among others; every pair stands alone, so that none is found by way of a third."""
    rng, pairs = np.random.default_rng(12), 1500
    x, y = rng.normal(size=(2, pairs, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    cosine = np.repeat([0.9301, 0.94, 0.96], pairs // 3)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), int(i % pairs) % 3) for i, v in enumerate(np.concatenate((x, y, rng.normal(size=(2000, 64)))))]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), threshold=0.93)
    component = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in got.collect()}
    found = [component[i + pairs] == (i, 1) and component[i] == (i, 1) for i in range(pairs)]
    assert sum(found) >= 0.97 * pairs and all(component[i] == (i, 0) for i in range(2 * pairs, len(rows)))


def test_vectors_are_not_copied_to_all_filters(spark, monkeypatch):
    """The table of filters has no vectors, and of vectors that nothing is near to it has no rows."""
    tables, stored = {}, embed_dedup.stored
    monkeypatch.setattr(embed_dedup, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(300, 64)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert embed_dedup.near_duplicates(vectors).where("n_links > 0").count() == 0
    assert not {"raw", "embedding", "filters"} & set(tables["filters"].columns) and tables["filters"].count() < 300


def test_decoding_finds_what_a_look_at_all_filters_finds():
    rng = np.random.default_rng(4)
    for dims, blocks, words, cap in ((24, 2, 7, 0.3), (24, 3, 4, 0.25), (3, 1, 5, 0.5), (1, 2, 4, 0.9)):
        unit = rng.normal(size=(300, dims))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        got = set(zip(*map(np.ndarray.tolist, embed_dedup.decode(unit, 1, blocks, words, cap, 6)), strict=True))
        rotation, parts = embed_dedup.product_code(dims, blocks, words, 6)
        turned, sums, at = unit @ rotation, np.zeros((300, 1)), 0
        for part in parts:
            sums = (sums[:, :, None] + (turned[:, at : at + part.shape[1]] @ part.T)[:, None, :]).reshape(300, -1)
            at += part.shape[1]
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(sums >= cap)), strict=True)) and got


def test_signs_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    apart = np.bitwise_count(embed_dedup.signs(x, 5).view(np.uint64) ^ embed_dedup.signs(y, 5).view(np.uint64)).sum(axis=1)
    assert apart.max() <= embed_dedup.differing(0.93) < 40
