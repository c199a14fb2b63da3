import random
import re
from collections import defaultdict

from siftwire.llm import components, ngram_join

SCHEMA = "doc_id long, text string, source string"


def brute_force(rows, width, percent):
    """Sets of real shingles, all pairs, union-find."""
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        least[find(i)].append(row[0])
    out = []
    for i, row in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((row[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else row[0]))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def made_up(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for group in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 60, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy) + rng.choice(["", "", " " + common])
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text, f"s{group}"))
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(40):  # a chain: each copy is changed once more than the one before
        base[rng.randrange(80)] = rng.choice(words)
        rows.append((len(rows), "  " + "\n".join(base), None))
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n\t", "x"), (None, rows[-1][1], "x"), (5, rows[5][1], "x"), (903, "ÀÉ É", "x"), (904, "àé É", "x")]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    for seed, width, percent in ((1, 3, 90), (2, 5, 80)):
        rows = made_up(seed)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), width, percent)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows, width, percent), key=key)


def test_empty_table(spark):
    got = ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 300)] + [(5, j) for j in range(400, 500)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 301)} | {j: 5 for j in [5, *range(400, 500)]} | {8: 8, 9: 8}


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150_000)]
    near = list(base)
    near[7] = "other"
    rows = [(3, " ".join(base), "x"), (1, "\t" + "  ".join(near), "x"), (2, " ".join(base[:100_000]), "x"), (4, "z" * 700_000, "x"), (5, "Z" * 700_000, "x"), (6, " " * 700_000, "x")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted(map(tuple, got.collect())) == sorted(brute_force(rows, 3, 90))


def test_hot_lists_are_whole(spark, monkeypatch):
    """Every list counts as hot, so that all are salted."""
    monkeypatch.setattr(ngram_join, "HOT", 2)
    monkeypatch.setattr(ngram_join, "SALTS", 5)
    rows = made_up(7)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 3, 90)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows, 3, 90), key=key)


def test_no_pair_is_compared_again_after_its_list_was_compared_with_one_member(spark, monkeypatch):
    """Sets of words that meet by chance in lists of few: what the star of a list decided is not asked again."""
    rng, rounds, verified = random.Random(9), [], ngram_join._verified

    def recorded(docs, pairs, *rest):
        rounds.append({(r["a"], r["b"]) if r["a"] < r["b"] else (r["b"], r["a"]) for r in pairs.distinct().collect()})
        return verified(docs, pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", recorded)
    # Sets of two parts; each half stands in two sets, so that all lists have two members.
    halves = [[f"h{k}w{i}" for i in range(12)] for k in range(40)]
    rows = [(k, " ".join(rng.sample(halves[k], 12) + rng.sample(halves[(k + 1) % 40], 12)), "") for k in range(40)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 1, 30)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows, 1, 30), key=key)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 1, 50)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows, 1, 50), key=key)
    assert len(rounds) == 4 and all(rounds[::2]) and not any(first & second for first, second in zip(rounds[::2], rounds[1::2], strict=True))


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    kept, checkpointed = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: kept.append(df) or checkpointed(df))
    links = [(5, j) for j in range(400, 420)] + [(21, 20), (20, 21), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {j: 5 for j in [5, *range(400, 420)]} | {20: 20, 21: 20}
    assert len(kept) == 1
    # A path's middle isn't its smallest node.
    got = components.components(spark.createDataFrame([(3, 9), (1, 9), (9, 12)], "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 3: 1, 9: 1, 12: 1} and len(kept) > 2
