from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwire.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, epoch string"


def test_shortage_goes_to_siblings_before_ancestors():
    capacity = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "x"): 1000.0}
    # a gets 50: x can take 10 of its 25, so its sibling y takes 40, and b nothing more.
    assert mixing.share_out(100, {}, capacity) == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "x"): 50.0}
    # a gets 150 but holds 110: what a's children can't take goes to b.
    assert mixing.share_out(300, {}, capacity) == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "x"): 190.0}
    assert mixing.share_out(5000, {}, capacity) == capacity
    assert mixing.share_out(100, {("a",): 3.0, ("b",): 1.0, ("a", "x"): 0.0}, capacity) == {("a", "x"): 0.0, ("a", "y"): 75.0, ("b", "x"): 25.0}
    assert mixing.share_out(10, {}, {}) == {}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz")), st.floats(0, 1000), min_size=1), st.floats(0, 4000))
def test_whole_budget_is_used_within_capacity(capacity, budget):
    out = mixing.share_out(budget, {("a",): 2.0}, capacity)
    assert all(-1e-6 <= out.get(leaf, 0) <= capacity[leaf] + 1e-6 for leaf in capacity)
    assert abs(sum(out.values()) - min(budget, sum(capacity.values()))) < 1e-6 * (1 + budget)


def test_selection_against_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 13 + 1), "en" if i % 4 else None, "hot" if i % 3 else f"s{i % 5}", "old") for i in range(600)]
    rows += [(700, None, "de", "s1", ""), (701, "", "de", "s1", ""), (None, "a b", "en", "hot", ""), (3, rows[3][1], rows[3][2], rows[3][3], "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for budget, epochs in ((0.5, 1.0), (1.0, 2.0), (900, 3.0)):
        weights = {("en",): 5.0, ("", "s0"): 3.0}
        got = [tuple(r) for r in mixing.mix(docs, ["lang", "source"], weights, budget, max_epochs=epochs, seed=3).select("doc_id", "source", "n_tokens", "epoch").collect()]

        leaves = defaultdict(list)
        for r in docs.withColumn("key", mixing.row_key()).withColumn("n", mixing.word_count(F.col("text"))).collect():
            leaves[(r["lang"] or "", r["source"])].append(r)
        have = {p: sum(r["n"] for r in rs) for p, rs in leaves.items()}
        plan = mixing.share_out(budget if budget > 1 else budget * sum(have.values()), weights, {p: n * epochs for p, n in have.items()})
        want = []
        for path, members in leaves.items():
            left = plan[path] + 1e-6
            whole = int(left // have[path]) if have[path] else 0
            rest = int(left - whole * have[path])
            keys = spark.createDataFrame([(r["key"],) for r in members], "key long").select("key", mixing.place(3, F.lit(whole), F.col("key")).alias("p")).distinct().collect()
            place = {r["key"]: r["p"] for r in keys}
            taken, fits, by_place = 0, rest > 0, defaultdict(list)
            for r in members:
                by_place[place[r["key"]]].append(r)
            for p in sorted(by_place):
                taken += sum(r["n"] for r in by_place[p])
                fits = fits and taken <= rest
                for r in by_place[p]:
                    want += [(r["doc_id"], r["source"], r["n"], e) for e in range(whole + fits)]
        key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), ["lang"], {}, 1.0).count() == 0


def test_budgets_as_tables_are_those_of_the_driver(spark, monkeypatch):
    import random

    rng = random.Random(8)
    for _ in range(4):
        paths = {tuple(rng.choice("abcd") for _ in range(3)) for _ in range(rng.choice([1, 12, 40]))}
        have = {p: rng.choice([0, 1, 7, 100, 1000]) for p in paths}
        weights = {p[:k]: rng.choice([0.0, 0.5, 3.0]) for p in paths for k in (1, 2, 3) if rng.random() < 0.3}
        leaves = spark.createDataFrame([("/".join(p), list(p), n) for p, n in have.items()], "leaf string, path array<string>, n long").repartition(3)
        for budget in (0.0, 50.0, 0.6 * sum(have.values()), 1e6):
            want = mixing.share_out(budget, weights, {p: 2.0 * n for p, n in have.items()})
            got = {r["leaf"]: r["b"] for r in mixing.planned(leaves, weights, budget, 2.0, 3).collect()}
            assert got.keys() == {"/".join(p) for p in have}
            assert all(abs(got["/".join(p)] - want.get(p, 0.0)) < 1e-6 for p in have), (have, weights, budget)


def test_more_leaves_than_the_driver_plans_for(spark, monkeypatch):
    rows = [(i, "w " * (i * 5 % 11 + 1), "en" if i % 4 else None, f"s{i % 37}", "old") for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = lambda: sorted(map(tuple, mixing.mix(docs, ["lang", "source"], {("en",): 5.0, ("", "s0"): 0.0}, 0.7, max_epochs=2.0, seed=3).select("doc_id", "n_tokens", "epoch").collect()))
    want = mixed()
    monkeypatch.setattr(mixing, "MAX_LEAVES", 10)
    assert mixed() == want and want


def test_shortage_of_weighted_children_goes_to_those_of_weight_0():
    capacity = {("a",): 10.0, ("b",): 100.0, ("c",): 100.0}
    assert mixing.share_out(70, {("b",): 0.0, ("c",): 0.0}, capacity) == {("a",): 10.0, ("b",): 30.0, ("c",): 30.0}
    assert mixing.share_out(5, {("b",): 0.0, ("c",): 0.0}, capacity) == {("a",): 5.0, ("b",): 0.0, ("c",): 0.0}


def test_very_long_texts(spark):
    rows = [(1, "w " * 500_000, "en", "a", ""), (2, "x y", "en", "a", ""), (3, "z", "de", "b", "")]
    got = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, SCHEMA), ["lang", "source"], {}, 1.0, max_epochs=1.0).select("doc_id", "n_tokens", "epoch").collect()))
    assert got == [(1, 500_000, 0), (2, 2, 0), (3, 1, 0)]
