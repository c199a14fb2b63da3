import random
from datetime import datetime
from decimal import Decimal

from siftwire.streaming import jobs, seen

ITEM = "seq long, source string, id string, title string, url string, body string, timestamp long"


def test_bounded_seen_ids_forget_the_oldest(spark, tmp_path):
    rows = [(i, "a", f"a:{i}", "t", "", "", 0) for i in range(6)] + [(6, "a", "a:0", "t", "", "", 0), (7, "a", "a:5", "t", "", "", 0), (8, "a", "", "t", "", "", 0)]
    log, out, memory, state = (str(tmp_path / x) for x in ("log", "out", "memory", "state"))
    spark.createDataFrame(rows, ITEM).coalesce(1).write.parquet(log)
    run = lambda: seen.first_seen(jobs.log(spark, log, ITEM), out, memory, state, remembered=5).awaitTermination(200)
    assert run()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 6]
    spark.createDataFrame([(9, "a", "a:5", "t", "", "", 0), (10, "b", "a:5", "t", "", "", 0), (11, None, "a:5", "t", "", "", 0)], ITEM).coalesce(1).write.mode("append").parquet(log)
    assert run()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 6, 10, 11]
    # A batch that is run again starts from the same memory and leaves one copy.
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "state" / name).unlink(missing_ok=True)
    assert run()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5, 6, 10, 11]


def test_two_thousand_and_one_ids(spark):
    ids = [(i, "a", f"a:{i}") for i in range(2001)] + [(2001, "a", "a:0"), (2002, "a", "a:2"), (2003, "a", "a:1")]
    keys = spark.createDataFrame(ids, "seq long, source string, id string").repartition(4)
    found = sorted(map(tuple, seen.fresh_ids(keys, spark.createDataFrame([], seen.MEMORY)).select("seq", "place").collect()))
    assert found == [(i, i + 1) for i in range(2002)] + [(2003, 2003)]


def plain_memory(rows, remembered):
    """One row after another."""
    memory, fresh = {}, []
    for source, seq, name in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        ids = memory.setdefault(source, {})
        if name not in ids:
            ids[name] = None
            if len(ids) > remembered:
                del ids[next(iter(ids))]
            fresh.append((source, seq, name))
    return memory, sorted(fresh)


def test_a_hot_source_over_several_batches(spark):
    rng = random.Random(4)
    memory, so_far, got = spark.createDataFrame([], seen.MEMORY), [], []
    for batch in range(3):
        rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), batch * 1000 + i, f"i{rng.choice([rng.randrange(30), rng.randrange(400), 7])}") for i in range(1000)]
        so_far += rows
        found = seen.fresh_ids(spark.createDataFrame(rows + rows[:5], "source string, seq long, id string").repartition(5), memory, 20).cache()
        got += [(r["source"], r["seq"], r["id"]) for r in found.collect()]
        memory = spark.createDataFrame(seen.next_memory(memory, found, 20).collect(), seen.MEMORY)
    want, fresh = plain_memory(so_far, 20)
    assert sorted(got) == fresh
    left = {}
    for r in sorted(memory.collect(), key=lambda r: r["place"]):
        left.setdefault(r["source"], []).append(r["id"])
    assert left == {k: list(v) for k, v in want.items()}


def test_values_of_items_stay_as_they_are(spark, tmp_path):
    """Micros of a time, decimals and nested values pass the memory untouched."""
    schema = "seq long, source string, id string, at timestamp, price decimal(20,10), parts array<struct<a:double>>"
    rows = [(1, "a", "x", datetime(2024, 1, 1, 0, 0, 0, 123456), Decimal("1.0000000001"), [(0.1 + 0.2,)])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    assert seen.first_seen(jobs.log(spark, str(tmp_path / "log"), schema), str(tmp_path / "out"), str(tmp_path / "memory"), str(tmp_path / "state")).awaitTermination(200)
    assert spark.read.schema(schema).parquet(str(tmp_path / "out")).drop("batch").collect() == spark.createDataFrame(rows, schema).collect()


def test_score_log_gate_log_and_dead_letters(spark, tmp_path):
    rows = [(1, "feed", "feed:1", "award", "http://a.com/x", "b", 0), (2, "github", "github:1", "t", "", "b", 0), (3, "feed", None, "t", "", "b", 0)]
    log, good, dead, scored, gated = (str(tmp_path / x) for x in ("log", "good", "dead", "scored", "gated"))
    spark.createDataFrame(rows, ITEM).write.parquet(log)
    assert jobs.with_dead_letters(jobs.log(spark, log, ITEM), ["id"], good, dead, str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(dead).select("seq").first()["seq"] == 3
    items = spark.readStream.schema(ITEM + ", batch int").parquet(good)
    assert jobs.append(jobs.summarize_and_score(items.drop("batch"), 0), scored, str(tmp_path / "c2")).awaitTermination(120)
    assert {r["seq"]: (r["summary"], r["score"]) for r in spark.read.parquet(scored).collect()} == {1: ("award — b", 2.0), 2: ("t — b", 1.0)}
    pubs = spark.createDataFrame([(1, "7", "a.com", "active", "x y", "")], "ord long, atomic_site_id string, domain_name string, status string, publisher_name string, aliases string")
    assert jobs.decisions(items.drop("batch"), lambda: pubs, gated, str(tmp_path / "c3"), "v", lambda: "2024-01-01T00:00:00+00:00").awaitTermination(120)
    assert {r["item_id"]: r["decision"] for r in spark.read.json(gated).collect()} == {"feed:1": "pass", "github:1": "bypass"}


def test_completion_counts_distinct_sources_across_batches(spark, tmp_path):
    schema = "seq long, cycle long, kind string, source string"
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    for batch in ([(1, 0, "done", "a"), (2, 0, "done", "a")], [(3, 0, "done", "b"), (4, 1, "done", "b")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(log)
        assert jobs.append(jobs.completion(jobs.log(spark, log, schema), 2), out, state).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).select("seq", "done", "complete").collect())) == [(1, 1, False), (2, 1, False), (3, 2, True), (4, 1, False)]


def plain_places(rows, remembered, before=()):
    """(source, seq, id, place) of the fresh rows, one row after another."""
    held, count, out = {}, {}, []
    for source, name, place in before:
        held[source, name], count[source] = place, max(place, count.get(source, 0))
    for source, seq, name in sorted(rows):
        place = held.get((source, name))
        if place is None or count[source] - place >= remembered:
            held[source, name] = count[source] = count.get(source, 0) + 1
            out.append((source, seq, name, count[source]))
    return sorted(out)


def counted_calls(monkeypatch, name):
    calls, real = [], getattr(seen, name)
    monkeypatch.setattr(seen, name, lambda *a, **k: calls.append(a) or real(*a, **k))
    return calls


def test_rounds_do_not_grow_with_chains_of_repeats(spark, monkeypatch):
    """Ids that come back just after they are forgotten: who is fresh depends on all rows before."""
    rows = [("a", i, f"i{i % 23}") for i in range(400)] + [("b", i, f"i{i * (i * 7919 % 1500) % 211}") for i in range(400)]
    jobs_before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = seen.fresh_ids(spark.createDataFrame(rows, "source string, seq long, id string").repartition(4), spark.createDataFrame([], seen.MEMORY), 20)
    assert sorted(map(tuple, found.select("source", "seq", "id", "place").collect())) == plain_places(rows, 20)
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs_before) < 60


def test_blocks_of_a_source_agree_with_the_plain_loop(spark, monkeypatch):
    rng = random.Random(6)
    shapes = {
        "chains": lambda i: rng.randrange(40),
        "few": lambda i: i % 7,
        "round": lambda i: i % 11,
        # Hits that keep an old difference: the memory changes about once in a block.
        "slow": lambda i: 1000 + i // 60 if i % 60 == 0 else rng.randrange(8),
        "rare": lambda i: rng.randrange(12) if i % 2 else 0,
    }
    rows = [(name, i, f"i{shape(i)}") for name, shape in shapes.items() for i in range(1500)] + [("one", 3, "x"), ("one", 4, "x")]
    before = [("chains", f"i{i}", 30 + i) for i in range(12)] + [("slow", "i3", 4), ("other", "x", 9)]
    monkeypatch.setattr(seen, "GROWTH", 3)
    calls = counted_calls(monkeypatch, "_round")
    found = seen.fresh_ids(spark.createDataFrame(rows, "source string, seq long, id string").repartition(4), spark.createDataFrame(before, seen.MEMORY), 10, block=60)
    assert sorted(map(tuple, found.select("source", "seq", "id", "place").collect())) == plain_places(rows, 10, before)
    assert 2 < len(calls) < 12
