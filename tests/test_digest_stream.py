"""The digest stream against the batch operators on the same events, over several runs of one checkpoint."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from siftwire.operators import cycles, items
from siftwire.streaming import digest, jobs

TOTAL = 3


def made_up(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choices(["item", "done", "reset", "regenerate", "other"], [90, 8, 1, 1, 1])[0]
        source = rng.choice(["github", "linear", "feed"])
        if kind != "item":
            rows.append((seq, kind, source, *[None] * 6))
            continue
        name = rng.choice(["", None, *(f"{source}:{i}" for i in range(40))])
        rows.append((seq, "item", source, name, f"t{seq}", "u", seq, None if seq % 50 == 0 else f"s{seq}", rng.choice([None, 1.0, 2.5, float(seq % 7)])))
    return rows


def batch_digests(events):
    """Each digest that is due, from the items of its cycle before it."""
    out = {}
    kept = cycles.collected(events).join(events.select("seq", "title", "summary", "score"), "seq")
    for cycle, seq in map(tuple, cycles.due(events, TOTAL).collect()):
        selected = items.selection(kept.where(f"cycle = {cycle} and seq < {seq}"))
        out[cycle, seq] = items.ranked_list(selected).first()["digest"]
    return out


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_of_a_batch_are_taken_in_order(spark, tmp_path):
    """Two files in one batch, each with rows that belong between those of the other."""
    rows = made_up(200, 2)
    spark.createDataFrame(rows[::2], digest.EVENT).coalesce(1).write.parquet(f"{tmp_path}/log")
    spark.createDataFrame(rows[1::2], digest.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    assert digest.run(jobs.log(spark, f"{tmp_path}/log", digest.EVENT), TOTAL, f"{tmp_path}/out", f"{tmp_path}/check", buckets=3).awaitTermination(300)
    events = cycles.with_cycle(spark.createDataFrame([r for r in rows if r[1] != "other"], digest.EVENT))
    assert sorted_rows(spark.read.parquet(f"{tmp_path}/out/kept").select("cycle", "seq", "source", "id")) == sorted_rows(cycles.collected(events))
    found = {(r["cycle"], r["at"]): r["digest"] for r in spark.read.parquet(f"{tmp_path}/out/digests").collect()}
    assert found == batch_digests(events) and found


def test_stream_of_whole_batches_equals_the_batch_operators(spark, tmp_path):
    rows = made_up()
    for part in range(4):
        spark.createDataFrame(rows[part * 150 : part * 150 + 150], digest.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        assert digest.run(jobs.log(spark, f"{tmp_path}/log", digest.EVENT), TOTAL, f"{tmp_path}/out", f"{tmp_path}/check", buckets=5).awaitTermination(300)
    events = cycles.with_cycle(spark.createDataFrame([r for r in rows if r[1] != "other"], digest.EVENT)).cache()
    out = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert sorted_rows(out("kept").select("cycle", "seq", "source", "id")) == sorted_rows(cycles.collected(events))
    assert sorted_rows(out("progress").select("cycle", "seq", "source", "done", "complete")) == sorted_rows(cycles.progress(events, TOTAL))
    found = {(r["cycle"], r["at"]): r["digest"] for r in out("digests").collect()}
    assert found == batch_digests(events) and len(found) > 10

    # The state, read without the logs: of the last cycle.
    view = digest.StateView(spark, f"{tmp_path}/check")
    last = events.agg(F.max("cycle")).first()[0]
    assert sorted_rows(view.snapshot()) == sorted_rows(cycles.snapshot(events, TOTAL).where(f"cycle = {last}"))
    assert view.snapshot() is view.snapshot()
    kept = cycles.collected(events).where(f"cycle = {last}").join(events.select("seq", "title", "score"), "seq")
    assert list(map(tuple, view.counts().collect())) == list(map(tuple, items.counts_by_source(kept).orderBy("first_seq").select("source", "n").collect()))
    top = items.first_ranked(kept).select("source", "rank", "title", F.coalesce("score", F.lit(0.0)))
    assert sorted_rows(view.top()) == sorted_rows(top)
    assert sorted_rows(view.items().select("seq")) == sorted_rows(kept.select("seq"))

    # A batch that is run again leaves one copy.
    before = sorted_rows(out("kept")), sorted_rows(out("digests"))
    for name in ("commits/3", "commits/.3.crc"):
        (tmp_path / "check" / name).unlink(missing_ok=True)
    assert digest.run(jobs.log(spark, f"{tmp_path}/log", digest.EVENT), TOTAL, f"{tmp_path}/out", f"{tmp_path}/check", buckets=5).awaitTermination(300)
    assert (sorted_rows(out("kept")), sorted_rows(out("digests"))) == before

    # Every version that is kept can be read; what changed is read anew.
    versions = [digest.snapshot(spark, f"{tmp_path}/check", v).first()["items"] for v in range(digest.version(spark, f"{tmp_path}/check") + 1)]
    assert versions[-1] == view.snapshot().first()["items"] and len(versions) == 4


def test_a_saved_state_is_where_a_stream_starts(spark, tmp_path):
    entries = [
        {"seq": -9, "id": "feed:1", "source": "feed", "title": "old", "summary": "old", "score": 9.0}, "no object", {"id": "feed:1", "source": "feed", "summary": "twice"},
        {"id": "", "source": "feed", "summary": "without an id"}, 7, {"source": "linear", "summary": "lin", "score": 1.5},
    ]
    saved = spark.createDataFrame([(4, json.dumps({"items": entries, "total": 2, "done": 1, "reported": ["feed", 3, "feed"]}))], "cycle long, state string")
    rows = [(1, "item", "feed", "feed:1", "seen", "", 0, "seen", 5.0), (2, "item", "github", "github:1", "new", "", 0, "new", 2.0), (3, "done", "feed", *[None] * 6), (4, "done", "github", *[None] * 6)]
    spark.createDataFrame(rows, digest.EVENT).coalesce(1).write.parquet(f"{tmp_path}/log")
    query = digest.run(jobs.log(spark, f"{tmp_path}/log", digest.EVENT), 9, f"{tmp_path}/out", f"{tmp_path}/check", buckets=4, saved=saved)
    assert query.awaitTermination(300)
    assert sorted_rows(spark.read.parquet(f"{tmp_path}/out/kept").select("cycle", "id")) == [(4, "github:1")]
    assert sorted_rows(spark.read.parquet(f"{tmp_path}/out/progress").select("seq", "done", "complete")) == [(3, 1, False), (4, 2, True)]
    (found,) = spark.read.parquet(f"{tmp_path}/out/digests").collect()
    assert (found["cycle"], found["at"]) == (4, 4)
    assert found["digest"] == "# Newsletter draft\n\n- old\n- without an id\n- lin\n- new\n"
    assert digest.snapshot(spark, f"{tmp_path}/check").first() == (4, 4, 2, 2)


def test_a_due_digest_without_items(spark, tmp_path):
    spark.createDataFrame([(1, "reset", *[None] * 7), (2, "regenerate", *[None] * 7)], digest.EVENT).write.parquet(f"{tmp_path}/log")
    assert digest.run(jobs.log(spark, f"{tmp_path}/log", digest.EVENT), 2, f"{tmp_path}/out", f"{tmp_path}/check", buckets=2).awaitTermination(300)
    assert sorted_rows(spark.read.parquet(f"{tmp_path}/out/digests").select("cycle", "at")) == [(1, 2)]


class Calls:
    """A state variable in memory that counts what is asked of it."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: bool(self.kept), "get": lambda: self.kept[()], "clear": self.kept.clear, "update": lambda v: self.kept.update({(): v}),
            "containsKey": lambda k: k in self.kept, "getValue": lambda k: self.kept[k], "updateValue": self.kept.__setitem__, "keys": lambda: iter(list(self.kept)),
            "iterator": lambda: iter(list(self.kept.items())), "appendList": lambda rows: self.kept.update((r[0], r) for r in rows),
        }[name]


def test_the_state_is_asked_for_the_last_cycle_and_not_for_each_row():
    """40 cycles of 50 items in one batch, then more of the last one."""
    processor = digest.DigestState(1, 3)
    states = {n: Calls() for n in ("cycle", "reported", "seen", "items", "best")}
    vars(processor).update(states)
    big = 1 << 60  # places that a double can't hold
    rows = []
    for cycle in range(40):
        rows.append((big + 1000 * cycle, "reset", *[None] * 7))
        rows += [(big + 1000 * cycle + i, "item", "ab"[i % 2], f"i{i % 40}", "t", "u", 1, "s", float(i)) for i in range(1, 51)]
        rows.append((big + 1000 * cycle + 99, "done", "a", *[None] * 6))
    frame = lambda rows: pd.DataFrame(rows, columns=[f.split()[0] for f in digest.EVENT.split(", ")])
    out = pd.concat(processor.handleInputRows((0,), iter([frame(rows[::-1])]), None))
    assert sum(s.calls for s in states.values()) < 100
    kept = out[out["what"] == "kept"]
    assert list(zip(kept["cycle"], kept["seq"], strict=True)) == [(c + 1, big + 1000 * c + i) for c in range(40) for i in range(1, 41)]
    assert len(out[out["what"] == "part"]) == 40 * 6 and len(out[out["what"] == "due"]) == 40
    assert len(states["seen"].kept) == len(states["items"].kept) == 40 and states["cycle"].kept[()] == (40, 1)
    last = [(big + 40_000, "item", "a", "i7", "t", "u", 1, "s", 99.0), (big + 40_001, "item", "a", "new", "t", "u", 1, "s", 50.0), (big + 40_002, "regenerate", *[None] * 7)]
    out = pd.concat(processor.handleInputRows((0,), iter([frame(last)]), None))
    assert list(out[out["what"] == "kept"]["id"]) == ["new"]
    assert sorted(out[out["what"] == "part"]["score"]) == [35.0, 37.0, 38.0, 39.0, 40.0, 50.0]


def counted(total):
    processor = digest.DigestState(total, 3)
    states = {n: Calls() for n in ("cycle", "reported", "seen", "items", "best")}
    vars(processor).update(states)
    return processor, states


def test_due_digests_of_a_batch_are_made_without_the_state():
    """A cycle of 30 items with a digest after each."""
    processor, states = counted(1)
    rows = [row for i in range(30) for row in ((2 * i, "item", "ab"[i % 2], f"i{i}", "t", "u", 1, "s", float(i)), (2 * i + 1, "done", "a", *[None] * 6))]
    out = pd.concat(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=[f.split()[0] for f in digest.EVENT.split(", ")])]), None))
    assert states["best"].calls + states["reported"].calls < 10
    assert list(out[out["what"] == "due"]["at"]) == list(range(1, 60, 2))
    for i in range(30):
        want = [x for first in (0, 1) for x in list(range(first, i + 1, 2))[-3:]]
        assert sorted(out[(out["what"] == "part") & (out["at"] == 2 * i + 1)]["score"]) == sorted(want)


def test_the_state_holds_what_the_last_cycle_left_and_nothing_else_was_written():
    processor, states = counted(9)
    rows = [(100 * c + i, "item", "ab"[i % 2], f"c{c}:{i % 20}", "t", "u", 1, "s", 1.0) for c in range(30) for i in range(1, 41)]
    rows += [(100 * c, "reset", *[None] * 7) for c in range(30)] + [(100 * c + 50, "done", "a", *[None] * 6) for c in range(30)]
    list(processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=[f.split()[0] for f in digest.EVENT.split(", ")])]), None))
    assert states["cycle"].kept[()] == (30, 9) and set(states["reported"].kept) == {("a",)}
    assert set(states["seen"].kept) == {(f"c29:{i}",) for i in range(20)} and len(states["items"].kept) == 20
    assert {k: v[:2] for k, v in states["best"].kept.items()} == {("a",): (10, 2902), ("b",): (10, 2901)}
    assert states["seen"].calls < 20 + 5 and states["items"].calls < 5
