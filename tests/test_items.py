import math

from pyspark.sql import Observation
from pyspark.sql import functions as F

from siftwire import service
from siftwire.config import PipelineConfig
from siftwire.functions import text as T
from siftwire.operators import cycles, enrich, items, lifecycle, logs

NOW = 1_704_067_200
SCORED = "seq long, source string, id string, title string, body string, timestamp long, relevance_score int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_times(spark):
    cases = {
        "2024-01-01T00:00:00Z": NOW,
        "Mon, 01 Jan 2024 00:00:00 GMT": NOW,
        "1 Jan 2024 01:00:00 +0100": NOW,
        "2024-01-01T02:00:00+02:00": NOW,
        "": 0,
        "soon": 0,
        None: 0,
    }
    for text, want in cases.items():
        assert one(spark, T.epoch(F.lit(text).cast("string"))) == want, text


def test_scores_have_exact_values(spark):
    week = 604_800
    rows = [
        (1, "a", "1", "t", "", NOW - week, 7),
        (2, "a", "2", "t", "", NOW, 7),
        (3, "a", "3", "t", "", 0, 7),
        (4, "a", "4", "t", "", NOW + 99, 7),
        (5, "a", "5", "Award: GA ships 10k million-LAUNCH", "", NOW, None),
        (6, "a", "6", "Garage awards éGAé", "", NOW, None),
        (7, "a", "7", None, "", NOW, None),
        (8, "a", "8", "", "", NOW, None),
    ]
    got = {r["seq"]: (r["score"], r["title"]) for r in items.score(spark.createDataFrame(rows, SCORED), NOW).collect()}
    assert [got[i][0] for i in range(1, 9)] == [7.74, 9.0, 7.0, 9.0, 7.0, 2.0, 1.0, 1.0]
    assert got[1][0] == round(7 + 2 / math.e, 2) and got[7][1] == "(untitled)" and got[8][1] == ""


def test_ranking_ties_keep_arrival_and_sources_their_first_order(spark):
    rows = [(i, "late" if i % 2 else "early", str(i), f"t{i}", "", 0, 5) for i in range(30)]
    scored = items.score(items.with_fallback_summary(spark.createDataFrame(rows, SCORED).repartition(4)), NOW)
    top = items.first_ranked(scored).where("source = 'late'").orderBy("rank").collect()
    assert [r["seq"] for r in top] == list(range(1, 21, 2))
    text = items.ranked_list(items.selection(scored, 1), "Draft").first()["digest"]
    assert text == "# Draft\n\n- t0 — \n- t1 — \n"
    selected = items.selection(scored, 1)
    assert items.compose(selected, " the reply ").first()["digest"] == " the reply "
    assert items.compose(selected, " \n").first()["digest"].startswith("# Newsletter draft")
    assert [r["source"] for r in service.counts(scored).collect()] == ["early", "late"]


def test_dedup_keeps_the_first_and_all_blanks(spark):
    rows = [(3, "a", "x"), (1, "a", "x"), (2, "a", ""), (4, "a", ""), (5, "a", None)]
    df = spark.createDataFrame(rows, "seq long, source string, id string")
    assert [r["seq"] for r in items.first_by_id(df).collect()] == [1]
    kept = items.first_by_id(df, keep_blank=True)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 2, 4, 5]
    assert items.first_by_id(kept, keep_blank=True).count() == 4


def test_reset_and_completion(spark):
    rows = [
        (1, "item", "a", "x"), (2, "done", "a", None), (3, "done", "a", None), (4, "done", "b", None), (5, "done", "b", None),
        (6, "reset", "", None), (7, "item", "a", "x"), (8, "item", "a", "x"), (9, "item", "b", ""), (10, "item", "b", ""), (11, "done", "b", None), (12, "regenerate", "", None),
    ]
    events = cycles.with_cycle(spark.createDataFrame(rows, "seq long, kind string, source string, id string").repartition(3), block=4)
    assert [(r["seq"], r["cycle"]) for r in events.orderBy("seq").collect()] == [(i, int(i >= 6)) for i in range(1, 13)]
    assert [(r["seq"], r["done"], r["complete"]) for r in cycles.progress(events, 2).orderBy("seq").collect()] == [(2, 1, False), (3, 1, False), (4, 2, True), (5, 2, True), (11, 1, False)]
    assert sorted(r["seq"] for r in cycles.due(events, 2).collect()) == [4, 5, 12]
    assert sorted(r["seq"] for r in cycles.collected(events).collect()) == [1, 7, 9, 10]
    saved = {r["cycle"]: (r["items"], r["done"], r["total"]) for r in cycles.snapshot(events, 2).collect()}
    assert saved == {0: (1, 2, 2), 1: (3, 1, 2)}


def test_model_replies(spark):
    good = '{"summary": "s", "relevance_score": %s, "reason": "r"}'
    replies = {good % "-3": ("s", 0, "r"), good % "42": ("s", 10, "r"), good % '"8"': ("s", 8, "r"), good % "7.6": ("s", 7, "r"), '{"summary": ""}': ("", 0, ""), '{"summary": 5}': (None,) * 3, "none": (None,) * 3, None: (None,) * 3}
    replies |= {f"x {good % 1} y": ("s", 1, "r"), f"{good % 1} and {good % 2}": (None,) * 3}
    df = spark.createDataFrame([(k,) for k in replies], "reply string")
    got = {r["reply"]: tuple(r["e"]) for r in df.select("reply", enrich.read_reply("reply").alias("e")).collect()}
    assert got == replies
    names = spark.createDataFrame([('{"orgs": [" A ", 5, "", null], "people": "x"}',), ("broken {",)], "reply string")
    assert [tuple(r["e"]) for r in names.select(enrich.read_entities("reply").alias("e")).collect()] == [(["A"], [], []), ([], [], [])]


def test_enrich_falls_back_where_the_model_fails(spark):
    class Canned:
        def chat(self, messages, **options):
            if "fail" in messages[1]["content"]:
                raise OSError("no answer")
            return '{"summary": "from the model", "relevance_score": 4}'

    rows = [(1, "a", "1", "fine", "b", 0), (2, "a", "2", "fail", "b" * 99, 0)]
    df = spark.createDataFrame(rows, "seq long, source string, id string, title string, body string, timestamp long")
    got = {r["seq"]: (r["summary"], r["relevance_score"]) for r in enrich.enrich(df, Canned).collect()}
    assert got == {1: ("from the model", 4), 2: ("fail — " + "b" * 80, None)}
    plain = enrich.enrich(df, None)
    assert "body" not in plain.columns and plain.where("relevance_score is null").count() == 2


def test_logs(spark):
    segments = spark.createDataFrame([("d.9", "nine"), ("d.10", "ten"), ("d.tmp", "x")], "path string, content string")
    assert logs.latest_segment(segments).first()["digest"] == "ten"
    assert logs.latest_segment(segments.where("path = 'd.tmp'")).first()["digest"] == ""


def test_segments_expire_by_number_and_age(spark):
    rows = [(f"d.{i}", "d", i, float(i)) for i in range(1, 11)]
    segments = spark.createDataFrame(rows, "path string, log string, number long, written double")

    def gone(*rules):
        return sorted(r["number"] for r in logs.expired(segments, *rules).collect())

    assert gone(3, 5.0, 0.0, 12.0) == [1, 2, 3, 4, 5, 6, 7]
    assert gone(3, 100.0, 0.0, 12.0) == []
    assert gone(3, 100.0, 0.0, 12.0, 1, 0) == [1, 2, 3, 4]
    assert gone(3, 100.0, 0.0, 12.0, 1, 8) == [1, 2]
    assert gone(9, 0.0, 1.0, 99.0, 4) == [1, 2, 3, 4, 5, 6]


def test_digests_are_numbered_and_old_ones_go(spark, tmp_path):
    folder = str(tmp_path / "digests")
    assert logs.digests(spark, folder).count() == 0
    for i in range(1, 5):
        assert logs.append_digest(spark.createDataFrame([(f"# {i}\n\n- x\n",)], "digest string"), folder, float(i), keep=2, least=1) == i
    kept = logs.digests(spark, folder)
    assert sorted(r["number"] for r in kept.collect()) == [3, 4]
    numbered = kept.select(F.concat(F.lit("d."), "number").alias("path"), "content")
    assert logs.latest_segment(numbered).first()["digest"] == "# 4\n\n- x\n"


def test_states_are_counted_on_the_way(spark):
    rows = spark.createDataFrame([(1, 7, "pass"), (2, None, "bypass"), (3, 0, "pass"), (4, 1, None)], "seq long, relevance_score int, decision string")
    seen = Observation("states")
    out = lifecycle.observed(rows, seen, lifecycle.of_summaries() | lifecycle.of_decisions(["pass", "bypass"]) | lifecycle.of_digests())
    assert sorted(r["seq"] for r in out.collect()) == [1, 2, 3, 4]
    assert seen.get == {"SUMMARIZED": 3, "FAILED": 1, "GATED:pass": 2, "GATED:bypass": 1, "RECEIVED": 4, "COMPOSED": 4}


def test_a_poll_reads_one_state(spark):
    scored = spark.createDataFrame([(1, "b", "x", 2.0), (2, "a", None, 3.0), (3, "b", "y", 5.0)], "seq long, source string, title string, score double")
    snapshot = spark.createDataFrame([(3, 2, 2)], "items long, done long, total long")
    counted, best, state = service.poll(scored, snapshot, spark.createDataFrame([("d",)], "digest string"))
    assert [tuple(r) for r in counted.collect()] == [("b", 2), ("a", 1)]
    assert sorted((r["source"], r["rank"], r["title"]) for r in best.collect()) == [("a", 1, ""), ("b", 1, "y"), ("b", 2, "x")]
    assert tuple(state.first()) == (3, 2, 2, True, True, "d")


def test_config_round_trip():
    config = PipelineConfig().with_added("repos", " a/b ").with_added("profile", "x").with_added("profile", "y").with_value("config_version", " v2 ")
    assert PipelineConfig.from_dict(config.to_dict()) == config and config.relevance_profile == "x\ny" and config.repos == ("a/b",)
    try:
        config.with_added("feeds", "  ")
    except ValueError:
        return
    raise AssertionError("a blank value was taken")


def test_control_rows_pass_and_unknown_kinds_go(spark):
    from siftwire.streaming import jobs

    rows = [(1, "feed", "feed:1", "award", "", "b", 0, "item"), (2, "feed", None, None, None, None, None, "done"), (3, "feed", "x", "y", "", "", 0, "noise"), (4, "feed", "feed:4", None, "", "b", 0, None)]
    df = spark.createDataFrame(rows, "seq long, source string, id string, title string, url string, body string, timestamp long, kind string")
    got = {r["seq"]: (r["title"], r["summary"], r["score"]) for r in jobs.summarize_and_score(df, 0).collect()}
    assert got == {1: ("award", "award — b", 2.0), 2: (None, None, None), 4: ("(untitled)", "(untitled) — b", 1.0)}


def test_states_of_any_shape_are_restored(spark):
    from siftwire.operators import cycles

    states = [(1, '{"items":[{"id":"a","n":1},5,{"id":"a","n":2},{"n":3},{"id":7},null],"total":"3","reported":["x",1,"x","y"]}'), (2, '{"items":7,"total":[1]}'), (3, "no json"), (4, None)]
    saved = spark.createDataFrame(states, "cycle long, state string")
    assert sorted(map(tuple, cycles.restored_items(saved).collect())) == [(1, 0, "a", '{"id":"a","n":1}'), (1, 3, "", '{"n":3}'), (1, 4, "", '{"id":7}')]
    assert sorted(map(tuple, cycles.restored_progress(saved).collect())) == [(1, 3, ["x", "y"]), (2, 0, []), (3, 0, []), (4, 0, [])]


def test_digest_by_a_model(spark):
    from siftwire.operators import enrich, items

    rows = [(1, "feed", "One", "http://a", "s1", 2.0), (2, "feed", "Two", "http://b", "s2", 3.0)]
    selected = items.selection(spark.createDataFrame(rows, "seq long, source string, title string, url string, summary string, score double"))

    class Echo:
        def __init__(self, reply):
            self.reply = reply

        def chat(self, messages, **options):
            if self.reply is None:
                raise OSError("down")
            return self.reply or messages[1]["content"]

    assert enrich.compose(selected, lambda: Echo(""), "us").first()["digest"].endswith("Items:\n- Two (feed, 3) s2 — http://b\n- One (feed, 2) s1 — http://a")
    plain = "# Newsletter draft\n\n- s2\n- s1\n"
    for model in (None, lambda: Echo(None), lambda: Echo("  ")):
        assert enrich.compose(selected, model).first()["digest"] == plain
