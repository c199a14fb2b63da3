import json

from siftwire import service
from siftwire.operators import cycles, reconcile
from siftwire.sources import clients_csv, code_host, feed, tracker

ANSWER = "seq long, answer string"


def test_code_host(spark):
    releases = [{"id": 1, "name": "", "tag_name": "v1", "published_at": "2024-01-01T00:00:00Z"}, {"id": "r2", "name": "Two", "tag_name": 3}, {"id": True, "name": "x"}, {"name": "no id"}]
    pulls = [{"number": 5, "title": "m", "merged_at": "2024-01-01T00:00:00Z"}, {"number": 6, "title": "c", "merged_at": None}]
    issues = [{"number": 7, "title": "i", "pull_request": None, "created_at": "2024-01-01T00:00:00Z"}, {"number": 8, "title": "p", "pull_request": {"u": 1}}]
    rows = [(0, "o/r", *map(json.dumps, (releases, pulls, issues))), (1, "", "[]", "[]", "[]"), (2, "o/bad", "<html>", None, "[]")]
    got = code_host.read(spark.createDataFrame(rows, "seq long, repo string, releases string, pulls string, issues string")).orderBy("seq").collect()
    assert [(r["id"], r["title"], r["timestamp"]) for r in got] == [
        ("github:o/r#release-1", "v1", 1704067200), ("github:o/r#release-r2", "Two", 0), ("github:o/r#pr-5", "m", 1704067200), ("github:o/r#issue-7", "i", 1704067200),
    ]


def test_tracker(spark):
    nodes = [{"identifier": "A-1", "title": "t"}, {"identifier": ""}, {"identifier": 5}, None, {"identifier": "A-2", "updatedAt": "2024-01-01T00:00:00.000Z"}]
    rows = [(0, json.dumps({"data": {"issues": {"nodes": nodes}}})), (1, "[]"), (2, None)]
    got = tracker.read(spark.createDataFrame(rows, ANSWER)).orderBy("seq").collect()
    assert [(r["id"], r["title"], r["timestamp"]) for r in got] == [("linear:A-1", "t", 0), ("linear:A-2", "", 1704067200)]


def test_feeds(spark):
    rss = """<rss xmlns:dc="d"><channel><item><title>T <b>x</b></title><link>l1</link><guid a="1">g1</guid><description><![CDATA[<p>d</p>]]></description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>
      <item><title>n</title></item><item><link>l2</link><dc:date>2024-01-01T00:00:00Z</dc:date></item></channel></rss>"""
    atom = """<feed><entry><title>a</title><link rel="self" href="s"/><link rel="alternate" href="h"/><id>i</id><updated>2024-01-01T00:00:00Z</updated></entry><entry><link rel="self" href="only"/></entry></feed>"""
    got = feed.read(spark.createDataFrame([(0, rss), (1, atom), (2, "<rss><broken"), (3, None)], ANSWER)).orderBy("seq").collect()
    assert [(r["id"], r["url"], r["timestamp"]) for r in got] == [("feed:g1", "l1", 1704067200), ("feed:l2", "l2", 1704067200), ("feed:i", "h", 1704067200), ("feed:only", "only", 0)]
    assert got[0]["title"].strip() == "T"


def lines(spark, *text):
    return spark.createDataFrame([(i, t) for i, t in enumerate(text)], "ord long, line string")


def test_csv_keeps_arity_and_rejects_whole_files(spark):
    got = clients_csv.parse(lines(spark, "", '"ATOMIC id","c","d"', '"1","x"', '" 2 ","x",', '"3","x",""', '"4","x","a,b","more"')).orderBy("ord").collect()
    assert [(r["atomic_site_id"], r["domain_name"]) for r in got] == [("2", ""), ("3", ""), ("4", "a,b")]
    for bad in ([], ["id,c,d", "1,2,3"], ["atomic,c,d"], ["atomic,c,d", "1,2"], ["garbage"]):
        assert clients_csv.parse(lines(spark, *bad)) is None
    assert clients_csv.read(spark, "") is None and clients_csv.read(spark, "/nowhere/at/all.csv") is None


STORE = [("1", "a", "c", "active", "f", "l", "", "kept"), ("2", "b", "c", "churned", "f", "l", "2023", "kept"), ("3", "c", "c", "active", "f", "l", "", "kept"), ("4", "d", "c", "churned", "f", "l", "2022", "kept")]


def test_import_twice(spark, tmp_path):
    store = spark.createDataFrame(STORE, reconcile.STORE + ", publisher_name string")
    path = tmp_path / "clients.csv"
    path.write_bytes(b'"atomic","created","domain"\r\n"1","n","new"\r"2","n","back"\n"9","n","fresh"\n"9","n","later"\n')
    after, message = service.import_clients(spark, store, str(path), "T")
    assert message.first()["message"] == "Imported 3 rows: 1 created, 2 updated, 1 reactivated, 1 churned."
    got = {r["atomic_site_id"]: (r["domain_name"], r["status"], r["first_seen"], r["last_seen"], r["churned_at"], r["publisher_name"]) for r in after.collect()}
    assert got == {
        "1": ("new", "active", "f", "T", "", "kept"), "2": ("back", "active", "f", "T", "", "kept"), "3": ("c", "churned", "f", "l", "T", "kept"),
        "4": ("d", "churned", "f", "l", "2022", "kept"), "9": ("later", "active", "T", "T", "", ""),
    }
    again, message = service.import_clients(spark, after, str(path), "T")
    assert message.first()["message"] == "Imported 3 rows: 0 created, 4 updated, 0 reactivated, 0 churned."
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    path.write_text("garbage")
    same, message = service.import_clients(spark, store, str(path), "T")
    assert same is store and "no client rows" in message.first()["message"]


def test_prefix_delete_takes_the_prefix_literally(spark):
    names = ["sw_a", "_transient_sw_b", "_transient_timeout_sw_c", "swXa", "other", "sw_"]
    rest, gone = reconcile.delete_prefixed(spark.createDataFrame([(n,) for n in names], "name string"), "sw_")
    assert gone.first()["deleted"] == 4 and sorted(r["name"] for r in rest.collect()) == ["other", "swXa"]


def test_fetching(spark):
    from siftwire.config import PipelineConfig
    from siftwire.sources import fetch

    def transport(url, headers, body, timeout):
        assert timeout == 15
        if "/bad/" in url:
            raise OSError("no route")
        if url.startswith(fetch.CODE_HOST):
            assert headers.get("Authorization") in (None, "Bearer t")
            return (500, "[]") if "/pulls" in url else (200, json.dumps([{"id": 1, "number": 7, "title": url.split("?")[0], "name": headers.get("Authorization")}]))
        if url == fetch.TRACKER:
            assert headers["Authorization"] == "k" and "issues" in json.loads(body)["query"]
            return 200, json.dumps({"data": {"issues": {"nodes": [{"identifier": "A-1"}, {"identifier": "A-1"}]}}})
        return (200, "<rss><channel><item><link>l</link></item></channel></rss>") if url.endswith("good") else (503, "")

    config = PipelineConfig(repos=("o/r", "", "o/bad/x"), feeds=("http://f/good", "", "http://f/gone", "http://f/good"), code_host_token="t", tracker_token="k")
    rows = service.collect(spark, config, transport).orderBy("seq").collect()
    assert (rows[0]["seq"], rows[0]["kind"]) == (0, "reset")
    assert [(r["kind"], r["id"]) for r in rows if r["kind"] == "item"] == [("item", f"github:o/r#{x}") for x in ("release-1", "issue-7")] + [("item", "linear:A-1"), ("item", "feed:l")]
    assert [(r["kind"], r["source"]) for r in rows[5:]] == [("done", "feed"), ("done", "github"), ("done", "linear")]
    none = service.collect(spark, PipelineConfig(repos=("o/r",)), lambda *a: (500, ""), start=70).orderBy("seq").collect()
    assert [(r["seq"], r["kind"]) for r in none] == [(70, "reset"), (71, "done"), (72, "done"), (73, "done")]
    assert fetch.tracker_answers(spark, "").count() == 0
    urls = [r[4] for r in fetch.code_host_requests(["o/a b"])]
    assert all("per_page=10" in u and "/repos/o/a%20b/" in u for u in urls)

    # A second collection starts a new cycle, and doesn't add to the first.
    both = cycles.with_cycle(service.collect(spark, config, transport).unionByName(service.collect(spark, config, transport, start=1000)))
    assert sorted(map(tuple, cycles.snapshot(both, 3).collect())) == [(1, 4, 3, 3), (2, 4, 3, 3)]


def test_calls_that_fail_in_any_way(spark):
    import http.client
    import urllib.error

    from siftwire.operators import enrich
    from siftwire.sources import fetch

    errors = [http.client.InvalidURL("a space"), http.client.IncompleteRead(b"half"), urllib.error.URLError("x"), UnicodeError("y"), RecursionError("z"), TypeError("w")]

    def transport(url, headers, body, timeout):
        number = int(url.rsplit("/", 1)[1])
        if number < len(errors):
            raise errors[number]
        return 200, "fine"

    rows = fetch.feed_answers(spark, [f"http://f/{i}" for i in range(len(errors) + 1)], transport).orderBy("seq").collect()
    assert [r["answer"] for r in rows] == [None] * len(errors) + ["fine"]
    assert fetch.feed_answers(spark, ["http://no host/a b"]).first()["answer"] is None  # the library's own transport

    class Model:
        def chat(self, messages, **options):
            raise http.client.IncompleteRead(b"half")

    asked = enrich.ask(spark.createDataFrame([(1, [{"role": "user", "content": "x"}])], "seq long, messages array<struct<role:string,content:string>>"), Model)
    assert asked.first()["reply"] is None


def test_a_stream_asks_once_in_each_slot(spark, tmp_path):
    from siftwire.config import PipelineConfig, credential
    from siftwire.sources import fetch

    def transport(url, headers, body, timeout):
        if url == fetch.TRACKER:
            return 200, json.dumps({"data": {"issues": {"nodes": [{"identifier": "A-1"}]}}})
        return (200, "<rss><channel><item><link>l</link></item></channel></rss>") if url.endswith("good") else (503, "")

    config = PipelineConfig(repos=("o/r",), feeds=("http://f/good", "http://f/gone"), tracker_token=credential({"main": "k"}, " main "))
    clock = tmp_path / "clock"

    def now():
        return float(clock.read_text())

    def run():
        return service.collect_stream(spark, config, str(tmp_path / "log"), str(tmp_path / "check"), transport, now, 10.0).awaitTermination(200)

    for seconds in (25, 27, 61):  # slots 2, 2 and 6
        clock.write_text(str(seconds))
        assert run()
    got = spark.read.parquet(str(tmp_path / "log"))
    batch = service.collect(spark, config, transport)
    columns = ["kind", "source", "id"]
    for slot in (2, 6):
        own = got.where(f"seq >= {slot * service.PLACES} and seq < {(slot + 1) * service.PLACES}")
        shown = lambda df: [tuple(r[c] for c in columns) for r in df.orderBy("seq").collect()]
        assert shown(own) == shown(batch)
    assert got.count() == 2 * batch.count()
    assert credential({"a": 1}, "a") == credential({}, "b") == credential({"": "x"}, " ") == ""


def test_lines_of_splits_are_numbered_as_in_the_whole_file(spark, tmp_path):
    import random
    import re

    rng = random.Random(2)
    text = "id atomic,created,domain" + "".join(rng.choice(["\n", "\r\n", "\r"]) + rng.choice(["", " ", f"{i},2024,c{i}.example", f'"{i}","a ""q""", é{i}.example ', "x" * 300]) for i in range(700)) + "\n"
    path = tmp_path / "clients.csv"
    path.write_bytes(text.encode())
    want = [x for x in re.split(r"\r\n|\r|\n", text)][:-1]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = clients_csv.numbered_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3
        assert [(r["ord"], r["line"]) for r in lines.orderBy("ord").collect()] == list(enumerate(want))
        split = clients_csv.read(spark, str(path)).orderBy("ord").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one = clients_csv.parse(spark.createDataFrame(list(enumerate(want)), "ord long, line string")).orderBy("ord").collect()
    assert split == one and len(one) > 200
